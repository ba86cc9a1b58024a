"""Engagement, calibration, decay, topics and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.numeric import hours


def engagement(items: DataFrame, feedback: DataFrame, key: str, group: str, good: str) -> DataFrame:
    """Items, rated and engaged items by group, and the engaged share of the items."""
    rated = items.select(key, group).join(feedback.select(key, good), key).groupBy(group).agg(F.count("*").alias("rated"), F.sum(F.col(good).cast("long")).alias("engaged"))
    out = items.groupBy(group).agg(F.count("*").alias("items")).join(rated, group, "left")
    out = out.select(group, "items", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rated", "engaged")])
    return out.withColumn("rate", F.round(F.col("engaged") / F.col("items"), 6))


def anti_patterns(rates: DataFrame, group: str, least: int) -> DataFrame:
    """Groups against the overall rate: rarely engaged ones get a penalty of 0.2 at most, often engaged ones a boost of 0.15."""
    both = rates.withColumn("overall", F.sum("engaged").over(Window.partitionBy()) / F.sum("items").over(Window.partitionBy()))
    kind = F.when((F.col("items") >= least) & (F.col("rate") < 0.05), "over_scored").when((F.col("rate") > 0.5) & (F.col("rate") > 2 * F.col("overall")), "under_scored").otherwise("normal")
    change = F.when(kind == "over_scored", -F.least(0.2 * (1 - F.col("rate") / 0.05), F.lit(0.2))).when(kind == "under_scored", F.least((F.col("rate") - F.col("overall")) * 0.3, F.lit(0.15))).otherwise(0.0)
    return both.select(group, "items", "rate", kind.alias("kind"), F.round(change, 6).alias("adjustment"))


def ece(predictions: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Equal-width bins with their share of the expected calibration error."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    out = predictions.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    total = F.sum("n").over(Window.partitionBy())
    return out.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"), F.round(F.abs(F.col("mean_p") - F.col("mean_y")) * F.col("n") / total, 6).alias("part"))


def confusion(predictions: DataFrame, p: str, y: str, threshold: float) -> DataFrame:
    """True and false positives and negatives, precision, recall and F1."""
    yes, real = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    out = predictions.agg(n(yes & real).alias("tp"), n(yes & ~real).alias("fp"), n(~yes & ~real).alias("tn"), n(~yes & real).alias("fn"))
    out = out.withColumn("precision", F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), 6))
    return out.withColumn("f1", F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def volume_anomalies(events: DataFrame, group: str, ts: str, days: int = 7, least: int = 3, z: float = 2.0) -> DataFrame:
    """Days whose number of events is more than z population deviations from the mean of the days before."""
    daily = events.groupBy(group, F.to_date(ts).alias("day")).count()
    before = Window.partitionBy(group).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    out = daily.select(group, "day", "count", F.avg("count").over(before).alias("mean"), F.stddev_pop("count").over(before).alias("sd"), F.count("*").over(before).alias("seen"))
    score = F.when((F.col("seen") >= least) & (F.col("sd") > 0), (F.col("count") - F.col("mean")) / F.col("sd"))
    return out.select(group, "day", "count", F.round(score, 6).alias("z"), F.coalesce(F.abs(score) > z, F.lit(False)).alias("abnormal"))


def stability(evidence: DataFrame, key: str, ts: str, now: Column, half_life_hours: float, weight: Column) -> DataFrame:
    """Sum of weights times e^(-age/half-life), capped at 10, and the state that its thresholds give."""
    out = evidence.groupBy(key).agg(F.sum(weight * F.exp(-hours(now, F.col(ts)) / half_life_hours)).alias("s"), F.count("*").alias("evidence"))
    s = F.round(F.least("s", F.lit(10.0)), 6)
    return out.select(key, "evidence", s.alias("stability"), F.when(s >= 1.5, "stable").when(s >= 0.7, "emerging").when(s >= 0.4, "candidate").otherwise("dropped").alias("state"))


def half_life(items: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """Items of each key by age (under 24, 72, and more hours) and the half-life their shape tells: 24, 72 or 168 hours."""
    age = hours(now, F.col(ts))
    n = lambda c: F.sum(c.cast("long"))
    out = items.groupBy(key).agg(n(age < 24).alias("young"), n((age >= 24) & (age < 72)).alias("mid"), n(age >= 72).alias("old"))
    total = F.col("young") + F.col("mid") + F.col("old")
    life = F.when(F.col("young") > 0.6 * total, 24).when(F.col("old") > 0.4 * total, 168).otherwise(72)
    return out.withColumn("half_life", life)


def precision_by_period(events: DataFrame, group: str, ts: str, good: Column, bad: Column, least: int = 5, unit: str = "week") -> DataFrame:
    """good / (good + bad) by group and period; null below `least` rated."""
    out = events.groupBy(group, F.to_date(F.date_trunc(unit, ts)).alias("period")).agg(F.sum(good.cast("long")).alias("good"), F.sum(bad.cast("long")).alias("bad"))
    n = F.col("good") + F.col("bad")
    return out.withColumn("precision", F.when(n >= least, F.round(F.col("good") / n, 6)))


def cooccurrence(items: DataFrame, key: str, topic: str, quality: str, least: int, limit: int) -> DataFrame:
    """Pairs of topics of the same item: count, mean quality, weight; the heaviest `limit`.

    Topics are first reduced to those of `least` items. An item's topics are paired within the item's row.
    """
    each = items.select(key, topic, quality).distinct()
    common = each.groupBy(topic).count().where(F.col("count") >= least).select(topic)
    lists = each.join(common, topic).groupBy(key).agg(F.array_sort(F.collect_set(topic)).alias("t"), F.max(quality).alias("q"))
    couples = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = lists.select(F.explode(couples).alias("p"), "q").select("p.a", "p.b", "q")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("q").alias("quality"))
    return out.select("a", "b", "n", F.round("quality", 6).alias("quality"), F.round(F.col("n") * F.col("quality"), 6).alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(limit)


def class_terms(docs: DataFrame, group: str, key: str, terms: str, coverage: float, hits: int, top: int) -> DataFrame:
    """Labels of groups by class TF-IDF, tf * ln(1 + groups / df), of terms in a share of the group's rows."""
    each = docs.select(group, key, F.explode(F.array_distinct(terms)).alias("term"))
    tf = each.groupBy(group, "term").agg(F.count("*").alias("tf"))
    sizes = docs.groupBy(group).agg(F.count("*").alias("size"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    out = tf.where(F.col("tf") >= hits).join(F.broadcast(sizes), group).where(F.col("tf") >= coverage * F.col("size")).join(df, "term")
    groups = sizes.agg(F.count("*").alias("groups"))
    score = F.round(F.col("tf") * F.ln(1 + F.col("groups") / F.col("df")), 6)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))
    return out.join(F.broadcast(groups)).withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top).select(group, "term", "tf", "df", "score", "rank")


def sigmoid_fit(values: DataFrame, value: str, key: str, sample: int = 500, least: int = 50, floor: float = 0.01, narrow: float = 0.01) -> DataFrame:
    """Centre and scale of a sigmoid from observed similarities: one row (n, mean, deviation, center, scale).

    The sample is the `sample` rows above `floor` with the least hash of their key: every task keeps so many and the least
    of those stay, so the sample is the same for any partitioning and two samples merge into that of both. Mean and
    population deviation of the sample give the centre, within 0.2 and 0.7, and 2.5 by the deviation gives the scale, within
    5 and 30; both are null with fewer than `least` rows or a deviation below `narrow`. Null values and keys have no part.
    """
    usable = values.where((F.col(value) > floor) & F.col(key).isNotNull()).select(F.col(value).cast("double").alias("v"), F.md5(F.col(key).cast("string").cast("binary")).alias("h"), F.col(key).alias("k"))
    picked = usable.orderBy("h", "k").limit(sample)
    out = picked.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    told = (F.col("n") >= least) & (F.col("deviation") >= narrow)
    center = F.when(told, F.greatest(F.lit(0.20), F.least(F.col("mean"), F.lit(0.70))))
    scale = F.when(told, F.greatest(F.lit(5.0), F.least(2.5 / F.col("deviation"), F.lit(30.0))))
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round(center, 6).alias("center"), F.round(scale, 6).alias("scale"))
