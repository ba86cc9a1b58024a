"""What feedback tells of topics, sources, thresholds and users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.numeric import hours, micros
from siftwell.operators.sequences import carried_back

# What an action counts, by how it was done for a click.
ACTIONS = {"save": 1.0, "share": 1.0, "dismiss": -0.8, "irrelevant": -1.0, "briefing_click": 0.7, "briefing_dismiss": -0.2}
PATTERNS = {"bounced": -0.4, "scanned": 0.8, "engaged": 1.1, "completed": 1.4, "reread": 0.6, "abandoned": 0.0}
GAP_WEIGHTS = {"security": 3.0, "breaking": 2.5, "version": 1.5, "roadmap": 1.0}


def _share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def _chosen(key: Column, table: dict[str, float], default: float) -> Column:
    return reduce(lambda out, item: F.when(key == item[0], item[1]).otherwise(out), table.items(), F.lit(default))


def accuracy(rows: DataFrame, topic: str, signal: str, least: int = 5) -> DataFrame:
    """By topic: how far engagement is from one half, blended with the mean signal; topics of fewer rows are left out."""
    out = rows.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("n"), _share(F.col(signal) > 0).alias("good"), F.avg(signal).alias("mean")).where(F.col("n") >= least)
    return out.select(topic, "n", F.round((F.col("good") - 0.5) * 0.6 + F.col("mean") * 0.4, 6).alias("delta"), F.round(F.least(F.col("n") / 15, F.lit(1.0)), 6).alias("confidence"))


def calibration(rows: DataFrame, topic: str, engaged: str, least: int = 3) -> DataFrame:
    """By topic: engaged share less one; a null counts as not engaged."""
    out = rows.groupBy(topic).agg(F.count("*").alias("n"), _share(F.coalesce(engaged, F.lit(False))).alias("good")).where(F.col("n") >= least)
    return out.select(topic, "n", F.round(F.col("good") - 1, 6).alias("delta"), F.round(F.least(F.col("n") / 10, F.lit(1.0)), 6).alias("confidence"))


def archetypes(rows: DataFrame, by: list[str], dismissed: Column, least: int = 8, rate: float = 0.7, most: float = 0.25) -> DataFrame:
    """Kinds of rows that are dismissed nearly always, with the penalty that this suggests."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), _share(dismissed).alias("r")).where((F.col("n") >= least) & (F.col("r") >= rate))
    return out.select(*by, "n", F.round("r", 6).alias("rate"), F.round(F.least((F.col("r") - 0.5) * 0.5, F.lit(most)), 6).alias("penalty"))


def drift(rows: DataFrame, topic: str, title: str, score: str, ts: str, now: Column, days: int, recent_hours: int = 24, least: float = 0.5) -> DataFrame:
    """Topics whose titles of the last hours and of the days before are mostly different: 1 - Jaccard, and where the score goes.

    Titles are told apart and counted by aggregation, so that no row holds all titles of a topic.
    """
    rows = rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")).withColumn("_now", F.col(ts) >= now - F.expr(f"INTERVAL {recent_hours} HOURS"))
    each = rows.groupBy(topic, title).agg(*[f(c).alias(n) for n, f, c in (("a", F.bool_or, F.col("_now")), ("b", F.bool_or, ~F.col("_now")))], *[F.sum(F.when(c, F.col(score))).alias(n) for n, c in (("sa", F.col("_now")), ("sb", ~F.col("_now")))], *[F.count(F.when(c, F.col(score))).alias(n) for n, c in (("na", F.col("_now")), ("nb", ~F.col("_now")))])
    n = lambda c: F.sum(c.cast("long"))
    out = each.groupBy(topic).agg(n(F.col("a") & F.col("b")).alias("both"), F.count("*").alias("all"), n(F.col("a")).alias("n_a"), n(F.col("b")).alias("n_b"), (F.sum("sa") / F.sum("na") - F.sum("sb") / F.sum("nb")).alias("change"))
    way = F.when(F.col("change") > 0.05, "gaining").when(F.col("change") < -0.05, "losing").otherwise("changed")
    return out.where("n_a > 0 and n_b > 0").select(topic, F.round(1 - F.col("both") / F.col("all"), 6).alias("drift"), way.alias("direction")).where(F.col("drift") > least)


def false_positives(rows: DataFrame, topic: str, wrong: Column, more_than: int = 2) -> DataFrame:
    out = rows.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("wrong")).where(F.col("n") > more_than)
    return out.withColumn("rate", F.round(F.col("wrong") / F.col("n"), 6))


def threshold(recent: DataFrame, engaged: Column, current: float, step: float = 0.02, low: float = 0.30, high: float = 0.50, least: int = 20) -> DataFrame:
    """The next threshold: a step down where more than half is engaged with, a step up where less than 15 % is."""
    out = recent.agg(F.count("*").alias("n"), _share(engaged).alias("r"))
    move = F.when(F.col("n") < least, 0.0).when(F.col("r") > 0.5, -step).when(F.col("r") < 0.15, step).otherwise(0.0)
    return out.select("n", F.round(F.greatest(F.least(current + move, F.lit(high)), F.lit(low)), 6).alias("threshold"))


def decayed(confidence: Column, days: Column, half_life: float = 60, rest: float = 7) -> Column:
    """Halved in every half-life, but unchanged within the days of rest."""
    return F.when(days > rest, confidence * F.pow(F.lit(0.5), days / half_life)).otherwise(confidence)


def strength(action: Column, seconds: Column, pattern: Column, scrolled: Column) -> Column:
    """What an action says, from -1 to 1.4; an unknown one nothing. Clicks count by dwell time and how they were read."""
    click = (0.5 + F.least(seconds / 60, F.lit(0.5))) * F.when(pattern.isNull(), 1.0).otherwise(_chosen(pattern, PATTERNS, 1.0))
    complete = 0.3 + 0.4 * F.least(F.greatest(scrolled, F.lit(0.0)), F.lit(1.0)) + F.least(seconds / 120, F.lit(0.3))
    return F.when(action == "click", click).when(action == "complete", complete).otherwise(_chosen(action, ACTIONS, 0.0))


def time_to_resolve(events: DataFrame, key: str, ts: str, tie: str, failed: Column, stretch_hours: int = 24) -> DataFrame:
    """By key: failures after which something else came, and the mean hours until then.

    A key is cut into stretches of time; a failure with nothing else left in its stretch takes the first of those after it.
    """
    rows = events.select(key, ts, tie, failed.alias("_failed"), F.floor(micros(F.col(ts)) / (stretch_hours * 3_600_000_000)).alias("_stretch"))
    rows = rows.withColumn("_other", F.when(~F.col("_failed"), F.col(ts)))
    after = Window.partitionBy(key, "_stretch").orderBy(F.desc(ts), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)
    later = carried_back(rows.groupBy(key, "_stretch").agg(F.min("_other").alias("_least")), key, "_stretch", "_least", "_after")
    done = rows.withColumn("_first", F.min("_other").over(after)).where("_failed").join(later, [key, "_stretch"], "left").withColumn("_done", F.coalesce("_first", "_after"))
    return done.where("_done is not null").groupBy(key).agg(F.count("*").alias("resolved"), F.round(F.avg(hours(F.col("_done"), F.col(ts))), 6).alias("hours"))


def usefulness(rows: DataFrame, key: str, used: Column, partly: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round((F.sum(used.cast("long")) + 0.5 * F.sum(partly.cast("long"))) / F.count("*"), 6).alias("usefulness"))


def gaps(rows: DataFrame, key: str, missed: Column, kind: Column, engaged_at: Column, now: Column) -> DataFrame:
    """By key: weight of what was missed, more where it is long since anything was engaged with, and its severity."""
    has = lambda name: F.coalesce(F.bool_or(missed & (kind == name)), F.lit(False))
    out = rows.groupBy(key).agg(F.max(engaged_at).alias("last"), has("security").alias("security"), has("breaking").alias("breaking"), F.sum(F.when(missed, _chosen(kind, GAP_WEIGHTS, 0.5)).otherwise(0.0)).alias("weight"))
    out = out.withColumn("days", F.coalesce(F.floor(hours(now, F.col("last")) / 24), F.lit(999)))
    score = F.col("weight") * F.when(F.col("days") >= 999, 1.5).when(F.col("days") > 30, 1.2).otherwise(1.0)
    level = F.when(F.col("security"), "critical").when(F.col("breaking") | (score >= 5), "high").when((score >= 2) | (F.col("days") > 14), "medium").otherwise("low")
    return out.select(key, F.round(score, 6).alias("score"), level.alias("severity"))


def curve(rows: DataFrame, predicted: Column, observed: Column, bins: int = 5) -> DataFrame:
    """Equal bins of predictions, the last with its right edge: center, rows and observed rate; empty bins are left out."""
    at = F.least(F.floor(F.least(F.greatest(predicted, F.lit(0.0)), F.lit(1.0)) / (1 / bins)), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(_share(observed), 6).alias("rate"))
    return out.withColumn("center", F.round((F.col("bin") + 0.5) / bins, 6))


def personas(rows: DataFrame, key: str, answer: str, likelihoods: str, millis: Column) -> DataFrame:
    """Posterior of each persona by key from answers (yes, no, strong), those given slowly counting less; equal priors."""
    each = rows.select(key, F.col(answer).alias("_answer"), millis.alias("_ms"), F.posexplode(likelihoods).alias("persona", "_p"))
    p = F.col("_p")
    likelihood = F.when(F.col("_answer") == "yes", p).when(F.col("_answer") == "no", 1 - p).otherwise(p * p / (p * p + (1 - p) * (1 - p)))
    power = F.when(F.col("_ms").isNull(), 1.0).otherwise(0.5 + 0.5 / (1 + F.col("_ms") / 3000.0))
    sums = each.groupBy(key, "persona").agg(F.sum(power * F.ln(likelihood)).alias("_s"))
    of_key = Window.partitionBy(key)
    weights = sums.withColumn("_w", F.exp(F.col("_s") - F.max("_s").over(of_key)))
    return weights.select(key, F.col("persona").cast("long").alias("persona"), F.round(F.col("_w") / F.sum("_w").over(of_key), 6).alias("posterior"))


def convergence(rows: DataFrame, project: str, item: str) -> DataFrame:
    """By project: items that other projects have too, its own, and the shared share; rows without either are left out."""
    pairs = rows.select(project, item).dropna().distinct()
    several = pairs.groupBy(item).agg((F.count("*") > 1).alias("_shared"))
    out = pairs.join(several, item).groupBy(project).agg(F.sum(F.col("_shared").cast("long")).alias("shared"), F.sum((~F.col("_shared")).cast("long")).alias("own"))
    return out.withColumn("convergence", F.round(F.col("shared") / (F.col("shared") + F.col("own")), 6))


def last_write(log: DataFrame, key: str, clock: list[str], value: str) -> DataFrame:
    """State of a replicated log: by key the value with the greatest clock, and that clock as `at`; order of arrival is no matter."""
    at = F.struct(*clock)
    return log.groupBy(key).agg(F.max_by(value, at).alias("value"), F.max(at).alias("at"))


def common_terms(rows: DataFrame, group: str, key: str, terms: str, share: float, least: int) -> DataFrame:
    """Terms in at least a share of a group's items, in groups of at least so many."""
    sizes = rows.groupBy(group).agg(F.countDistinct(key).alias("_items")).where(F.col("_items") >= least)
    each = rows.select(group, key, F.explode(terms).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    return each.join(sizes, group).where(F.col("n") >= share * F.col("_items")).select(group, "word", "n")
