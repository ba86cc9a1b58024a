"""Choosing and ordering rows: keywords, null-aware filters, top rows by class, budgets, votes on words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(text: Column, terms: list[str]) -> Column:
    """The terms occur one after another, whatever stands between them and in whatever case."""
    escaped = [t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for t in terms]
    return text.ilike("%" + "%".join(escaped) + "%")


def all_terms(fields: list[Column], terms: list[str]) -> Column:
    """Every term occurs in at least one of the fields; a null field holds none."""
    some = [reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(t.lower())), F.lit(False)) for f in fields]) for t in terms]
    return reduce(lambda a, b: a & b, some)


def not_among(value: Column, excluded: list[str]) -> Column:
    """Not one of the excluded values; null passes."""
    return value.isNull() | ~value.isin(*excluded)


def excluded_by(topics: Column, exclusions: list[str]) -> Column:
    """A topic holds an exclusion or is held by one, in whatever case."""
    return F.exists(topics, lambda t: F.exists(F.array(*[F.lit(e.lower()) for e in exclusions]), lambda e: F.contains(F.lower(t), e) | F.contains(e, F.lower(t))))


def prefix_query(text: Column) -> Column:
    """A question as quoted prefix terms for a full-text index: letters and digits only, joined by blanks."""
    terms = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_join(F.transform(terms, lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " ")


def best_of_each(df: DataFrame, key: str, value: str, id_col: str) -> DataFrame:
    """One row per key: the id of greatest value, the least id among ties; null values last."""
    order = F.struct(F.coalesce(F.col(value), F.lit(float("-inf"))), -F.col(id_col))
    return df.groupBy(key).agg(F.max_by(id_col, order).alias(id_col), F.max(value).alias(value))


def within_budgets(df: DataFrame, kind: str, score: str, id_col: str, budgets: dict[str, int], other: int) -> DataFrame:
    """All rows with `demoted`: those beyond the budget of their class, from the highest score down."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair]), F.col(kind)), F.lit(other))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), id_col))
    return df.withColumn("demoted", place > limit)


def serendipity(df: DataFrame, relevant: Column, score: str, id_col: str, percent: int, most: int = 5) -> DataFrame:
    """The best rejected rows, as many as `percent` of the relevant ones but at most `most`."""
    n = F.broadcast(df.agg(F.least(F.lit(most), F.floor(F.sum(relevant.cast("long")) * percent / 100)).alias("n")))
    top = df.where(~relevant).orderBy(F.desc(score), id_col).limit(most)
    place = F.row_number().over(Window.orderBy(F.desc(score), id_col))  # over `most` rows
    return top.withColumn("place", place).crossJoin(n).where("place <= n").drop("place", "n")


def first_of(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union by key in which a row of an earlier source hides those of later ones."""
    tagged = [s.withColumn("rank", F.lit(k)) for k, s in enumerate(sources)]
    rest = [c for c in sources[0].columns if c not in key]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    return rows.groupBy(*key).agg(F.min(F.struct("rank", *rest)).alias("v")).select(*key, *[f"v.{c}" for c in rest])


def word_votes(df: DataFrame, title: Column, saved: Column, most_words: int = 5, longer_than: int = 3, least: int = 2) -> DataFrame:
    """Saves and dismissals by the first long words of the titles: word, saves, dismissals, net."""
    long = F.filter(F.split(F.lower(title), r"[^a-z0-9]+"), lambda w: F.length(w) > longer_than)
    votes = df.select(F.explode(F.array_distinct(F.slice(long, 1, most_words))).alias("word"), saved.alias("saved"))
    out = votes.groupBy("word").agg(F.sum(F.when(F.col("saved"), 1).otherwise(0)).alias("saves"), F.sum(F.when(F.col("saved"), 0).otherwise(1)).alias("dismissals"))
    return out.where(F.col("saves") + F.col("dismissals") >= least).withColumn("net", (F.col("saves") - F.col("dismissals")) / (F.col("saves") + F.col("dismissals")))


def batch_health(df: DataFrame, key: str, ts: str, known: DataFrame, by: str, now: Column, stale_hours: int = 24) -> DataFrame:
    """By source: rows, share of keys already known, hours since the newest row, and a verdict."""
    seen = known.select(F.col(key).alias("known_key")).distinct()
    age = F.timestamp_diff("SECOND", F.max(ts).cast("timestamp_ntz"), now.cast("timestamp_ntz")) / 3600
    out = df.join(seen, F.col(key) == F.col("known_key"), "left").groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("known_key").isNotNull().cast("double")).alias("known_share"), age.alias("age_hours"))
    verdict = F.when(F.col("age_hours") > stale_hours, "stale").when(F.col("known_share") > 0.9, "repeating").otherwise("healthy")
    return out.withColumn("verdict", verdict)
