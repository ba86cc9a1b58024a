"""Stories: items of one topic gathered around the best of them, and what several sources say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.vectors import leaders

#: Words without weight in headings, and words that speak for and against.
LIGHT = ("a", "an", "the", "in", "of", "for", "to", "and", "is", "new")
GOOD = ("improves", "fixes", "faster", "better", "stable", "resolved", "upgrade")
BAD = ("breaks", "regression", "slower", "leak", "vulnerability", "broken", "crash")
#: Similarity that suffices, and that which does with shared words; the share of words; the least score.
ALIKE, CLOSE, SHARED, FLOOR = 0.77, 0.73, 0.60, 0.20
#: What each further source adds, and the most that all do.
PER_SOURCE, MOST = 0.05, 0.15


def heading_words(title: Column) -> Column:
    """Words of a heading without light ones; a word that begins with a digit or v ends at its first point."""
    split = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: (w != "") & ~w.isin(*LIGHT))
    return F.array_distinct(F.transform(split, lambda w: F.when(F.rlike(w, F.lit("^[0-9v]")), F.regexp_replace(w, r"\..*$", "")).otherwise(w)))


def topic_clusters(items: DataFrame, alike: float = ALIKE, close: float = CLOSE, shared: float = SHARED, floor: float = FLOOR) -> DataFrame:
    """Rows (id, cluster, size, sources, bonus, mixed), one for each item with a score of at least `floor` and a vector.

    items: id, score, source, title, vector. From the best item on (ties: the smaller id), each that no cluster has yet
    takes all such items whose cosine with it is above `alike`, or above `close` if the share of common words in the
    headings is above `shared`. A cluster is named by its first and best item. Each source beyond the first adds to the
    bonus; mixed clusters have words for and against in their headings. Null sources count as one source.
    """
    usable = items.where((F.col("score") >= floor) & F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))
    taken = leaders(usable.withColumn("w", heading_words(F.col("title"))), "id", "vector", "w", -F.col("score").cast("double"), alike, close, shared)
    low = F.lower(F.coalesce("title", F.lit("")))
    says = lambda phrases: F.lit(False) if not phrases else F.contains(low, F.lit(phrases[0])) | says(phrases[1:])
    each = usable.select("id", F.coalesce("source", F.lit("")).alias("source"), says(GOOD).alias("good"), says(BAD).alias("bad")).join(taken, "id", "left")
    each = each.select(F.coalesce("kept_id", "id").alias("cluster"), "id", "source", "good", "bad")
    of = each.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("source").alias("sources"), F.max("good").alias("good"), F.max("bad").alias("bad"))
    bonus = F.round(F.least((F.col("sources") - 1) * PER_SOURCE, F.lit(MOST)), 6)
    return each.select("id", "cluster").join(of.select("cluster", "size", "sources", bonus.alias("bonus"), ((F.col("size") > 1) & F.col("good") & F.col("bad")).alias("mixed")), "cluster").select("id", "cluster", "size", "sources", "bonus", "mixed")


def collapsed(keys: DataFrame, components) -> DataFrame:
    """Items that share a key, directly or through others, as one story: (id, story), the story's least id.

    keys: (id, key). A key links its items to the least of them, so that a common key is no clique.
    """
    least = keys.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("b"))
    edges = keys.join(least, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    parts = components(edges).toDF("id", "story")
    return keys.select("id").where("id is not null").distinct().join(parts, "id", "left").select("id", F.coalesce("story", "id").alias("story"))
