"""The relevance score of an item as one plan of expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.numeric import cosine, sigmoid, steps

#: Freshness by age in hours.
FRESHNESS = [(1.0, 1.10), (6.0, 1.08), (24.0, 1.05), (72.0, 1.0), (168.0, 0.92), (720.0, 0.85)]
OLDEST = 0.80


@dataclass(frozen=True)
class Config:
    """Constants of the score; gate gives multiplier and ceiling by the number of confirmed axes."""

    center: float = 0.48
    context_axis: float = 0.45
    interest_axis: float = 0.50
    keyword_axis: float = 0.50
    gate: tuple[tuple[float, float], ...] = field(default=((0.25, 0.20), (0.45, 0.28), (1.0, 0.72), (1.10, 0.88), (1.20, 1.0), (1.25, 1.0)))
    quality_damping: float = 0.65
    boost_low: float = -0.15
    boost_high: float = 0.50
    most: float = 0.95
    relevant: float = 0.40


def freshness(age_hours: Column) -> Column:
    return steps(age_hours, FRESHNESS, OLDEST)


def gate(axes: Column, config: Config, what: int) -> Column:
    """Multiplier (0) or ceiling (1) for a number of confirmed axes."""
    out = F.lit(config.gate[-1][what])
    for n, row in reversed(list(enumerate(config.gate[:-1]))):
        out = F.when(axes <= n, row[what]).otherwise(out)
    return out


def semantic_boost(items: DataFrame, topics: DataFrame, id_col: str, vector_col: str, topic_vector: str, weight: str) -> DataFrame:
    """(Weighted mean cosine with the topics - 0.5), within -0.3 and 0.5; one row an item.

    Topics are a person's. They become one row, which is folded within each item's row, so that items are neither multiplied
    nor shuffled. Without topics there is no boost (null).
    """
    book = topics.agg(F.collect_list(F.struct(F.col(topic_vector).alias("v"), F.col(weight).cast("double").alias("w"))).alias("_book"))
    met = items.select(id_col, vector_col).join(F.broadcast(book))  # one row
    total = F.aggregate("_book", F.lit(0.0), lambda a, t: a + cosine(F.col(vector_col), t["v"]) * t["w"])
    weights = F.aggregate("_book", F.lit(0.0), lambda a, t: a + t["w"])
    mean = F.when(weights > 0, total / weights)
    return met.select(id_col, F.when(mean.isNotNull(), F.round(F.greatest(F.lit(-0.3), F.least(mean - 0.5, F.lit(0.5))), 6)).alias("boost"))


def score_items(items: DataFrame, config: Config = Config()) -> DataFrame:
    """Items with context, interest, keyword, semantic, quality, boosts and age_hours to score, axes and relevant.

    Extract, calibrate, count confirmed axes, combine, damp the quality, add boosts, gate with the ceiling last, cap.
    """
    context, interest = sigmoid(F.col("context"), config.center), sigmoid(F.col("interest"), config.center)
    keyword, semantic = F.col("keyword"), F.coalesce(F.col("semantic"), F.lit(0.0))
    out = items.withColumn("axes", (context >= config.context_axis).cast("int") + ((interest >= config.interest_axis) | (keyword >= config.keyword_axis)).cast("int") + (semantic >= 0.1).cast("int") + (F.col("boosts") >= 0.2).cast("int"))
    w = F.least(0.15 + 0.40 * context, F.lit(0.55))
    both = (w * context + (1 - w) * (0.55 * interest + 0.45 * keyword)) * (1 + semantic)
    only_interest = (0.45 * interest + 0.35 * keyword) * (1 + 1.2 * semantic)
    base = F.when((context > 0) & ((interest > 0) | (keyword > 0)), both).when((interest > 0) | (keyword > 0), only_interest).when(context > 0, context * (1 + semantic)).otherwise(F.greatest(F.lit(0.0), F.least(2 * semantic, F.lit(1.0))))
    damped = base * (1 + (F.col("quality") - 1) * config.quality_damping) * freshness(F.col("age_hours"))
    boosted = damped + F.greatest(F.lit(config.boost_low), F.least(F.col("boosts"), F.lit(config.boost_high)))
    gated = F.least(boosted * gate(F.col("axes"), config, 0), gate(F.col("axes"), config, 1))
    score = F.round(F.greatest(F.lit(0.0), F.least(gated, F.lit(config.most))), 6)
    return out.withColumn("score", score).withColumn("relevant", (F.col("score") >= config.relevant) & (F.col("axes") >= 2))
