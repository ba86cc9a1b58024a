"""Top rows of groups, diversity, quotas and blended ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, overall: int | None = None) -> DataFrame:
    """The first n rows of each group in an order that must end in a unique key; then the first `overall` of all."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
    return ranked if overall is None else ranked.orderBy(*order).limit(overall)


def blended_rank(df: DataFrame, group: str, score: str, key: str, weight: float = 0.8, least: int = 3) -> DataFrame:
    """score becomes weight*score + (1-weight)*rank/n within groups of at least `least` rows; others stay."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(score, key))
    n = F.count("*").over(w)
    return df.withColumn("blended", F.when(n >= least, weight * F.col(score) + (1 - weight) * rank / n).otherwise(F.col(score)))


def position_decay(df: DataFrame, group: str, score: str, key: str, decay: float = 0.55, floor: float = 0.15) -> DataFrame:
    """The k-th row of a group by score keeps (1-floor)*decay^k + floor of it, k counted from 0."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)) - 1
    return df.withColumn("position", k).withColumn("decayed", F.col(score) * ((1 - floor) * F.pow(F.lit(decay), F.col("position")) + floor))


def repeat_decay(df: DataFrame, keys: list[str], score: str, key: str, factor: float = 0.85, free: int = 2) -> DataFrame:
    """Beyond `free` rows of a key, the n-th keeps factor^(n-free) of its score."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), key))
    return df.withColumn("repeat", n).withColumn("decayed", F.when(F.col("repeat") > free, F.col(score) * F.pow(F.lit(factor), F.col("repeat") - free)).otherwise(F.col(score)))


def with_quotas(df: DataFrame, bucket: str, score: str, key: str, quotas: dict[str, int], total: int) -> DataFrame:
    """Top `total` rows of which each bucket gets its quota where it has as many; the rest goes by score."""
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc(score), key))
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(bucket) == name, F.lit(n)).otherwise(quota)
    few = df.withColumn("in_bucket", within).where(F.col("in_bucket") <= total)
    return few.withColumn("in_quota", F.col("in_bucket") <= quota).orderBy(F.desc("in_quota"), F.desc(score), key).limit(total)


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order."""
    return newest_per_group(df, keys, order, 1)
