"""Sinks: merges by key, retention, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import redact_fields


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_first: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with new ones merged in by key: new values win, except where `keep_old_first` names the column, or where
    `fill` names it and the new value is null. Both sides have one row a key."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    there = F.col(f"n.{keys[0]}").isNotNull()
    out: list[Column] = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        out.append((F.coalesce(a, b) if c in keys or c in keep_old_first else F.coalesce(b, a) if c in fill else F.when(there, b).otherwise(a)).alias(c))
    return o.join(n, on, "full").select(*out)


def split_known(fetched: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fetched rows that are new, and those that are cached."""
    return fetched.join(cached, keys, "left_anti"), fetched.join(cached, keys, "left_semi")


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def prune_noise(items: DataFrame, score: str, ts: str, key: str, threshold: float, before: Column, most: int) -> DataFrame:
    """Items without the `most` worst and oldest of those below the threshold and older than `before`."""
    worst = items.where((F.col(score) < threshold) & (F.col(ts) < before)).orderBy(score, ts, key).limit(most)
    return items.join(worst.select(key), key, "left_anti")


def next_version(renders: DataFrame, key: str, version: str) -> DataFrame:
    return renders.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def export_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, secret-like fields redacted."""
    df.select(redact_fields(F.to_json(F.struct("*"))).alias("value")).write.text(path)


def export_csv(df: DataFrame, path: str, secret: tuple[str, ...] = ()) -> None:
    shown = [F.lit("[REDACTED]").alias(c) if c in secret else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.option("header", "true").csv(path)
