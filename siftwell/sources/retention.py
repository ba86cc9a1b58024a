"""Retention over related tables: what is too old goes, and what refers to it; written beside and swapped by a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What one table keeps. `keep`: rows for which it is true or null. `last`: only so many of them, newest first by
    `order`. `refers`: (column, table, its key), rows whose column names no kept row of that table go; nulls stay."""

    table: str
    keep: Column | None = None
    last: int | None = None
    order: tuple[Column, ...] = ()
    refers: tuple[tuple[str, str, str], ...] = ()


def retained(tables: dict[str, DataFrame], rules: list[Rule]) -> dict[str, DataFrame]:
    """The tables after the rules, in the order given, each referring only to tables before it.

    Tables without a rule stay as they are. Applied again with the same reference time nothing more goes.
    """
    out = dict(tables)
    for rule in rules:
        rows = out[rule.table]
        if rule.keep is not None:
            rows = rows.where(F.coalesce(rule.keep, F.lit(True)))
        if rule.last is not None:
            rows = rows.orderBy(*rule.order).limit(rule.last)  # so many rows of every task meet, never the table
        for column, other, key in rule.refers:
            there = out[other].select(F.col(key).alias("_key")).distinct()
            rows = rows.join(there, F.col(column) == F.col("_key"), "left_semi").unionByName(rows.where(F.col(column).isNull()))
        out[rule.table] = rows
    return out


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """Table names to their folders by the newest manifest under `root`; empty without one."""
    folder, fs = _path(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    if not names:
        return {}
    lines = spark.read.text(f"{root}/manifests/{names[-1]}").collect()  # one line
    return json.loads(lines[0].value)


def swap(spark: SparkSession, root: str, version: int, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Write tables beside those that are there and make them current by one manifest, the last step.

    Readers see all tables of a version or none. A run that was cut off leaves folders that no manifest names; repeated
    with its version it writes them again. A version whose manifest is there is not written twice.
    """
    manifest, fs = _path(spark, f"{root}/manifests/{version:012d}.json")
    if fs.exists(manifest):
        return current(spark, root)
    folders = {name: f"{root}/{name}/version={version}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(folders[name])
    named = current(spark, root) | folders
    spark.range(1).select(F.lit(json.dumps(named)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{root}/manifests/.{version}")
    part = next(s.getPath() for s in fs.listStatus(_path(spark, f"{root}/manifests/.{version}")[0]) if s.getPath().getName().startswith("part-"))
    if not fs.rename(part, manifest):
        raise RuntimeError(f"manifest {version} could not be put in place")
    return named

