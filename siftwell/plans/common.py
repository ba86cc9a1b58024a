"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.numeric import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newest(spark: SparkSession, sf_dir: str) -> Column:
    """The reference time: the newest event, so that results do not depend on the clock."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])


def stamp(ts: str) -> Column:
    """Microseconds since 1970 as a long."""
    return micros(F.col(ts))
