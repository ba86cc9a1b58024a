"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.plans import content, feeds, links, quality, search, selections, streams, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (content, feeds, links, quality, search, selections, streams, texts)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hybrid search, fused from full text and nearest vectors."""
    return texts.hybrid_search(spark, sf_dir)
