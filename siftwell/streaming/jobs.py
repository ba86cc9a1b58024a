"""The stateful parts on Structured Streaming: sessions, debounce, duplicates, breakers, standing queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.retrieval import match_standing


def events_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def debounced(changes: DataFrame, key: str, ts: str, quiet: str, late: str = "1 hour") -> DataFrame:
    """The last change of each key once it has been quiet for the time."""
    w = changes.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet).alias("w"))
    return w.agg(F.max_by("event_type", ts).alias("last_type"), F.max(ts).alias("last_ts"), F.count("*").alias("changes")).select(key, "last_type", "last_ts", "changes")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(key, "n", "first_ts", "last_ts")


def daily(events: DataFrame, group: str, ts: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(group, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(group, F.to_date("w.start").alias("day"), "n")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def standing_matches(items: DataFrame, standing: DataFrame, text_col: str) -> DataFrame:
    return match_standing(items, standing, text_col)


def breakers(events: DataFrame, key: str, ts: str, failed: str, opens_at: int = 5) -> DataFrame:
    """Failures in a row of each key after each batch: key, failures, is_open."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for part in parts:
            for bad in part.sort_values(ts)[failed]:
                n = n + 1 if bad else 0
        state.update((n,))
        yield pd.DataFrame({key: [group[0]], "failures": [n], "is_open": [n >= opens_at]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, failures long, is_open boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over what has come since the last run, append to Parquet, and return the table so far."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_each_batch(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Run over what has come, giving each batch and its number to an idempotent sink."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
