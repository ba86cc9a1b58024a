"""Registered queries that run as streams over what is there."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.staging import shared_dir
from siftwell.plans.common import table
from siftwell.streaming import jobs, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the streams started inside."""
    name, value = windows.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(spark: SparkSession, d: str, job, mode: str = "append") -> DataFrame:
    """Run a job over the events as a stream and return what it has written."""
    source = jobs.events_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    with state_store(spark):
        return jobs.run_available(job(source), f"{work}/out", f"{work}/state", mode)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS acts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error', event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS opened, 0::BIGINT AS merged, NULL::VARCHAR AS status, NULL::BIGINT AS opened_ms, NULL::BIGINT AS ended_ms, NULL::BIGINT AS n FROM e
  UNION ALL SELECT user_id, e.i, CASE WHEN acts THEN NULL WHEN opened IS NULL OR t >= opened + 172800000 THEN t ELSE opened END, CASE WHEN acts OR opened IS NULL OR t >= opened + 172800000 THEN 0 ELSE merged + 1 END,
    CASE WHEN t >= opened + 172800000 THEN 'expired' WHEN acts AND opened IS NOT NULL THEN 'acted' END, opened, CASE WHEN t >= opened + 172800000 THEN opened + 172800000 ELSE t END, merged FROM w JOIN e USING (user_id) WHERE e.i = w.i + 1),
z AS (SELECT user_id, max(i) AS i FROM e GROUP BY 1)
SELECT user_id, status, opened_ms, ended_ms, n AS merged FROM w WHERE status IS NOT NULL
UNION ALL SELECT user_id, 'expired', opened, opened + 172800000, merged FROM w JOIN z USING (user_id, i) WHERE opened + 172800000 <= (SELECT max(t) FROM e)""")
def decision_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return run(spark, d, lambda s: windows.decision_windows(s, "user_id", "ts", kind == "error", kind == "purchase", 48))


@query("""WITH b AS (SELECT user_id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1) SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS day, count(*) AS users FROM b GROUP BY 1""")
def last_seen_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The days on which users were last seen, from the last change of each user."""
    job = lambda s: windows.debounced_paths(s.withColumn("path", F.col("user_id").cast("string")), "path", "ts", "event_type", 0)
    got = run(spark, d, job).where("path is not null")
    return got.groupBy("path").agg(F.max("at_ms").alias("at_ms")).select(F.to_date(F.timestamp_millis("at_ms")).cast("string").alias("day")).groupBy("day").agg(F.count("*").alias("users"))
