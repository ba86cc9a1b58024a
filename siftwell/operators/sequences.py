"""Sessions, streaks, intervals and other patterns of ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.numeric import hours, micros


def gap_sessions(events: DataFrame, key: str, ts: str, order: str, gap_minutes: int) -> DataFrame:
    """Events with `session`, numbered from 0 for the newest of a key; a gap of more than the minutes parts two."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order))
    apart = micros(F.lag(ts).over(w)) - micros(F.col(ts))
    opened = events.withColumn("_new", F.when(apart > gap_minutes * 60_000_000, 1).otherwise(0))
    return opened.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_windows(events: DataFrame, keys: list[str], ts: str, minutes: int) -> DataFrame:
    """Events of a key merged while each comes within the minutes of the one before: first, last and number."""
    merged = events.groupBy(*keys, F.session_window(ts, f"{minutes} minutes").alias("w"))
    return merged.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("w")


def streaks(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Runs of days in a row with an event: key, first day, length."""
    days = events.select(key, F.to_date(ts).alias("day")).distinct()
    island = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return days.withColumn("_island", island).groupBy(key, "_island").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).drop("_island")


def intervals(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Hours since the event before of the same key, and the interval's number."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return events.withColumn("interval", hours(F.col(ts), F.lag(ts).over(w))).withColumn("idx", F.row_number().over(w) - 1)


def chain_shape(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Links, acceleration (slope of intervals over their number), mean and regularity confidence of each key's chain."""
    each = intervals(events, key, ts, order)
    out = each.groupBy(key).agg(F.count("*").alias("links"), F.regr_slope("interval", "idx").alias("slope"), F.avg("interval").alias("mean"), F.stddev_pop("interval").alias("sd"))
    variation = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1.0)
    regular = F.least(0.6 * F.least(F.col("links") / 6, F.lit(1.0)) + 0.4 * F.greatest(1 - variation, F.lit(0.0)), F.lit(0.85))
    phase = F.when(F.col("links") < 3, "nascent").when(F.col("slope") < 0, "accelerating").when(F.col("mean") > 72, "fading").otherwise("steady")
    return out.withColumn("confidence", regular).withColumn("phase", phase).drop("sd")


def carried_back(firsts: DataFrame, key: str, stretch: str, value: str, name: str) -> DataFrame:
    """For each key and stretch the least value of the stretches after it; firsts has one row a key and stretch."""
    later = Window.partitionBy(key).orderBy(F.desc(stretch)).rowsBetween(Window.unboundedPreceding, -1)
    return firsts.select(key, stretch, F.min(value).over(later).alias(name))


def first_after(windows: DataFrame, incidents: DataFrame, key: str, opened: str, ts: str, id_col: str, stretch_hours: int = 24) -> DataFrame:
    """Forward as-of join: each window with the earliest later incident of its key, or null; no pair of rows is made.

    A key is cut into stretches of time. Within a stretch both sides go through one ordered pass from the newest row back;
    a window with no incident left in its stretch takes the first of the stretches after it, of which a key has as many as it
    has stretches. So a key with very many rows is many tasks. Null keys and times meet nothing.
    """
    names, incident = windows.columns, F.struct(F.col(ts).alias("incident_ts"), F.col(id_col).alias("incident_id"))
    left = windows.withColumn("_at", micros(F.col(opened))).withColumn("_window", F.lit(True))
    right = incidents.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, micros(F.col(ts)).alias("_at"), F.lit(False).alias("_window"), incident.alias("_incident"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_stretch", F.floor(F.col("_at") / (stretch_hours * 3_600_000_000)))
    later = Window.partitionBy(key, "_stretch").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("_first", F.when(F.col("_at").isNotNull(), F.min("_incident").over(later))).where("_window")
    after = carried_back(both.groupBy(key, "_stretch").agg(F.min("_incident").alias("_least")), key, "_stretch", "_least", "_after").where("_after is not null and _stretch is not null")
    out = within.join(after, [key, "_stretch"], "left").withColumn("_first", F.coalesce("_first", "_after"))
    return out.select(*names, "_first.incident_id", "_first.incident_ts")


def breaker_states(events: DataFrame, key: str, ts: str, order: str, failed: str, opens_at: int = 5, reset_minutes: int = 10) -> DataFrame:
    """Circuit breaker of each key at its newest event: failures since the last success, and whether it is still open."""
    w = Window.partitionBy(key).orderBy(ts, order)
    runs = events.withColumn("_run", F.sum(F.when(~F.col(failed), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = runs.groupBy(key).agg(F.max("_run").alias("_last"), F.max(ts).alias("now"))
    tail = runs.where(failed).join(last, key).where("_run = _last").groupBy(key).agg(F.count("*").alias("failures"), F.max(ts).alias("last_failure"))
    out = last.join(tail, key, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    recent = micros(F.col("now")) - micros(F.col("last_failure")) < reset_minutes * 60_000_000
    return out.select(key, "failures", F.coalesce((F.col("failures") >= opens_at) & recent, F.lit(False)).alias("is_open"))
