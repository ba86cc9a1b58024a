"""Streams with timers over small batches: one file a batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.plans.streams import state_store
from siftwell.streaming import jobs, windows

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp, kind string, failed boolean"


def batches(spark, tmp_path, *rows):
    """A stream of one batch for each list of (key, minutes, kind)."""
    for at, batch in enumerate(rows):
        data = [(n, k, START + datetime.timedelta(minutes=m), kind, kind == "bad") for n, (k, m, kind) in enumerate(batch)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{at}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")


def run(spark, tmp_path, stream, mode="append"):
    with state_store(spark):
        if mode == "append":
            return jobs.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state").collect()
        rows = []
        jobs.run_each_batch(stream, f"{tmp_path}/state", lambda df, n: rows.extend((n, *r) for r in df.collect()), mode)
        return rows


def minutes(ms):
    return (ms - int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000)) // 60_000


def test_windows_open_merge_act_and_expire(spark, tmp_path):
    first = [("a", 0, "opens"), ("a", 10, "opens"), ("b", 5, "opens"), ("c", 1, "acts"), (None, 1, "opens"), ("d", 2, "other")]
    second = [("a", 30, "acts"), ("a", 40, "opens"), ("b", 59, "opens"), ("b", 70, "opens")]
    stream = batches(spark, tmp_path, first, second, [("z", 400, "opens")])
    got = run(spark, tmp_path, windows.decision_windows(stream, "key", "ts", F.col("kind") == "opens", F.col("kind") == "acts", 1))
    assert sorted((r.key, r.status, minutes(r.opened_ms), minutes(r.ended_ms), r.merged) for r in got) == [("a", "acted", 0, 30, 1), ("a", "expired", 40, 100, 0), ("b", "expired", 5, 65, 1), ("b", "expired", 70, 130, 0)]


def test_changes_are_flushed_after_quiet(spark, tmp_path):
    stream = batches(spark, tmp_path, [("x", 0, "created"), ("y", 1, "created"), ("z", 2, "created"), (None, 2, "created"), ("x", 3, "deleted")], [("y", 4, "changed")], [("later", 60, "created")], [("last", 200, "created")])
    got = run(spark, tmp_path, windows.debounced_paths(stream, "key", "ts", "kind", 10 * 60_000, most=2, groups=1))
    assert sorted((str(r.path), r.kind, r.changes, r.dropped) for r in got) == sorted([("x", "deleted", 2, 0), ("y", "changed", 2, 0), ("None", "dropped", 0, 1), ("later", "created", 1, 0)])


@pytest.mark.parametrize("opens_at", [3])
def test_breakers_reset(spark, tmp_path, opens_at):
    stream = batches(spark, tmp_path, [("a", 0, "bad"), ("a", 1, "bad"), ("b", 1, "bad"), ("b", 2, "good")], [("a", 2, "bad"), ("b", 3, "bad")], [("b", 30, "good")], [("b", 31, "good")], [("a", 32, "bad")])
    rows = run(spark, tmp_path, windows.resetting_breakers(stream, "key", "ts", "failed", opens_at, 10), "update")
    states = [(key, n, is_open, minutes(at)) for _, key, n, is_open, at in rows]
    assert [s for s in states if s[0] == "a"] == [("a", 2, False, 1), ("a", 3, True, 2), ("a", 0, False, 12), ("a", 1, False, 32)]
    assert [s for s in states if s[0] == "b"] == [("b", 0, False, 2), ("b", 1, False, 3), ("b", 0, False, 30), ("b", 0, False, 31)]


def test_pending_changes_ask_the_store_once_a_batch():
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.value = {}

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                return {"exists": lambda: None in self.value, "get": lambda: self.value[None], "update": lambda v: self.value.update({None: v}), "clear": self.value.clear, "iterator": lambda: iter(list(self.value.items())), "updateValue": lambda k, v: self.value.update({k: v}), "containsKey": lambda k: k in self.value, "getValue": lambda k: self.value[k]}[name](*a)

            return call

    class Handle:
        getMapState = getValueState = lambda self, *a: State()
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")

    part = pd.DataFrame({"path": [f"p{n % 3}" for n in range(500)], "at": [pd.Timestamp(START) + pd.Timedelta(minutes=n // 2) for n in range(500)], "kind": "changed"})
    job = windows._Pending(0, 10)
    job.init(Handle())
    got = pd.concat([out for half in (part[:250], part[250:]) for out in job.handleInputRows((0,), iter([half]), None)])
    assert len(calls) < 25
    assert len(got) == 499 and set(got.changes) == {1} and got.dropped.sum() == 0
