"""Keyed state with timers: decision windows, debounced changes with a bound on keys, breakers that reset."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several variables and timers for a key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


class _Windows(StatefulProcessor):
    """One open window a key; times are milliseconds since 1970 in UTC."""

    def __init__(self, key: str, life_ms: int):
        self.key, self.life = key, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, merged long")

    def _row(self, key, status: str, opened: int, ended: int, merged: int) -> dict:
        return {self.key: key, "status": status, "opened_ms": opened, "ended_ms": ended, "merged": merged}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, merged = self.window.get() if self.window.exists() else (None, 0)
        before, out = opened, []
        part = pd.concat(list(rows)).sort_values(["at", "signal"])
        for at, signal in zip(part["at"], part["signal"], strict=True):
            now = _millis(at)
            if opened is not None and now >= opened + self.life:
                out.append(self._row(key[0], "expired", opened, opened + self.life, merged))
                opened = None
            if signal == "acts" and opened is not None:
                out.append(self._row(key[0], "acted", opened, now, merged))
                opened = None
            elif signal == "opens":
                opened, merged = (now, 0) if opened is None else (opened, merged + 1)
        if before is not None and before != opened:
            self.handle.deleteTimer(before + self.life)
        if opened is None:
            self.window.clear()
        else:
            self.window.update((opened, merged))
            if before != opened:
                self.handle.registerTimer(opened + self.life)
        yield pd.DataFrame(out, columns=[self.key, "status", "opened_ms", "ended_ms", "merged"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists():
            opened, merged = self.window.get()
            if opened + self.life <= expiredTimerInfo.getExpiryTimeInMs():
                self.window.clear()
                yield pd.DataFrame([self._row(key[0], "expired", opened, opened + self.life, merged)])

    def close(self) -> None:
        pass


def decision_windows(events: DataFrame, key: str, ts: str, opens: Column, acts: Column, life_hours: int, late: str = "0 seconds") -> DataFrame:
    """Windows that have ended, one row each: key, status (acted or expired), opened_ms, ended_ms, merged.

    An event that `opens` opens its key's window, or is merged into the one that is open; one that `acts` ends it; after
    its life it expires, by the next event of its key or by a timer once the watermark is past. Null keys and times have no
    part; of equal times acts come first. State is one row for each key with an open window.
    """
    signal = F.when(F.coalesce(acts, F.lit(False)), "acts").when(F.coalesce(opens, F.lit(False)), "opens")
    live = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), signal.alias("signal")).where("signal is not null").withWatermark("at", late)
    schema = f"{key} {dict(events.dtypes)[key]}, status string, opened_ms long, ended_ms long, merged long"
    return live.groupBy("key").transformWithStateInPandas(_Windows(key, life_hours * 3_600_000), schema, "append", "EventTime")


class _Pending(StatefulProcessor):
    """The last change of each path of one group; flushed together after a quiet time."""

    def __init__(self, quiet_ms: int, most: int):
        self.quiet, self.most = quiet_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "kind string, at long, changes long")
        self.timer = handle.getValueState("timer", "at long, paths long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, paths, dropped = self.timer.get() if self.timer.exists() else (None, 0, 0)
        # the store is read and written once a batch and not for each row; the bound holds for what is read too
        held = self._held() if paths else {}
        due, out = timer, []
        part = pd.concat(list(rows)).sort_values("at", kind="stable")
        times = part["at"].astype("datetime64[ms]").astype("int64").tolist()
        for path, now, kind in zip(part["path"].tolist(), times, part["kind"].tolist(), strict=True):
            if due is not None and now >= due:  # it has been quiet, though the watermark does not tell yet
                out += self._flushed(held, due, dropped)
                held, dropped = {}, 0
            due = now + self.quiet
            if path in held:
                held[path] = (kind, now, held[path][2] + 1)
            elif len(held) < self.most:
                held[path] = (kind, now, 1)
            else:
                dropped += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.pending.clear()
        for path, value in held.items():
            self.pending.updateValue((path,), value)
        self.timer.update((due, len(held), dropped))
        yield pd.DataFrame(out, columns=["path", "kind", "at_ms", "changes", "dropped"])

    def _held(self) -> dict[str, tuple]:
        return {path[0]: tuple(value) for path, value in self.pending.iterator()}

    def _flushed(self, held: dict[str, tuple], at: int, dropped: int) -> list[tuple]:
        return [(path, kind, when, n, 0) for path, (kind, when, n) in held.items()] + ([(None, "dropped", at, 0, dropped)] if dropped else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._flushed(self._held(), expiredTimerInfo.getExpiryTimeInMs(), self.timer.get()[2] if self.timer.exists() else 0)
        self.pending.clear()
        self.timer.clear()
        yield pd.DataFrame(out, columns=["path", "kind", "at_ms", "changes", "dropped"])

    def close(self) -> None:
        pass


def debounced_paths(changes: DataFrame, path: str, ts: str, kind: str, quiet_ms: int, most: int = 10_000, groups: int = 16, late: str = "0 seconds") -> DataFrame:
    """The last change of each path once its group of paths has been quiet: path, kind, at_ms, changes, dropped.

    Paths are dealt into groups by hash, each with its share of the bound `most`. A change of a path beyond the bound is
    not kept but counted; a row with a null path has the count with the next flush. Null paths and times have no part.
    """
    live = changes.where(F.col(path).isNotNull() & F.col(ts).isNotNull()).select(F.pmod(F.xxhash64(path), F.lit(groups)).cast("int").alias("part"), F.col(path).alias("path"), F.col(ts).cast("timestamp").alias("at"), F.col(kind).alias("kind")).withWatermark("at", late)
    schema = "path string, kind string, at_ms long, changes long, dropped long"
    return live.groupBy("part").transformWithStateInPandas(_Pending(quiet_ms, max(1, most // groups)), schema, "append", "EventTime")


class _Breaker(StatefulProcessor):
    """Failures in a row and the time of the last event; an open breaker starts anew after the cooldown."""

    def __init__(self, key: str, opens_at: int, cooldown_ms: int):
        self.key, self.opens_at, self.cooldown = key, opens_at, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "n long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, at = self.state.get() if self.state.exists() else (0, 0)
        opened = n >= self.opens_at
        part = pd.concat(list(rows)).sort_values("at")
        times = part["at"].astype("datetime64[ms]").astype("int64").values
        for now, bad in zip(times.tolist(), part["failed"].tolist(), strict=True):
            if n >= self.opens_at and now >= at + self.cooldown:
                n = 0
            n, at = (n + 1 if bad else 0), now
        if opened:
            self.handle.deleteTimer(self.state.get()[1] + self.cooldown)
        self.state.update((n, at))
        if n >= self.opens_at:
            self.handle.registerTimer(at + self.cooldown)
        yield pd.DataFrame({self.key: [key[0]], "failures": [n], "is_open": [n >= self.opens_at], "at_ms": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "failures": [0], "is_open": [False], "at_ms": [at]})

    def close(self) -> None:
        pass


def resetting_breakers(events: DataFrame, key: str, ts: str, failed: str, opens_at: int = 5, cooldown_minutes: int = 10, late: str = "0 seconds") -> DataFrame:
    """After each batch the state of each key that it has: key, failures in a row, is_open, at_ms; and, once the watermark
    is past the cooldown of an open breaker, that it is closed again. Null keys and times have no part."""
    live = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), F.coalesce(F.col(failed), F.lit(False)).alias("failed")).withWatermark("at", late)
    schema = f"{key} {dict(events.dtypes)[key]}, failures long, is_open boolean, at_ms long"
    return live.groupBy("key").transformWithStateInPandas(_Breaker(key, opens_at, cooldown_minutes * 60_000), schema, "update", "EventTime")
