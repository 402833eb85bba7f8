"""Streams whose answers need state and timers: caches with a time to live, rate limits, bursts.

All three keep rows of a key until the watermark has passed them, and take them in by
event time then, so the answers do not depend on the order or the batches in which rows
arrive, as long as they are not later than ``late``.  An event-time timer per key wakes
the key when its next row is due, and again when what it holds has run out, so a quiet
key holds no state.  Each answer is the batch functions' (``store.cached``,
``changes.rate_in_window``, ``changes.debounced``); rows at the end of a stream wait until
a later row of any key moves the watermark on.

State lives in RocksDB, which ``rocksdb`` sets for a session; a key's waiting rows are a
list state, what it holds is one value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a step gets (held, rows of one moment: at in microseconds, id, kind) and gives (held, answers, moment to wake at).
Step = Callable[[object, int, list[tuple[str, str]]], tuple[object, list[tuple], int | None]]


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which these processors need; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Feeds a key's rows to ``step`` by event time, once the watermark has passed them.

    ``idle(held, now)`` is asked when a timer rings with nothing due: it gives the held
    value, answers and the next moment to wake at, as a step does.
    """

    def __init__(self, step: Step, idle: Callable, columns: list[str]):
        self.step, self.idle, self.columns = step, idle, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string, kind string")
        self.held = handle.getValueState("held", "value string, wake long")

    def _arm(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            told = [(int(a), None if i is None else str(i), None if k is None else str(k)) for a, i, k in zip(frame["at"], frame["id"], frame["kind"], strict=True)]
            self.waiting.appendList(told)
            least = min(t[0] for t in told)
            first = least if first is None else min(first, least)
        if first is not None:
            self._arm(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All rows before the watermark are there; whatever is due by now is taken in at the first ring.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held, wake = None, None
        if self.held.exists():
            value, wake = self.held.get()
            held = json.loads(value)
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, later = sorted(r for r in map(tuple, rows) if r[0] < until), [tuple(r) for r in rows if r[0] >= until]
        answers: list[tuple] = []
        k = 0
        while k < len(due):
            at, n = due[k][0], k
            while n < len(due) and due[n][0] == at:
                n += 1
            if wake is not None and wake < at:  # what was held has run out before
                held, told, wake = self.idle(held, at)
                answers += told
            held, told, wake = self.step(held, at, [r[1:] for r in due[k:n]])
            answers += told
            k = n
        if wake is not None and wake < until:
            held, told, wake = self.idle(held, until)
            answers += told
        if due:
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
        if held is None:
            self.held.clear()
        else:
            self.held.update((json.dumps(held), wake if wake is not None else -1))
        nexts = [r[0] for r in later] + ([wake] if wake is not None else [])
        if nexts:
            self._arm(max(min(nexts), until))
        if answers:
            yield pd.DataFrame([(key[0], *a) for a in answers], columns=self.columns)


def _run(rows: DataFrame, step: Step, idle: Callable, schema: str, late: str) -> DataFrame:
    """rows: key string, time timestamp, id, kind."""
    timed = rows.withWatermark("time", late).select("key", "time", F.unix_micros("time").alias("at"), F.col("id").cast("string").alias("id"), F.col("kind").cast("string").alias("kind"))
    columns = [c.split()[0] for c in schema.split(", ")]
    return timed.groupBy("key").transformWithStateInPandas(InOrder(step, idle, columns), schema, "append", "eventTime")


def _timed(events: DataFrame, key: str, ts: str, id_column: str, kind) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("time"), F.col(id_column).alias("id"), kind.alias("kind"))


def cached(events: DataFrame, is_put, ttl_seconds: float, key: str = "key", ts: str = "ts", id_column: str = "id", late: str = "10 minutes") -> DataFrame:
    """key, id and hit of every event that is no put: whether the key's last put is at most ``ttl_seconds`` old.

    A key holds the time of its last put, and drops it when it has run out.  Puts come
    before requests of the same moment.
    """
    ttl = round(ttl_seconds * 1_000_000)

    def step(held, at, rows):
        if any(kind == "put" for _, kind in rows):
            held = at
        hit = held is not None and at - held <= ttl
        return held if hit else None, [(i, hit) for i, kind in rows if kind != "put"], held + ttl if hit else None

    def idle(held, now):
        return None, [], None

    return _run(_timed(events, key, ts, id_column, F.when(is_put, "put").otherwise("ask")), step, idle, "key string, id string, hit boolean", late)


def recent_calls(events: DataFrame, period_seconds: float, key: str = "key", ts: str = "ts", id_column: str = "id", late: str = "10 minutes") -> DataFrame:
    """key, id and recent of every call: how many calls of the key fall into the period that ends with it.  A key holds the period's times."""
    period = round(period_seconds * 1_000_000)

    def step(held, at, rows):
        times = [t for t in held or [] if t > at - period] + [at] * len(rows)
        return times, [(i, len(times)) for i, _ in rows], at + period

    def idle(held, now):
        return None, [], None

    return _run(_timed(events, key, ts, id_column, F.lit("call")), step, idle, "key string, id string, recent long", late)


def limited(events: DataFrame, most: int, period_seconds: float, key: str = "key", ts: str = "ts", id_column: str = "id", late: str = "10 minutes") -> DataFrame:
    """key, id and allowed of every call: at most ``most`` accepted ones in any trailing period; refused ones do not count.

    Calls of one moment are taken by id.  A key holds at most ``most`` times.
    """
    period = round(period_seconds * 1_000_000)

    def step(held, at, rows):
        times, answers = [t for t in held or [] if t > at - period], []
        for i, _ in rows:
            answers.append((i, len(times) < most))
            if answers[-1][1]:
                times.append(at)
        return times or None, answers, max(times) + period if times else None

    def idle(held, now):
        return None, [], None

    return _run(_timed(events, key, ts, id_column, F.lit("call")), step, idle, "key string, id string, allowed boolean", late)


def bursts(changes: DataFrame, gap_seconds: float, path: str = "path", ts: str = "ts", kind: str = "change_type", late: str = "10 minutes") -> DataFrame:
    """path, change_type, last and n: the last change of each run of changes with pauses of the gap at most.

    A run is answered when the gap has passed without a change; of changes at one last
    moment the greatest kind is told.
    """
    gap = round(gap_seconds * 1_000_000)

    def step(held, at, rows):
        n = held["n"] if held else 0
        return {"kind": max((k for _, k in rows if k is not None), default=None), "last": at, "n": n + len(rows)}, [], at + gap

    def idle(held, now):
        return None, [(held["kind"], held["last"], held["n"])] if held else [], None

    found = _run(_timed(changes, path, ts, kind, F.col(kind)), step, idle, "key string, change_type string, last long, n long", late)
    return found.select(F.col("key").alias("path"), "change_type", F.timestamp_micros("last").cast("timestamp_ntz").alias("last"), "n")
