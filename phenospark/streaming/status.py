"""The status of jobs as state of a stream: legal steps only, in order of time, and none stuck forever."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from phenospark.operators import store

#: The statuses of an analysis and where each may lead; "" is where a job has none yet.
STEPS: dict[str, tuple[str, ...]] = {"": ("processing",), "processing": ("complete", "failed")}
COLUMNS = ["key", "status", "micros", "place", "accepted", "reason", "now"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Machine(StatefulProcessor):
    """Goes through the jobs of a shard at once; each has its own entry in the state, read and written only if it has events."""

    def __init__(self, key: str, steps: Mapping[str, tuple[str, ...]], waiting: tuple[str, ...], stuck: str, after_ms: int | None):
        self.key, self.steps, self.waiting, self.stuck, self.after_ms = key, {k: set(v) for k, v in steps.items()}, set(waiting), stuck, after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getMapState("now", self.key, "status string, micros long, place long")
        self.due = handle.getMapState("due", self.key, "at long")  # of waiting jobs, in ms

    def _timer(self, at: int | None) -> None:
        """One timer a shard, at ``at`` or before it."""
        there = list(self.handle.listTimers())
        if at is not None and (not there or at < min(there)):
            for t in there:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        code, keys = pd.factorize(got["key"], use_na_sentinel=False)
        order = np.lexsort((got["place"], got["micros"], code))
        got, code = got.iloc[order], code[order]
        keys, known, waits = keys.tolist(), self.now.exists(), self.after_ms is not None and self.due.exists()
        reasons, states, first = [], [], None
        events = zip(code.tolist(), got["status"].tolist(), got["micros"].tolist(), got["place"].tolist())
        for c, of_job in itertools.groupby(events, key=lambda e: e[0]):
            job = (keys[c],)
            held = self.now.getValue(job) if known else None
            held = tuple(held) if held else ("", None, None)
            status, last = held[0], None if held[1] is None else held[1:]
            for _, s, *step in of_job:
                if last is not None and tuple(step) < last:
                    reasons.append("late")
                elif s not in self.steps.get(status, ()):
                    reasons.append(f"no step from {status or 'nothing'}")
                else:
                    status, last = s, tuple(step)
                    reasons.append("")
                states.append(status)
            if last is None or (status, *last) == held:
                continue
            self.now.updateValue(job, (status, *last))
            if self.after_ms is not None and status in self.waiting:
                at = last[0] // 1000 + self.after_ms
                self.due.updateValue(job, (at,))
                first = at if first is None else min(first, at)
            elif waits and held[0] in self.waiting:
                self.due.removeKey(job)
        self._timer(first)
        yield got.assign(accepted=[not r for r in reasons], reason=reasons, now=states)[COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        out, first = [], None
        for job, (at,) in list(self.due.iterator()):
            if at > until:
                first = at if first is None else min(first, at)
                continue
            status, _, place = self.now.getValue(job)
            self.now.updateValue(job, (self.stuck, at * 1000, place))
            self.due.removeKey(job)
            out.append((job[0], self.stuck, at * 1000, place, True, f"stuck in {status}", self.stuck))
        if first is not None:
            self.handle.registerTimer(first)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def machine(
    events: DataFrame, key: str, status: str, at: str, place: Column, steps: Mapping[str, tuple[str, ...]] = STEPS,
    waiting: tuple[str, ...] = ("processing",), stuck: str = "failed", after: timedelta | None = None, late: str = "1 hour", shards: int = 1024,
) -> DataFrame:
    """A row for each event of the stream: ``key, status, at, place, accepted, reason, now``.

    An event is accepted if ``steps`` lead from the job's status to its own; ``now`` is the status
    after it. Events of a batch are taken by (``at``, ``place``); one that is before the job's last
    accepted event is late and changes nothing, so all orders of arrival end alike where every step is
    legal. A job whose status is one of ``waiting`` for longer than ``after``, by the stream's
    watermark, gets the status ``stuck``, with a row that says so. Events without a key or a time are
    left out. The session must use the RocksDB state store (STORE).

    Python is called for each of so many ``shards`` of the jobs, not for each job; a shard's events of
    one batch, and all events of a job, are in memory together. A checkpoint keeps its number of shards.
    """
    rows = events.select(F.col(key).alias("key"), F.coalesce(F.col(status), F.lit("")).alias("status"), F.col(at).cast("timestamp").alias("at"), F.coalesce(place.cast("long"), F.lit(0)).alias("place"))
    rows = rows.filter("key is not null and at is not null").withWatermark("at", late)
    rows = rows.withColumn("micros", F.unix_micros("at")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, status string, micros long, place long, accepted boolean, reason string, now string"
    after_ms = None if after is None else int(after.total_seconds() * 1000)
    log = rows.groupBy("shard").transformWithStateInPandas(_Machine(f"key {kind}", steps, waiting, stuck, after_ms), schema, "Append", "EventTime")
    return log.select("key", "status", F.timestamp_micros("micros").alias("at"), "place", "accepted", "reason", "now")


def run(log: DataFrame, path: str, checkpoint: str) -> None:
    """Append what machine() says of the events there are now to Parquet at ``path``; goes on after a restart."""
    spark = log.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def current(log: DataFrame) -> DataFrame:
    """``key, status, at, place`` of each job from the log of machine()."""
    order = [F.col("at"), F.col("place"), F.col("reason") != ""]
    return store.latest(log.filter("accepted"), "key", order, ["status", "at", "place"])
