"""Streams that are stopped, fail and are started again, against the batch of the same rows."""

from __future__ import annotations

import random
import uuid
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from phenospark.operators import store
from phenospark.streaming import counts, durable, status


def folder_of(spark, tmp_path, files):
    rng = random.Random(1)
    total = Counter()
    for k in range(files):
        rows = [(rng.choice("abc"), rng.choice(["x", None]), rng.randint(0, 9)) for _ in range(50)]
        for a, b, n in rows:
            total[a, b] += n
        spark.createDataFrame(rows, "a string, b string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{k}")
    return total


SCHEMA = "a string, b string, n long"


def test_sums_survive_failures_and_restarts(spark, tmp_path, monkeypatch):
    total = folder_of(spark, tmp_path, 7)
    table = durable.SumTable(f"{tmp_path}/sums", ("a", "b"), ("n",), most_batches=3)
    stream = lambda: counts.stream_folder(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema, files=1)
    add, calls = durable.SumTable.add, []

    def failing(self, rows, batch):
        """Dies after its work of batch 1 and before that of batch 4: batch 1 is run twice."""
        calls.append(batch)
        if batch == 4 and calls.count(4) == 1:
            raise RuntimeError("lost")
        add(self, rows, batch)
        if batch == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(durable.SumTable, "add", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            durable.keep(stream(), table, f"{tmp_path}/checkpoint")
    durable.keep(stream(), table, f"{tmp_path}/checkpoint")
    assert calls.count(1) == calls.count(4) == 2
    read = lambda: {(r.a, r.b): r.n for r in table.read(spark).collect()}
    assert read() == total
    base, later = table._listed(spark)
    assert base is not None and len(later) < 3
    durable.keep(stream(), table, f"{tmp_path}/checkpoint")
    assert read() == total
    spark.createDataFrame([("a", "x", 1000)], SCHEMA).write.parquet(f"{tmp_path}/in/more")
    durable.keep(stream(), table, f"{tmp_path}/checkpoint")
    total["a", "x"] += 1000
    assert read() == total


def test_what_is_being_made_is_not_seen(spark, tmp_path):
    table = durable.SumTable(f"{tmp_path}/sums", ("a",), ("n",))
    with pytest.raises(ValueError):
        table.read(spark)
    rows = spark.createDataFrame([("x", 1), ("x", 2), (None, 5)], "a string, n long")
    assert table.read(spark, rows.schema).count() == 0
    table.add(rows, 0)
    rows.write.parquet(f"{tmp_path}/sums/.making-batch-1-dead")
    table.add(rows, 0)  # again
    assert {(r.a, r.n) for r in table.read(spark).collect()} == {("x", 3), (None, 5)}


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


EVENTS = "job string, status string, t timestamp, i long"


def test_only_legal_steps_count(spark, tmp_path):
    batches = [
        [("a", "processing", at(0), 1), ("b", "complete", at(1), 2), ("c", "processing", at(2), 3), ("c", "failed", at(2), 4), ("c", "complete", at(3), 5), (None, "processing", at(0), 6), ("z", "processing", None, 7)],
        [("a", "complete", at(10), 8), ("b", "processing", at(11), 9), ("c", "processing", at(12), 10), ("e", None, at(12), 11)],
        [("a", "processing", at(5), 12), ("b", "failed", at(20), 13), ("d", "processing", at(20), 14)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = counts.stream_folder(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENTS).schema, files=1)
        status.run(status.machine(stream, "job", "status", "t", F.col("i"), late="1 day"), f"{tmp_path}/log", f"{tmp_path}/checkpoint")  # a restart each time
    log = spark.read.parquet(f"{tmp_path}/log")
    got = {r.place: (r.key, r.accepted, r.reason, r.now) for r in log.collect()}
    assert got == {
        1: ("a", True, "", "processing"), 2: ("b", False, "no step from nothing", ""), 3: ("c", True, "", "processing"), 4: ("c", True, "", "failed"), 5: ("c", False, "no step from failed", "failed"),
        8: ("a", True, "", "complete"), 9: ("b", True, "", "processing"), 10: ("c", False, "no step from failed", "failed"), 11: ("e", False, "no step from nothing", ""),
        12: ("a", False, "late", "complete"), 13: ("b", True, "", "failed"), 14: ("d", True, "", "processing"),
    }
    assert {(r.key, r.status) for r in status.current(log).collect()} == {("a", "complete"), ("b", "failed"), ("c", "failed"), ("d", "processing")}


def test_stuck_jobs_end(spark, tmp_path):
    batches = [[("a", "processing", at(0), 1), ("b", "processing", at(0), 2)], [("a", "complete", at(30), 3)], [("c", "processing", at(200), 4)], [("c", "complete", at(210), 5)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = counts.stream_folder(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENTS).schema, files=1)
        status.run(status.machine(stream, "job", "status", "t", F.col("i"), after=timedelta(minutes=60), late="0 seconds"), f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert {(r.key, r.status) for r in status.current(log).collect()} == {("a", "complete"), ("b", "failed"), ("c", "complete")}
    assert [(r.key, r["at"], r.reason) for r in log.filter("reason != ''").collect()] == [("b", at(60), "stuck in processing")]


def test_states_equal_the_latest_events(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"j{rng.randrange(20)}", rng.choice("xyz"), at(rng.randrange(500)), i) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = counts.stream_folder(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENTS).schema, files=1)
    any_step = {s: ("x", "y", "z") for s in ("", "x", "y", "z")}
    status.run(status.machine(stream, "job", "status", "t", F.col("i"), any_step, late="10 days"), f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    want = store.latest(spark.createDataFrame(rows, EVENTS), "job", [F.col("t"), F.col("i")], ["status", "i"])
    assert {(r.key, r.status, r.place) for r in status.current(spark.read.parquet(f"{tmp_path}/log")).collect()} == {tuple(r) for r in want.collect()}


def test_python_is_called_for_shards_of_jobs(spark, tmp_path, monkeypatch):
    """Before, once for each job. Jobs of one shard keep their own states and deadlines, over restarts."""
    calls = tmp_path / "calls"
    calls.mkdir()
    plain = status._Machine.handleInputRows

    def counted(self, key, rows, timerValues):
        (calls / uuid.uuid4().hex).touch()
        return plain(self, key, rows, timerValues)

    monkeypatch.setattr(status._Machine, "handleInputRows", counted)
    monkeypatch.setattr(status._Machine, "__module__", "__main__")  # so that workers get the class as it is here
    begun = [(f"j{i}", "processing", at(i), i) for i in range(300)]
    ended = [(f"j{i}", "complete", at(310 + i % 3), 1000 + i) for i in range(0, 300, 3)]
    batches = [begun, ended, [("k", "processing", at(500), 2000)], [("k", "failed", at(501), 2001)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = counts.stream_folder(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENTS).schema, files=1)
        made = status.machine(stream, "job", "status", "t", F.col("i"), after=timedelta(minutes=400), late="400 minutes", shards=2)
        status.run(made, f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    log = spark.read.parquet(f"{tmp_path}/log")
    # the watermark is at 101 minutes, and before the end no deadline (400 to 699 minutes) is met
    now = {r.key: r.status for r in status.current(log).collect()}
    assert now == {"k": "failed", **{f"j{i}": "processing" if i % 3 else "complete" for i in range(300)}}
    assert 3 <= len(list(calls.iterdir())) <= 2 * len(batches)
    rows = [("l", "processing", at(950), 3000)]  # the watermark is at 550 after it
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{len(batches)}")
    stream = counts.stream_folder(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENTS).schema, files=1)
    status.run(status.machine(stream, "job", "status", "t", F.col("i"), after=timedelta(minutes=400), late="400 minutes", shards=2), f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    log = spark.read.parquet(f"{tmp_path}/log")
    got = {r.key: r["at"] for r in log.filter("reason = 'stuck in processing'").collect()}
    assert got == {f"j{i}": at(400 + i) for i in range(150) if i % 3}
