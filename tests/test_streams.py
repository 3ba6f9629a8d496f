"""Streams over several files and batches end in the batch result."""

import random
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.operators.metrics import AlarmRule
from opsloom.streaming import alarms as A
from opsloom.streaming import operators as Z
from opsloom.streaming import runs as R
from opsloom.streaming import schedule as S

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, k string, ts timestamp_ntz, v double"


@pytest.fixture()
def folder(spark):
    path = tempfile.mkdtemp(prefix="opsloom-stream-")
    for day in range(3):
        data = [(day * 100 + i, "ab"[i % 2], T0 + timedelta(days=day, minutes=10 * i), float(i)) for i in range(100)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark, folder, **kw):
    return R.stream_source(spark, folder, SCHEMA, max_files=1, **kw)


def test_group_resumes_where_it_stopped(spark, folder):
    progress = tempfile.mkdtemp(prefix="opsloom-progress-")
    first = R.run_to_end(read(spark, folder).select("id"), "a", progress=progress)
    assert first.count() == 300 and first.select("batch").distinct().count() == 3
    spark.createDataFrame([(999, "a", T0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert [r.id for r in R.run_to_end(read(spark, folder).select("id"), "b", progress=progress).collect()] == [999]


def test_positions(spark, folder):
    late = R.run_to_end(read(spark, folder, start="2024-01-02 00:00:00", ts="ts").select("id"), "late")
    assert late.count() == 200
    assert R.run_to_end(read(spark, folder, start="LATEST").select("id"), "none").count() == 0


def test_replayed_batch_is_written_once(spark):
    path = tempfile.mkdtemp(prefix="opsloom-sink-") + "/t"
    write = R.batch_writer(path)
    df = spark.range(5)
    write(df, 0)
    write(df, 0)
    assert R.read_result(spark, path, df.schema).count() == 5


def test_windows_equal_batch_for_closed_windows(spark, folder):
    df = R.zoned(spark.read.schema(SCHEMA).parquet(folder), "ts")
    aggs = {"n": "count(*)", "s": "sum(v)"}
    want = Z.windowed(df, "ts", "1 hour", "2 hours", ["k"], aggs)
    limit = df.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    got = R.run_to_end(Z.windowed(R.zoned(read(spark, folder), "ts"), "ts", "1 hour", "2 hours", ["k"], aggs), "win").drop("batch")
    assert sorted(got.collect()) == sorted(want.where(F.col("end") <= F.lit(limit)).collect())


def test_dedup_across_batches(spark, folder):
    again = spark.read.schema(SCHEMA).parquet(folder).where("id >= 290")
    again.coalesce(1).write.mode("append").parquet(folder)
    got = R.run_to_end(Z.dedup_stream(R.zoned(read(spark, folder), "ts"), ["id"], "ts", "3 days").select("id"), "dd")
    assert got.count() == 300


def test_update_mode_last_state(spark, folder):
    rows = Z.twin_state(read(spark, folder), "k", ["ts", "id"], ["v"])
    got = R.last_update(R.run_to_end(rows, "twin", "update"), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 98.0, 150), ("b", 99.0, 150)]


def test_oversized_message(spark):
    df = spark.createDataFrame([("k", "x" * 20), ("k", "ok"), (None, "ok"), ("k", None)], "k string, v string")
    got = [(r.error, r.partition is not None) for r in Z.put_messages(df, "k", "v", 4, 10).collect()]
    assert got == [("TOO_LARGE", False), (None, True), (None, True), ("EMPTY_VALUE", False)]


def test_latest_reads_a_later_file(spark, folder):
    progress = tempfile.mkdtemp(prefix="opsloom-progress-") + "/g"
    stream = lambda: read(spark, folder, start="LATEST", progress=progress).select("id")
    assert R.run_to_end(stream(), "l1", progress=progress).count() == 0
    time.sleep(1.1)  # files carry whole seconds in some stores
    spark.createDataFrame([(999, "a", T0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert [r.id for r in R.run_to_end(stream(), "l2", progress=progress).collect()] == [999]
    assert R.run_to_end(stream(), "l3", progress=progress).count() == 0


def hourly(spark, path, rows):
    """One file, which is one batch: (hour, key, value)."""
    data = [(h * 10, k, T0 + timedelta(hours=h, minutes=1), float(v)) for h, k, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 3])
def test_silent_key_fires_once_and_ends(spark, files):
    path = tempfile.mkdtemp(prefix="opsloom-silent-")
    beats = [(h, "steady", 1) for h in range(0, 31)]
    # b breaches twice and falls silent, comes back at 20 with a breach that counts anew
    data = beats + [(0, "b", 9), (1, "b", 9), (20, "b", 9), (21, "b", 0), (23, "b", 9)]
    for f in range(files):
        hourly(spark, path, [r for r in data if r[0] * files // 31 == f])
    rule = AlarmRule("hour", "mean", ">", 5.0, pending=2)
    rows = A.alarm_stream(R.zoned(read(spark, path), "ts"), "ts", "v", "10 minutes", "1 hour", "k", rule, absent=3)
    got = sorted((round((r.bucket - T0).total_seconds() / 3600), r.run, r.state) for r in R.run_to_end(rows, "silent").collect() if r.key == "b")
    assert got == [(0, 1, "PENDING"), (1, 2, "FIRING"), (4, 0, "ABSENT"), (20, 1, "PENDING"), (21, 0, "OK"), (23, 1, "PENDING"), (26, 0, "ABSENT")]


def test_gap_within_the_limit_is_no_absence(spark):
    path = tempfile.mkdtemp(prefix="opsloom-gap-")
    for part in ([(0, "k", 1), (3, "k", 1)], [(6, "k", 1)], [(7, "other", 1)]):
        hourly(spark, path, part)
    rows = A.alarm_stream(R.zoned(read(spark, path), "ts"), "ts", "v", "0 seconds", "1 hour", "k", AlarmRule("hour", "mean", ">", 5.0), absent=3)
    assert {r.state for r in R.run_to_end(rows, "gap").collect()} == {"OK"}


def ticks(spark, path, *hours):
    spark.createDataFrame([(T0 + timedelta(hours=h),) for h in hours], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def test_schedule_runs_every_due_time_once(spark, tmp_path):
    path, target = f"{tmp_path}/ticks", f"{tmp_path}/out"
    calls = []

    def report(session, due):
        calls.append(due)
        return session.range(2).select("id")

    def go(progress):
        stream = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)
        S.scheduled(stream, "ts", report, target, T0 + timedelta(hours=1), timedelta(hours=2), progress=progress).awaitTermination()
        got = S.results(spark, target, spark.range(0).schema)
        return sorted({(r.run, (r.run_time - T0).total_seconds() / 3600) for r in got.collect()}), got.count()

    ticks(spark, path, 0)
    assert go(f"{tmp_path}/p") == ([], 0)
    ticks(spark, path, 1, 2)
    ticks(spark, path, 4)
    assert go(f"{tmp_path}/p") == ([(0, 1.0), (1, 3.0)], 4)
    # the same ticks under a new checkpoint are repeated batches, and find their runs done
    assert go(f"{tmp_path}/other") == ([(0, 1.0), (1, 3.0)], 4) and len(calls) == 2
    # a restart after a pause makes up for what has come due
    ticks(spark, path, 9)
    assert go(f"{tmp_path}/p") == ([(0, 1.0), (1, 3.0), (2, 5.0), (3, 7.0), (4, 9.0)], 10) and len(calls) == 5


def test_broken_run_is_run_again(spark, tmp_path):
    target = f"{tmp_path}/out"
    report = lambda session, due: session.range(1)
    args = (report, target, T0, timedelta(days=1), T0 + timedelta(days=1))
    assert len(S.run_due(spark, *args)) == 2 and S.run_due(spark, *args) == []
    next(tmp_path.glob("out/due=20240102*/_SUCCESS")).unlink()
    assert S.run_due(spark, *args) == [T0 + timedelta(days=1)]
    assert S.results(spark, target, spark.range(0).schema).count() == 2
    with pytest.raises(ValueError):
        S.due_times(T0, timedelta(0), T0)


def test_clock_ticks(spark):
    assert S.clock(spark).isStreaming and S.clock(spark).columns == ["ts"]


@pytest.mark.parametrize("chunk", ["minute", "hour", "day"])
def test_sessions_by_chunk_equal_plain_sessions(spark, chunk):
    """One key with all but a few rows, gaps of exactly the limit, sessions over many chunks."""
    r = random.Random(5)
    data, at = [], T0 + timedelta(minutes=50)
    for i in range(600):
        at += timedelta(seconds=r.choice([1, 60, 599, 600, 601, 20_000]) if i % 9 else 4000)
        data.append((i, "hot" if i % 20 else r.choice(["a", None]), at, float(i)))
    df = spark.createDataFrame(data + [(900, "hot", None, 1.0)], SCHEMA).repartition(3)
    got = Z.session_windows(df, "ts", "10 minutes", ["k"], {"n": ("count", "v"), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}, chunk)
    want = df.where("ts IS NOT NULL").groupBy("k", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    want = want.select("k", "w.start", "w.end", "n", "s", "hi", "lo")
    key = lambda x: (str(x[0]), x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.where("k = 'hot'").count() > 50
