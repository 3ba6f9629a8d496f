"""Interval summaries at a finer resolution against a walk over all points."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from opsloom.operators import metrics as M
from opsloom.operators import panes

T0 = datetime(2024, 3, 1)
STATS = ["mean", "sum", "count", "min", "max", "rate", "absent", "p0", "p50", "p90"]


def plain(points, whole, step):
    held = defaultdict(list)
    for k, at, v in points:
        if at is None:
            continue
        pane = (at - T0) // step * step
        for i in range(whole // step):
            held[k, T0 + pane - i * step].append(v)
    out = {}
    steps = sorted({b for _, b in held})
    for key in {k for k, _ in held}:
        last = None
        for b in sorted(b for k, b in held if k == key):
            vs = [v for v in held[key, b] if v is not None]
            row = {"mean": np.mean(vs) if vs else None, "sum": sum(vs) if vs else None, "count": float(len(vs)), "min": min(vs, default=None), "max": max(vs, default=None)}
            row["rate"] = None if last is None or last[1] is None or row["mean"] is None else (row["mean"] - last[1]) / (b - last[0]).total_seconds()
            last = b, row["mean"]
            out |= {(key, b, s): v for s, v in row.items()}
            out |= {(key, b, f"p{p}"): float(np.quantile(vs, p / 100)) for p in (0, 50, 90) if vs}
        b = steps[0]
        while b <= steps[-1]:
            if (key, b) not in held:
                out[key, b, "absent"] = 1.0
            b += step
    return out


@pytest.fixture(scope="module")
def points():
    r = random.Random(9)
    data = [("hot", T0 + timedelta(seconds=r.randrange(40_000)), r.choice([1.0, 2.5, r.gauss(0, 3), None])) for _ in range(500)]
    data += [(None, T0 + timedelta(hours=h), float(h)) for h in (0, 1, 9)] + [("one", T0 + timedelta(hours=5), None), ("hot", None, 1.0)]
    return data


@pytest.mark.parametrize("interval,resolution", [("hour", "15 minutes"), ("3 hours", "hour"), ("2 hours", "2 hours")])
def test_all_statistics(spark, points, interval, resolution):
    df = spark.createDataFrame([(*p, 1) for p in points], "k string, ts timestamp_ntz, v double, bucket int").drop("bucket")
    got = M.summarize_many(df, "ts", "v", interval, STATS, ["k"], resolution=resolution).collect()
    want = plain(points, timedelta(seconds=panes.seconds_in(interval)), timedelta(seconds=panes.seconds_in(resolution)))
    assert len(got) == len(want)
    for r in got:
        v = want[r.k, r.bucket, r.stat]
        assert (r.v is None and v is None) or r.v == pytest.approx(v), r


def test_one_statistic_and_filled_steps(spark, points):
    df = spark.createDataFrame(points, "k string, ts timestamp_ntz, v double")
    many = {(r.k, r.bucket): r.v for r in M.summarize_many(df, "ts", "v", "hour", ["max"], ["k"], resolution="30 minutes").collect()}
    one = {(r.k, r.bucket): r.v for r in M.summarize(df, "ts", "v", "hour", "max", ["k"], resolution="30 minutes").collect()}
    filled = M.summarize(df, "ts", "v", "hour", "max", ["k"], fill=True, resolution="30 minutes").collect()
    assert one == many and {(r.k, r.bucket): r.v for r in filled if (r.k, r.bucket) in many} == many
    assert len(filled) == 3 * len({r.bucket for r in filled})


def test_without_dimensions_and_empty(spark, points):
    df = spark.createDataFrame(points, "k string, ts timestamp_ntz, v double")
    got = {r.bucket: r.v for r in M.summarize(df, "ts", "v", "hour", "count", [], resolution="30 minutes").collect()}
    want = plain([("all", t, v) for _, t, v in points], timedelta(hours=1), timedelta(minutes=30))
    assert got == {b: v for (_, b, s), v in want.items() if s == "count"}
    assert M.summarize_many(df.where("false"), "ts", "v", "hour", STATS, ["k"], resolution="30 minutes").count() == 0


@pytest.mark.parametrize("interval,resolution,stat", [("hour", "25 minutes", "mean"), ("month", "day", "mean"), ("hour", "minute", "median")])
def test_refused(spark, points, interval, resolution, stat):
    df = spark.createDataFrame(points, "k string, ts timestamp_ntz, v double")
    with pytest.raises(ValueError):
        M.summarize(df, "ts", "v", interval, stat, ["k"], resolution=resolution)


def test_points_are_read_once(spark, points, tmp_path, monkeypatch):
    """Every written step but the first comes from other written steps."""
    spark.createDataFrame(points, "k string, ts timestamp_ntz, v double").write.parquet(f"{tmp_path}/points")
    reads = []
    write = panes.cut_lineage
    monkeypatch.setattr(panes, "cut_lineage", lambda df: reads.append(any(str(tmp_path) in f for f in df.inputFiles())) or write(df))
    out = M.summarize_many(spark.read.parquet(f"{tmp_path}/points"), "ts", "v", "hour", STATS, ["k"], resolution="15 minutes")
    assert reads == [True, False] and not any(f"{tmp_path}/points" in f for f in out.inputFiles())
