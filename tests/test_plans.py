"""The skew-safe building blocks against plain Spark and Python on small and lopsided frames."""

import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsloom.plans.closure import reach, sum_up_tree
from opsloom.plans.joining import null_safe_join, salted_join
from opsloom.plans.ordered import counted_chunk, ordered_window, rank_by_value, step_chunk
from opsloom.plans.predicates import Cond, Negate, all_of, any_of, to_column, wildcard_regex
from opsloom.plans import quantiles, storage
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket, fill_gaps
from opsloom.sources.entities import write_entity
from tests.conftest import rows


def lopsided(spark, n=600, seed=3):
    """Half of all rows in one key, null keys, null values."""
    r = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None])
        data.append((key, r.randrange(200), i, None if r.random() < 0.1 else r.randrange(50)))
    return spark.createDataFrame(data, "k string, at int, id int, v int")


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_ordered_window_equals_plain_window(spark, step):
    df = lopsided(spark)
    got = ordered_window(
        df, ["k"], ["at", "id"], step_chunk("at", step), lag={"p": "v"}, lead={"nx": "v"},
        running={"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "ls": ("last", F.col("v")), "hb": ("max", F.col("v"))},
        number="n", exclusive=("hb",),
    )
    w = Window.partitionBy("k").orderBy("at", "id")
    u, b = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("nx"), F.sum("v").over(u).alias("s"), F.count("v").over(u).alias("c"),
        F.max("v").over(u).alias("hi"), F.min("v").over(u).alias("lo"), F.last("v", ignorenulls=True).over(u).alias("ls"), F.max("v").over(b).alias("hb"),
        F.row_number().over(w).alias("n"),
    )
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_ordered_window_without_key_numbers_the_table(spark):
    df = spark.range(100).select(F.expr("(id * 37) % 101").alias("x"))
    got = ordered_window(df, [], ["x"], step_chunk("x", 10), number="n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1, 101))


def test_ordered_window_spreads_a_hot_key(spark):
    df = spark.range(1000).select((F.col("id") % 1).alias("k"), F.col("id").alias("at"))
    plan = ordered_window(df, ["k"], ["at"], step_chunk("at", 50), lag={"p": "at"})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_chunk" in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("accuracy", [10, 100, 10000])
def test_exact_quantiles_for_any_sketch(spark, accuracy):
    df = lopsided(spark, 3000).withColumn("x", F.col("v") * 1.5)
    probs = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", probs, accuracy).collect()}
    by_key = {}
    for r in df.collect():
        if r.x is not None:
            by_key.setdefault(r.k, []).append(r.x)
    assert set(got) == set(by_key)
    for k, xs in by_key.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, p)), (k, name)


@pytest.mark.parametrize("accuracy,bound", [(60, 5), (300, 3), (10000, 4)])
@pytest.mark.parametrize("weighted", [False, True])
def test_brackets_are_narrowed(spark, monkeypatch, accuracy, bound, weighted):
    """One group of all rows, lumps of equal values, and small groups, with steps that must narrow."""
    monkeypatch.setattr(quantiles, "BINS", 4)
    r = random.Random(accuracy)
    values = {"hot": [r.choice([r.gauss(0, 1), 1.5, 1.5, 1e9 * r.random()]) for _ in range(3000)], "b": [float(i) for i in range(40)], None: [2.0, 1.0], "one": [7.0]}
    probs = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    steps = []
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: steps.append(1) or cut_lineage(df))
    if weighted:
        rows_ = [(k, x, n) for k, xs in values.items() for x, n in Counter(xs).items()] + [("hot", 5.0, 0), ("b", None, 3), ("b", 9.0, None)]
        got = exact_quantiles(spark.createDataFrame(rows_, "k string, x double, n bigint"), ["k"], "x", probs, accuracy, weight="n", bound=bound)
    else:
        df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "k string, x double")
        got = exact_quantiles(df, ["k"], "x", probs, accuracy, bound=bound)
    got = {r.k: r for r in got.collect()}
    assert len(steps) > 5 and set(got) == set(values)
    for k, xs in values.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, p)), (k, name)


def test_groups_of_every_size(spark):
    df = spark.createDataFrame([(n, float((i * 7919) % n)) for n in range(1, 60) for i in range(n)], "k int, x double")
    probs = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 90, 99, 100)}
    for r in exact_quantiles(df, ["k"], "x", probs, 100).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(range(r.k), p)), (r.k, name)


def test_rows_are_scanned_twice(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS k", "id * 1.5 AS x").write.parquet(f"{tmp_path}/t")
    got = exact_quantiles(spark.read.parquet(f"{tmp_path}/t"), ["k"], "x", {"a": 0.2, "b": 0.7})
    # the first scan is the sketch, written by the call; the second is the only one in the result
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [k#") == 2  # the rows, and the written sketch
    assert sum(f"{tmp_path}/t" in f for f in got.inputFiles()) >= 1 and got.count() == 3


def test_exact_quantiles_edges(spark, frame):
    df = frame([("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)], "k string, x double")
    assert rows(exact_quantiles(df, ["k"], "x", {"m": 0.5})) == [("one", 5.0), ("two", 1.5)]
    assert exact_quantiles(df.where("false"), ["k"], "x", {"m": 0.5}).count() == 0


def test_rank_by_value_is_rank(spark):
    df = lopsided(spark).where("v IS NOT NULL").select("k", "id", "v")
    want = df.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(F.col("v").desc())))
    assert rows(rank_by_value(df, ["k"], "v")) == rows(want.select("k", "id", "v", F.col("rank").cast("bigint")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    big = lopsided(spark)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3)], "k string, w int")
    assert rows(salted_join(big, small, ["k"], how, 5)) == rows(big.join(small, ["k"], how))
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "full")


def test_null_safe_join_keeps_null_groups(frame):
    a = frame([(None, 1), ("x", 2)], "k string, v int")
    b = frame([(None, 10), ("y", 20)], "k string, w int")
    assert rows(null_safe_join(a, b, ["k"])) == [(None, 1, 10)]


def test_predicates(frame):
    df = frame([(1, "a"), (2, "b"), (3, None)], "x int, s string")
    tree = any_of(all_of(Cond("x", ">", 1), Negate(Cond("s", "=", "zz"))), Cond("s", "is null"))
    assert [r.x for r in df.where(to_column(tree)).orderBy("x").collect()] == [2, 3]
    with pytest.raises(ValueError):
        to_column(Cond("x", ">", 1), allowed=["s"])
    with pytest.raises(ValueError):
        to_column(Cond("x", "??", 1))
    assert wildcard_regex("a.*?") == r"^a\..*.$"


def test_reach_ends_on_cycles(frame):
    edges = frame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "src string, dst string")
    got = reach(edges, frame([("a",)], "start string"), 10)
    assert rows(got) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_tree_sums_and_cycle_error(frame):
    tree = frame([("leaf1", "mid"), ("leaf2", "mid"), ("mid", "top"), ("top", None)], "node string, parent string")
    values = frame([("leaf1", 1), ("leaf2", 2), ("mid", 10)], "node string, v int")
    assert rows(sum_up_tree(values, tree, ["v"])) == [("leaf1", 1), ("leaf2", 2), ("mid", 13), ("top", 13)]
    ring = frame([("a", "b"), ("b", "a")], "node string, parent string")
    with pytest.raises(ValueError):
        sum_up_tree(frame([("a", 1)], "node string, v int"), ring, ["v"])


def test_deep_chains_and_trees_have_no_bound(frame):
    chain = frame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "src string, dst string")
    assert max(r.depth for r in reach(chain, frame([("n00",)], "start string")).collect()) == 40
    tree = frame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "node string, parent string")
    total = dict(rows(sum_up_tree(frame([(f"n{i:02d}", 1) for i in range(41)], "node string, v int"), tree, ["v"])))
    assert total["n40"] == 41 and total["n00"] == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_buckets_follow_the_wall_clock(spark, frame, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = frame([("2024-03-10 02:30:40",), ("2024-03-10 03:30:00",), ("1969-12-31 23:59:59",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
        want = {
            "second": ["1969-12-31 23:59:59", "2024-03-10 02:30:40", "2024-03-10 03:30:00"],
            "minute": ["1969-12-31 23:59:00", "2024-03-10 02:30:00", "2024-03-10 03:30:00"],
            "hour": ["1969-12-31 23:00:00", "2024-03-10 02:00:00", "2024-03-10 03:00:00"],
            "15 minutes": ["1969-12-31 23:45:00", "2024-03-10 02:30:00", "2024-03-10 03:30:00"],
            "6 hours": ["1969-12-31 18:00:00", "2024-03-10 00:00:00", "2024-03-10 00:00:00"],
            "day": ["1969-12-31 00:00:00", "2024-03-10 00:00:00", "2024-03-10 00:00:00"],
            "week": ["1969-12-29 00:00:00", "2024-03-04 00:00:00", "2024-03-04 00:00:00"],
            "month": ["1969-12-01 00:00:00", "2024-03-01 00:00:00", "2024-03-01 00:00:00"],
            "quarter": ["1969-10-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"],
            "year": ["1969-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"],
        }
        for span, starts in want.items():
            got = [r.b for r in times.select(bucket("t", span).cast("string").alias("b")).collect()]
            assert got.count(None) == 1 and sorted(b for b in got if b) == starts, span
        series = frame([("2024-01-01",), ("2024-07-01",)], "bucket string").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.lit(1).alias("v"))
        assert fill_gaps(series, [], "quarter", {"v": 0}).count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_written_steps_share_one_folder_and_go_together(spark):
    """A local session without a setting has one folder, and dropping it drops the written steps."""
    first, second = storage.shared_path(spark, "a"), storage.shared_path(spark, "b")
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0] and first != second
    spark.range(3).write.parquet(first)
    assert spark.read.parquet(first).count() == 3


def test_dropping_what_was_written():
    """In a process of its own, as it ends the steps of all frames of the application."""
    code = """
import os
from opsloom.plans import storage
from opsloom.session import local_session
s = local_session(1, 1, "1g")
path = storage.shared_path(s, "x")
storage.cut_lineage(s.range(3))
assert os.listdir(os.path.dirname(path))
storage.drop_written(s)
assert not os.path.exists(os.path.dirname(path))
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)


def test_chunk_by_counts(spark):
    """The longest unit in which the hottest key stays within the limit."""
    df = spark.range(7200).selectExpr("if(id % 10 = 0, 'b', 'hot') AS k", "timestamp_micros(id * 1000000)::timestamp_ntz AS ts")
    width = lambda rows: df.select(counted_chunk(df, ["k"], "ts", rows).alias("c")).distinct().count()
    assert [width(r) for r in (10_000, 3300, 60, 10)] == [1, 2, 120, 7200]
    assert counted_chunk(df.where("false"), ["k"], "ts") is not None


def test_partitioned_write_brings_folders_together(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "id % 5 AS g").repartition(8)
    write_entity(df, f"{tmp_path}/t", partition_by=["g"])
    files = [len([f for f in os.listdir(f"{tmp_path}/t/g={g}") if f.startswith("part")]) for g in range(5)]
    assert max(files) <= 2 and spark.read.parquet(f"{tmp_path}/t").count() == 3000
