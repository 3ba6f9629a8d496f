"""Vector search against numpy: every metric, both join ways, odd rows, and the bucket index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import vectors as V


def plain(queries, vectors, k, metric):
    """Every pair scored alone."""
    out = set()
    for q, a in queries:
        found = []
        for v, b in vectors:
            if a is None or b is None or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in [*a, *b]) or not a:
                continue
            x, y = np.array(a, float), np.array(b, float)
            norms = np.linalg.norm(x) * np.linalg.norm(y)
            score = {"dot": x @ y, "l2": -np.linalg.norm(x - y), "cosine": x @ y / norms if norms else 0.0}[metric]
            found.append((-round(float(score), 6), v))
        out |= {(q, v, i + 1) for i, (_, v) in enumerate(sorted(found)[:k])}
    return out


def got(df):
    return {(r.query_id, r.vec_id, r.rank) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    r = random.Random(2)
    vecs = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    odd = [(1000, None), (1001, []), (1002, [1.0, None] * 4), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [0.0] * 8), (1006, [1.0, 2.0]), (1007, [2.0, 1.0])]
    return vecs + odd


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_exact_search_in_small_blocks(spark, monkeypatch, data, metric, broadcast_bytes):
    monkeypatch.setattr(V, "VECTOR_ROWS", 37)
    monkeypatch.setattr(V, "QUERY_ROWS", 4)
    v = spark.createDataFrame(data, "vec_id int, embedding array<double>").repartition(3)
    asked = data[:9] + data[-8:]
    q = spark.createDataFrame([(f"q{i}", e) for i, e in asked], "query_id string, embedding array<double>")
    want = plain([(f"q{i}", e) for i, e in asked], data, 5, metric)
    assert got(V.nearest(q, v, 5, metric, broadcast_bytes=broadcast_bytes)) == want


def test_held_rows_are_handed_on(spark, monkeypatch, data):
    v = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    q = spark.createDataFrame(data[:50], "query_id int, embedding array<double>")
    whole = got(V.nearest(q, v, 3))
    monkeypatch.setattr(V, "HELD_ROWS", 10)
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    assert got(V.nearest(q, v, 3)) == whole


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTOR_ROWS", 5)
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40, 0, -1)], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert got(V.nearest(q, v, 4)) == {(7, i, i) for i in (1, 2, 3, 4)}
    assert got(V.nearest_approx(q, v, 4, bands=3, bits=2)) == {(7, i, i) for i in (1, 2, 3, 4)}


def test_no_queries_or_no_vectors(spark, data):
    v = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    for search in (V.nearest, V.nearest_approx):
        assert search(q.where("false"), v, 5).count() == 0
        assert search(q, v.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        V.nearest(q, v, 5, "manhattan")


def test_plan_does_not_grow_with_queries(spark):
    """Ten thousand queries are one plan: a scan of the vectors, a join, a ranking."""
    vectors = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.randn(5) + i * 0).alias("embedding"))
    sizes = []
    for n in (10, 10_000):
        queries = spark.range(n).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.randn(6) + i * 0).alias("embedding"))
        found = V.nearest(queries, vectors, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
        sizes.append(len(plan.splitlines()))
        assert found.count() == 5 * n
    assert sizes[0] == sizes[1]


def test_index_has_every_vector_once_a_band_and_splits_hot_buckets(spark, data):
    same = [(i + 5000, [1.0] * 8) for i in range(300)]
    v = spark.createDataFrame(data + same, "vec_id int, embedding array<double>")
    index = V.bucket_index(v.where("size(embedding) = 8"), bands=4, bits=3, bucket_rows=100)
    rows = index.blocks.select("band", "code", "salt", F.explode("vec_ids").alias("v")).collect()
    usable = {i for i, e in data + same if e and len(e) == 8 and all(x is not None and np.isfinite(x) for x in e)}
    assert sorted((r.band, r.v) for r in rows) == sorted((b, i) for b in range(4) for i in usable)
    assert {r.salt for r in rows if r.v >= 5000} >= {0, 1, 2}
    code = {(r.band, r.v): r.code for r in rows}
    planes = V.sign_planes(8, 4, 3)
    for i, e in data[:50]:
        for b in range(4):
            assert code[b, i] == sum(1 << j for j in range(3) if np.dot(planes[b, j], e) > 0)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_index_scores_exactly_what_it_meets(spark, monkeypatch, data, metric):
    monkeypatch.setattr(V, "VECTOR_ROWS", 20)
    vecs = [(i, e) for i, e in data if e and len(e) == 8 and all(x is not None and np.isfinite(x) for x in e)]
    v = spark.createDataFrame(vecs, "vec_id int, embedding array<double>")
    q = spark.createDataFrame(vecs[:30], "query_id int, embedding array<double>")
    index = V.bucket_index(v, bands=2, bits=6, bucket_rows=7)
    codes = V._codes(np.array([e for _, e in vecs]), V.sign_planes(8, 2, 6))
    want = set()
    for i in range(30):
        near = [bin(x).count("1") <= 1 for x in (codes[:, 0] ^ codes[i, 0]).tolist()]
        far = [bin(x).count("1") <= 1 for x in (codes[:, 1] ^ codes[i, 1]).tolist()]
        met = [vecs[j] for j in range(len(vecs)) if near[j] or far[j]]
        want |= plain([vecs[i]], met, 4, metric)
    assert got(V.search_index(index, q, 4, metric)) == want


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.bucket_index(v)
    found = V.search_index(index, q, 10)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want, have = ({(r.query_id, r.vec_id) for r in df.collect()} for df in (V.nearest(q, v, 10), found))
    assert len(want & have) >= 0.9 * len(want)
