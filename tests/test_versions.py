"""Order of versions, advisory ranges and upgrades against comparisons of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import graph as GR
from opsloom.operators import versions as V
from tests.conftest import rows

ASCENDING = [
    "0.9", "1", "1.0-alpha", "1.0-alpha.1", "1.0-beta", "1.0-rc1", "1.0-rc2", "1.0-rc10", "1.0", "1.0.0-snapshot", "1.0.0", "1.0.1", "1.2", "1.9", "1.10",
    "1.10.0.4", "2.0-rc1", "2.0rc2", "2.0", "2.0.beta", "2.0.x", "10.0", "100000000000000000000.1",
]


def test_total_order(frame):
    r = random.Random(1)
    data = [(i, v) for i, v in enumerate(ASCENDING)]
    r.shuffle(data)
    got = [x.i for x in frame(data, "i int, v string").orderBy(V.version_key(F.col("v"))).collect()]
    want = sorted(range(len(ASCENDING)), key=lambda i: got.index(i))
    assert [ASCENDING[i] for i in got] == [ASCENDING[i] for i in want]
    key = lambda v: V.version_key(F.lit(v))
    pairs = [("2.0-rc1", "2.0"), ("2.0-rc1", "2.0-rc2"), ("2.0rc9", "2.0-rc10"), ("1.9", "1.10"), ("1.0", "1.0.1"), ("1.0-1", "1.0-a"), ("2.0.beta", "2.0"), ("1.0-alpha", "1.0-alpha.1"), ("9", "10.0"), ("1", "1.0")]
    assert frame([(1,)], "x int").select(*[(key(a) < key(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first() == (True,) * len(pairs)
    same = [("V1.2", "1.2"), ("1.0+build7", "1.0"), ("1.0RC1", "1.0-rc1")]
    assert frame([(1,)], "x int").select(*[(key(a) == key(b)).alias(f"c{i}") for i, (a, b) in enumerate(same)]).first() == (True,) * len(same)
    assert frame([(None,)], "v string").where(V.version_key(F.col("v")).isNull()).count() == 1


def place(order, v):
    return order[v]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_and_upgrades(spark, seed):
    r = random.Random(seed)
    names = [f"{a}.{b}{s}" for a in range(4) for b in (0, 1, 2, 10) for s in ("", "-rc1", "-rc2")]
    ordered = [x.v for x in spark.createDataFrame([(n,) for n in names], "v string").orderBy(V.version_key(F.col("v"))).collect()]
    order = {v: i for i, v in enumerate(ordered)}
    order_of = lambda v, default: default if v is None else order[v]
    # one component holds most rows
    have = {(r.choice(["hot", "hot", "hot", "b"]), r.choice(names)) for _ in range(70)} | {("c", "1.0")}
    adv = [(r.choice(["hot", "hot", "b", "d"]), r.choice([None, *names]), r.choice([None, *names]), f"A{j}", float(r.randrange(9))) for j in range(9)]
    comps = spark.createDataFrame(sorted(have), "component string, version string")
    advs = spark.createDataFrame(adv, "component string, low string, high string, advisory string, score double")
    inside = lambda v, low, high: order_of(low, -1) <= order[v] < order_of(high, 10**6)
    want = sorted((c, v, a) for c, v in have for k, low, high, a, _ in adv if c == k and inside(v, low, high))
    assert sorted(tuple(x) for x in V.affected(comps, advs).select("component", "version", "advisory").collect()) == want
    assert sorted(tuple(x) for x in V.affected(comps, advs, ["A1"]).select("component", "version", "advisory").collect()) == [w for w in want if w[2] != "A1"]
    worst = {}
    for c, _, a in want:
        worst[c] = max(worst.get(c, 0.0), next(s for *_, b, s in adv if b == a))
    assert {x.component: x.score for x in V.worst_scores(comps, advs).collect()} == worst
    offered = {(c, r.choice(names)) for c in ("hot", "b") for _ in range(12)}
    dirty = {(c, v) for c, v in have | offered for k, low, high, _, _ in adv if c == k and inside(v, low, high)}
    expected = []
    for c, v in sorted(have & dirty):
        better = [x for k, x in offered - dirty if k == c and order[x] > order[v]]
        expected.append((c, v, min(better, key=order.get, default=None)))
    got = V.recommend_upgrades(comps, spark.createDataFrame(sorted(offered), "component string, version string"), advs)
    assert sorted(map(tuple, got.collect())) == expected


def test_scores_travel_and_odd_rows(frame):
    deps = frame([("app", "lib"), ("lib", "core"), ("core", "lib")], "src string, dst string")
    comps = frame([("core", "2.0-rc1"), ("core", None), (None, "1"), ("lib", "x")], "component string, version string")
    adv = frame([("core", "2.0-beta", "2.0", "X", 5.0), ("lib", "1", "2", "Y", 9.0), ("core", "3", "1", "Z", 8.0)], "component string, low string, high string, advisory string, score double")
    assert rows(GR.vulnerability_audit(deps, comps, adv)) == [("app", 5.0), ("core", 5.0), ("lib", 5.0)]
    assert V.affected(comps, adv.where("false")).count() == 0 and V.affected(comps.where("false"), adv).count() == 0
    assert V.recommend_upgrades(comps, comps, adv.where("false")).count() == 0


def test_rows_stay_linear(spark):
    """2,000 versions under 200 ranges of one component: no step has more rows than versions and bounds."""
    comps = spark.range(2000).selectExpr("'c' AS component", "concat(id div 100, '.', id % 100) AS version")
    adv = spark.range(200).selectExpr("'c' AS component", "concat(id div 10, '.', id % 10) AS low", "concat(id div 10, '.', 10 + id % 10) AS high", "concat('A', id) AS advisory", "1.0D AS score")
    plan = V.dirty_versions(comps, adv)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = V.recommend_upgrades(comps, comps, adv).collect()
    assert len(got) == 20 * 19 and all(x.upgrade == f"{x.version.split('.')[0]}.19" for x in got)
