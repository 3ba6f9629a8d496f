"""Edge cases: empty input, nulls, ties, one row, bad values, hot keys, brute-force twins."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from opsloom.catalog import QUERIES
from opsloom.operators import aggs as A
from opsloom.operators import billing as B
from opsloom.operators import columns as C
from opsloom.operators import graph as GR
from opsloom.operators import joins as J
from opsloom.operators import logs as X
from opsloom.operators import metrics as M
from opsloom.operators import privacy as D
from opsloom.operators import retrieval as G
from opsloom.operators import text as L
from opsloom.operators import windows as W
from opsloom.operators.billing import date_range, tiered_price
from opsloom.plans.joining import split_join
from opsloom.plans.predicates import Cond, Negate, all_of, any_of
from opsloom.sources import entities as E
from opsloom.sources import inventory as I
from opsloom.sources import merging as S
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


# fixed values: names and the identifiers they become
SNAKE = [
    ("HelloWorld", "hello_world"), ("Hello-World", "hello_world"), ("Hello:World", "hello_world"), ("Hello.World", "hello_world"),
    ("Hello:World-Test", "hello_world_test"), ("Hello:One:World", "hello_one_world"), ("", ""), ("A", "a"), ("hello", "hello"), ("HELLO", "hello"),
]


def test_snake_names(frame):
    got = C.to_snake(frame(SNAKE, "raw string, want string"), "raw")
    assert got.where("raw <> want").count() == 0


def test_search_tree_ignores_case_and_null(frame):
    df = frame([(1, "The Cat"), (2, "dog"), (3, None)], "id int, t string")
    assert [r.id for r in C.search(df, any_of("CAT", "DOG")).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in C.search(df, Negate("cat")).orderBy("id").collect()] == [2, 3]


def test_split_parts_add_up(frame):
    df = frame([(i,) for i in range(20)] + [(None,)], "x int")
    routes = {"low": Cond("x", "<", 5), "even": "x % 2 = 0"}
    first = C.split(df, routes)
    assert sum(p.count() for p in first.values()) == 21
    every = C.split(df, routes, mode="all")
    assert every["low"].count() == 5 and every["even"].count() == 10 and every["other"].count() == 9


def test_parse_keeps_unmatched(frame):
    df = frame([("a,b",), ("a",), (None,)], "line string")
    got = rows(C.parse_logs(df, "line", "delimited", (",", ["x", "y"])).select("x", "y", "parse_error"))
    assert ("a", "b", None) in got and (None, None, "FIELD_COUNT") in got and len(got) == 3


def test_to_utc_offsets(frame):
    df = frame([("2024-01-01 10:00:00+02:00",), ("2024-01-01 10:00:00",), ("bad",)], "t string")
    assert [r.t for r in C.to_utc(df, "t").collect()] == [datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 10), None]


def test_units_and_errors(frame):
    df = frame([(100.0,)], "v double")
    assert C.convert_units(df, "v", "C", "F").first().v == pytest.approx(212.0)
    with pytest.raises(ValueError):
        C.convert_units(df, "v", "GB", "s")
    with pytest.raises(ValueError):
        C.structured_search(df, [Cond("w", "=", 1)], ["v"])


def test_lookup_modes(frame):
    df = frame([(1,), (2,), (3,)], "k int")
    ref = frame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "k int, v string, o int")
    pick = lambda multi: rows(J.lookup(df, ref, ["k"], ["v"], multi, ["o"], {"v": "-"}))
    assert pick("first") == [(1, "a"), (2, "c"), (3, "-")]
    assert pick("last") == [(1, "b"), (2, "c"), (3, "-")]
    assert pick("all") == [(1, "a"), (1, "b"), (2, "c"), (3, "-")]
    with pytest.raises(Exception, match="not unique"):
        J.lookup(df, ref, ["k"], ["v"], "error").collect()


@pytest.mark.parametrize("bucket,salts", [(60, 1), (3600, 3), (864000, 2)])
def test_interval_join_against_brute_force(spark, bucket, salts):
    r = random.Random(1)
    ev = [(i, at(r.randrange(5000)), r.choice("ab")) for i in range(300)]
    iv = [(j, at(s := r.randrange(5000)), at(s + r.randrange(0, 900)), r.choice("ab")) for j in range(40)]
    events = spark.createDataFrame(ev, "id int, ts timestamp_ntz, k string")
    spans = spark.createDataFrame(iv, "win int, s timestamp_ntz, e timestamp_ntz, k string")
    want = sorted((i, j) for i, t, k in ev for j, s, e, k2 in iv if s <= t < e and k == k2)
    got = J.in_interval(events, spans, "ts", "s", "e", bucket, ["k"], salts=salts, key=["id"])
    assert sorted((x.id, x.win) for x in got.collect()) == want
    left = J.in_interval(events, spans, "ts", "s", "e", bucket, ["k"], how="left_anti", salts=salts, key=["id"])
    assert {x.id for x in left.collect()} == {e[0] for e in ev} - {i for i, _ in want}
    assert left.columns == events.columns


@pytest.mark.parametrize("bucket", [30, 3600, 864000])
def test_interval_totals_are_those_of_the_pairs(spark, bucket):
    r = random.Random(2)
    odd = [None, float("nan"), float("inf"), 1e300, -1e21, -0.0, 99999999999999999999.0, 1e-9]
    ev = [(i, None if i % 50 == 0 else at(r.randrange(300) * 10), r.choice(["a", "b", None]), r.choice([r.randrange(10000) / 100, *odd[: 6 * (i % 9 == 0)]]), r.choice([None, i])) for i in range(300)]
    iv = [(j % 30, at((s := r.randrange(300)) * 10), at((s + r.randrange(-9, 60)) * 10), r.choice(["a", "b", None])) for j in range(90)]
    iv += [(1, None, at(1), "a"), (2, at(1), None, "a"), (None, at(0), at(9), "a")]
    events = spark.createDataFrame(ev, "id int, ts timestamp_ntz, k string, v double, w bigint")
    spans = spark.createDataFrame(iv, "win int, s timestamp_ntz, e timestamp_ntz, k string")
    for some in (events, events.where("abs(v) < 1e19"), events.where("v IS NULL"), events.limit(0)):
        pairs = J.in_interval(some, spans, "ts", "s", "e", bucket, ["k"], salts=2, key=["id"])
        want = pairs.groupBy("win").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("v"), F.sum("w").alias("w"))
        got = J.in_interval(some, spans, "ts", "s", "e", bucket, ["k"], salts=2, key=["id"], per=["win"], totals={"v": "v", "w": "w"})
        assert got.dtypes == want.dtypes and rows(got.withColumn("v", F.round("v", 6)).select("win", "n", "v", "w").selectExpr("win", "n", "string(v)", "w")) == rows(want.selectExpr("win", "n", "string(v)", "w"))


def test_interval_totals_form_no_pairs(spark):
    """A hundred thousand events in all of fifty thousand intervals: five thousand million pairs."""
    events = spark.range(100000).selectExpr("timestamp_micros(id)::timestamp_ntz AS ts", "id / 8 AS v")
    spans = spark.range(50000).selectExpr("id AS win", "timestamp_micros(-id)::timestamp_ntz AS s", "timestamp_micros(100000 + id)::timestamp_ntz AS e")
    got = J.in_interval(events, spans, "ts", "s", "e", 3600, per=["win"], totals={"total": "v"})
    assert got.groupBy("n", "total").count().collect() == [(100000, 99999 * 100000 / 16, 50000)]
    plan = QUERIES["j9_interval_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_compare_tables_null_changes(frame):
    a = frame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = frame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert rows(J.compare_tables(a, b, ["k"])) == [(2, "changed", "v"), (3, "only_left", None), (4, "only_right", None)]


def test_link_across_chunk_edges(frame):
    ts = [0, 30, 55, 65, 70, 300, 301]
    df = frame([("u", at(m)) for m in ts] + [(None, at(5))], "k string, ts timestamp_ntz")
    got = rows(A.link(df, ["k"], "ts", 1800).select("k", "start", "end", "n", "duration"))
    assert ("u", at(0), at(70), 5, 4200.0) in got and ("u", at(300), at(301), 2, 60.0) in got and (None, at(5), at(5), 1, 0.0) in got


def test_profile_all_null_and_empty(frame):
    got = {r["column"]: r for r in A.profile(frame([(1, None), (1, None), (2, None)], "a int, b string")).collect()}
    assert got["a"]["distinct"] == 2 and got["a"]["top_value"] == "1" and got["b"]["nulls"] == 3 and got["b"]["distinct"] == 0
    assert {r["n"] for r in A.profile(frame([], "a int, b string")).collect()} == {0}


def test_dedup_consecutive_nulls(frame):
    df = frame([("u", i, s) for i, s in enumerate(["x", "x", None, None, "x"])], "k string, o int, s string")
    assert [r.o for r in A.dedup_consecutive(df, ["k"], ["s"], ["o"], F.floor(F.col("o") / 2)).orderBy("o").collect()] == [0, 2, 4]


def test_sequence_against_brute_force(spark):
    r = random.Random(5)
    ev = [(i, "hot" if r.random() < 0.6 else r.choice("abc"), at(r.randrange(3000)), r.choice(["A", "B", "C", "z"])) for i in range(200)]
    df = spark.createDataFrame(ev, "id int, k string, ts timestamp_ntz, e string")
    limit = 6 * 3600
    best = {}
    pos = lambda x: (x[2], x[0])
    for a in ev:
        for b in ev:
            for c in ev:
                if a[1] == b[1] == c[1] and (a[3], b[3], c[3]) == ("A", "B", "C") and pos(a) < pos(b) < pos(c) and (c[2] - a[2]).total_seconds() <= limit:
                    best[c[0]] = max(best.get(c[0], a[2]), a[2])
    got = W.sequence(df, ["k"], "ts", [F.col("e") == s for s in "ABC"], limit, ["ts", "id"])
    assert {x.id: x.chain_start for x in got.collect()} == best and best


def test_islands_and_overlaps_against_brute_force(spark):
    r = random.Random(9)
    data = [(i, r.choice(["hot", "hot", "b"]), at(s := r.randrange(3000)), at(s + 1 + r.randrange(200))) for i in range(120)]
    df = spark.createDataFrame(data, "id int, k string, s timestamp_ntz, e timestamp_ntz")
    partners = {d[0]: 0 for d in data}
    for a, b in combinations(data, 2):
        if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]:
            partners[a[0]] += 1
            partners[b[0]] += 1
    hour = lambda c: F.date_trunc("hour", F.col(c))
    got = X.overlap_counts(df, ["k"], "s", "e", "id", hour)
    assert {x.id: x.overlaps for x in got.collect()} == partners
    want = []
    for k in ("hot", "b"):
        cur = None
        for d in sorted((d for d in data if d[1] == k), key=lambda d: (d[2], d[0])):
            if cur and d[2] <= cur[2]:
                cur = [k, cur[1], max(cur[2], d[3]), cur[3] + 1]
            else:
                want += [tuple(cur)] if cur else []
                cur = [k, d[2], d[3], 1]
        want.append(tuple(cur))
    assert rows(X.islands(df, ["k"], "s", "e", "id", hour("s"))) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_alarm_runs(frame):
    vals = [1, 9, 9, 9, 1, 9, None, 9]
    df = frame([("k", at(60 * i), None if v is None else float(v)) for i, v in enumerate(vals)], "d string, ts timestamp_ntz, v double")
    rule = M.AlarmRule("hour", "mean", ">", 5.0, pending=2, dims=["d"])
    got = [r.state for r in M.evaluate_alarm(df, "ts", "v", rule).orderBy("bucket").collect()]
    assert got == ["OK", "PENDING", "FIRING", "FIRING", "OK", "PENDING", "OK", "PENDING"]
    moves = M.alarm_history(M.evaluate_alarm(df, "ts", "v", rule), ["d"]).orderBy("bucket").collect()
    assert [m.to_state for m in moves] == ["OK", "PENDING", "FIRING", "OK", "PENDING", "OK", "PENDING"] and moves[-1].seconds is None


def test_counter_reset(frame):
    df = frame([("c", i, at(i), v) for i, v in enumerate([10, 15, 3, 8])], "k string, id int, ts timestamp_ntz, n int")
    got = M.counter_rate(df, ["k"], "ts", "n", ["ts", "id"]).orderBy("id").collect()
    assert [r.increment for r in got] == [None, 5, 3, 5] and [r.is_reset for r in got] == [False, False, True, False]


def test_seasonal_forecast_repeats_the_season(frame):
    df = frame([("a", x, float(10 * (x % 4))) for x in range(40)], "k string, x long, y double")
    got = M.seasonal_forecast(df, ["k"], 4, 4).orderBy("x").collect()
    assert [round(r.forecast, -1) for r in got] == [0, 10, 20, 30]


def test_tiers_and_relative_dates(frame):
    df = frame([(0.0,), (100.0,), (150.0,), (600.0,)], "q double")
    got = [r[0] for r in df.select(tiered_price(F.col("q"), [(0, 1.0), (100, 0.5), (500, 0.1)])).collect()]
    assert got == [0.0, 100.0, 125.0, 310.0]
    assert date_range("LAST_7_DAYS", None, "2024-03-08") == ("2024-03-01", "2024-03-08")


def test_shuffle_keeps_the_multiset(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v"))
    inside = D.shuffle(df, "id", "v", "s", ["g"])
    assert rows(inside.select("g", "v")) == rows(df.select("g", "v"))
    assert rows(inside) == rows(D.shuffle(df, "id", "v", "s", ["g"]))
    assert inside.join(df.withColumnRenamed("v", "old"), ["id", "g"]).where("v <> old").count() > 300


def test_encryption_hides_key_and_checks_it(frame):
    key, other = b"k" * 32, b"x" * 32
    df = frame([(1, "secret", None)], "id int, a string, b string")
    sealed = D.encrypt(df, ["a", "b"], key, "id-1", "ctx")
    text = sealed._jdf.queryExecution().toString()
    assert "k" * 32 not in text and (b"k" * 32).hex().upper() not in text.upper()
    assert rows(D.decrypt(sealed, ["a", "b"], key)) == [(1, "secret", None)]
    with pytest.raises(Exception):
        D.decrypt(sealed, ["a"], other).collect()
    with pytest.raises(ValueError):
        D.encrypt(df, ["a"], b"short", "id")


def test_grant_paths_with_cycle(frame):
    grants = frame([("u", "r1"), ("r1", "r2"), ("r2", "r1"), ("r2", "P"), ("v", "zz")], "grantee string, granted string")
    users = frame([("u",), ("v",)], "user string")
    assert rows(D.grant_paths(grants, users, "P")) == [("u", "u > r1 > r2 > P", 3)]


def test_pii_offsets_count_characters(frame):
    df = frame([(1, "äö a@b.de, 10.0.0.1 4111111111111111 4111111111111112"), (2, None), (3, "")], "id int, t string")
    got = rows(L.detect_pii(df, ["id"], "t").select("type", "offset", "entity"))
    assert got == [("CARD", 20, "4111111111111111"), ("EMAIL", 3, "a@b.de"), ("IP", 11, "10.0.0.1")]


def test_pii_modes(frame):
    df = frame([("to a@b.de now",), ("none",), (None,)], "t string")
    out = lambda mode, **kw: [r.t for r in L.mask_pii(df, "t", mode, **kw).collect()]
    assert out("REPLACE") == ["to <EMAIL> now", "none", None]
    assert out("REMOVE") == ["to  now", "none", None]
    assert out("MASK", keep_last=2) == ["to ****de now", "none", None]
    assert out("REPLACE", exclude=["EMAIL"])[0] == "to a@b.de now"
    assert out("RELEXIFY")[0].split()[1] in L.STAND_INS["EMAIL"]
    with pytest.raises(ValueError):
        out("OTHER")


def test_evaluate_missing_class(frame):
    got = {(r.metric, r["class"]): r.value for r in L.evaluate(frame([("a", "a"), ("a", "b"), ("c", "c")], "y string, p string"), "y", "p").collect()}
    assert got[("precision", "b")] == 0 and got[("recall", "a")] == 0.5 and got[("accuracy", "all")] == pytest.approx(2 / 3)


def test_phrases_match_whole_words(frame):
    docs = frame([(1, "Red Cat sat; red cat"), (2, "red"), (3, "")], "id int, t string")
    topics = frame([("x", "red cat"), ("y", "RED"), ("y", "sat red cat")], "topic string, keyword string")
    assert rows(L.keywords_for(docs, "id", "t", topics)) == [(1, "x", "red cat", 2), (1, "y", "RED", 2), (1, "y", "sat red cat", 1), (2, "y", "RED", 1)]


def test_chunks_cover_the_text(frame):
    text = "abcdefghij" * 7 + "xyz"
    df = frame([(1, text), (2, "ab"), (3, ""), (4, None)], "id int, t string")
    got = {}
    for r in G.chunk(df, ["id"], "t", 20, 5).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got[2] == ["ab"] and 3 not in got
    assert got[1][0] + "".join(c[5:] for c in got[1][1:]) == text


def test_merge_three_states_and_duplicates(frame):
    target = frame([(1, "a", 10), (2, "b", 20)], "k int, s string, n int")
    source = frame([(1, None, 99, ["s"]), (3, "new", 5, ["s", "n"])], "k int, s string, n int, f array<string>")
    assert rows(S.merge_into(target, source, ["k"], present="f")) == [(1, None, 10), (2, "b", 20), (3, "new", 5)]
    assert rows(S.merge_into(target, source.drop("f"), ["k"], "delete", "ignore")) == [(2, "b", 20)]
    with pytest.raises(Exception, match="key twice"):
        S.merge_into(target, source.unionByName(source), ["k"], present="f").collect()


def test_patch_order(frame):
    df = frame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    patch = frame(
        [(1, 1, "REMOVE", None, None), (1, 2, "MERGE", "again", None), (2, 1, "MERGE", None, 7), (2, 2, "MERGE", "c", None), (9, 1, "REMOVE", None, None), (8, 1, "INSERT", "n", 3), (8, 2, "REMOVE", None, None)],
        "k int, seq int, operation string, s string, n int",
    )
    assert rows(S.apply_patch(df, patch, ["k"])) == [(1, "again", None), (2, "c", 7)]


def test_drift_policies(frame):
    df = frame([("7", "x")], "a string, extra string")
    want = frame([], "a int, b double").schema
    assert rows(E.read_with_drift(df, want)) == [(7, None)]
    assert E.read_with_drift(df, want, "allow", "ignore", "ignore").columns == ["a", "extra"]
    for kw in ({"on_extra": "fail"}, {"on_missing": "fail"}, {"on_type": "fail"}):
        with pytest.raises(ValueError):
            E.read_with_drift(df, want, **kw)


def test_avro_is_a_clear_error(spark):
    with pytest.raises(ValueError, match="avro"):
        E.read_entity(spark, "/tmp/none", "avro")


def test_rules_last_match_and_retention(frame):
    names = frame([("a.x",), ("a.y",), ("b.x",)], "n string")
    assert rows(I.select_entities(names, "n", [("include", "a.*"), ("exclude", "*.y")])) == [("a.x",)]
    inv = frame([("logs/1", datetime(2024, 1, 1)), ("logs/2", datetime(2024, 1, 9))], "name string, modified timestamp_ntz")
    rules = [I.LifecycleRule("DELETE", 5, "logs/"), I.LifecycleRule("ARCHIVE", 1)]
    due = lambda keep: rows(I.lifecycle_actions(inv, rules, "2024-01-11", retention_days=keep).select("name", "action"))
    assert due(0) == [("logs/1", "DELETE"), ("logs/2", "ARCHIVE")]
    assert due(30) == [("logs/1", "ARCHIVE"), ("logs/2", "ARCHIVE")]


def test_metric_rejects(frame):
    df = frame(
        [("n", "m", {"a": "b"}, [(T0, 1.0), (T0, None)]), ("n", "", {"a": "b"}, [(T0, 1.0)]), ("n", "m", {}, [(T0, 1.0)]), ("n", "m", None, [(T0, 1.0)]), ("n", "m", {"a": "b"}, None)],
        "namespace string, name string, dimensions map<string,string>, datapoints array<struct<ts:timestamp_ntz,value:double>>",
    )
    good, bad = I.ingest_metrics(df)
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["MISSING_NAME", "NO_DIMENSION", "NO_DIMENSION", "NO_TIMESTAMP", "NO_VALUE"]


def test_empty_frames_give_empty_results(frame):
    ev = frame([], "id int, k string, ts timestamp_ntz, v double")
    assert A.link(ev, ["k"], "ts", 60).count() == 0
    assert W.delta(ev, ["v"], ["k"], "ts", ["ts", "id"]).count() == 0
    assert X.outlier(ev, ["k"], "v", 3.0).count() == 0
    assert M.summarize(ev, "ts", "v", "hour", "mean", ["k"], fill=True).count() == 0
    assert X.islands(ev.withColumn("e", F.col("ts")), ["k"], "ts", "e", "id", F.date_trunc("day", "ts")).count() == 0


def test_masks_and_digests_keep_nulls_apart(frame):
    df = frame([("a|=b", "c"), ("a", "b|=c"), (None, "c")], "x string, y string")
    assert len({r.digest for r in D.digest(df, ["x", "y"]).collect()}) == 3
    masked = D.mask(df.withColumn("k", F.col("y")), "k", {"x": D.keyed_hash("s")}).collect()
    assert [r.x is None for r in masked] == [False, False, True]
    wide = df.select(D.hash_number("s", F.concat("x", "y"), 10**15).alias("n")).where("n IS NOT NULL").collect()
    assert any(r.n > 1 << 32 for r in wide)


def test_card_and_address_patterns_have_bounds(frame):
    df = frame([(1, "4111-1111-1111-1111 and 10.0.0.255"), (2, "41111111111111111111 and 999.300.1.1")], "id int, t string")
    assert sorted((r.id, r.type) for r in L.detect_pii(df, ["id"], "t").collect()) == [(1, "CARD"), (1, "IP")]
    assert L.mask_pii(df, "t", "REPLACE").orderBy("id").collect()[1].t == "41111111111111111111 and 999.300.1.1"


def test_absence_counts_null_dimensions_and_logs_without_text(frame):
    points = frame([("2024-01-01 00:10:00", None, 1.0), ("2024-01-01 02:10:00", None, 1.0)], "t string, d string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [str(r.bucket) for r in M.summarize(points, "t", "v", "hour", "absent", ["d"]).collect()] == ["2024-01-01 01:00:00"]
    lines = frame([(None,), ("x=1",)], "line string")
    assert [r.parse_error for r in C.parse_logs(lines, "line", "regex", r"x=(?<x>[0-9])").collect()] == ["NO_MATCH", None]


def test_grant_chains_of_any_length(frame):
    names = ["u", *[f"r{i}" for i in range(10)], "P"]
    grants = frame(list(zip(names, names[1:])), "grantee string, granted string")
    got = D.grant_paths(grants, frame([("u",)], "user string"), "P").collect()
    assert [r.steps for r in got] == [11]


@pytest.mark.parametrize("seed,salts", [(1, 1), (2, 5)])
def test_overlap_pairs_against_all_pairs(spark, seed, salts):
    """Very short and very long ranges, equal starts, touching, empty and open ranges, a hot and a null key."""
    r = random.Random(seed)
    data = []
    for i in range(250):
        start = r.randrange(3000)
        data.append((r.choice(["hot", "hot", None]), i, at(start), at(start + r.choice([0, 1, 2, 30, 31, 500, 100_000, -5]))))
    data += [("hot", 900, None, at(5)), ("hot", 901, at(5), None)]
    good = [(k, i, s, e) for k, i, s, e in data if s and e and s < e]
    want = sorted((str(a[0]), a[1], b[1], b[2], min(a[3], b[3])) for a in good for b in good if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and a[3] > b[2])
    rows_ = X.overlap_pairs(spark.createDataFrame(data, "k string, id int, s timestamp_ntz, e timestamp_ntz"), ["k"], "s", "e", "id", salts)
    assert sorted((str(x[0]), *x[1:]) for x in rows_.collect()) == want


def test_overlap_pairs_meet_few_others(spark):
    """A thousand short ranges under ten that span them all: what meets is what overlaps."""
    short = spark.range(1000).selectExpr("'k' AS k", "id", "timestamp_micros(id * 1000000)::timestamp_ntz AS s", "timestamp_micros(id * 1000000 + 900000)::timestamp_ntz AS e")
    long = spark.range(10).selectExpr("'k'", "10000 + id", "timestamp_micros(-id - 1)::timestamp_ntz", "timestamp_micros(2000000000)::timestamp_ntz")
    pairs = X.overlap_pairs(short.unionByName(long.toDF("k", "id", "s", "e")), ["k"], "s", "e", "id")
    assert pairs.count() == 1000 * 10 + 45
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_a_word_of_all_documents_is_no_join_key(spark):
    docs = spark.range(400).selectExpr("id", "concat('common ', if(id % 7 = 0, 'seven ', ''), 'w', char(97 + id % 26), char(97 + id div 26)) AS t")
    plain = rows(X.keywords(docs, "id", "t", 3, []))
    split = X.keywords(docs, "id", "t", 3, [], hot_rows=50)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert rows(split) == plain and "Union" in plan and "_hot" in plan
    queries = spark.createDataFrame([(1, "common seven wab"), (2, "wba wcc common")], "q int, t string")
    pairs = queries.select("q").crossJoin(docs.select("id"))
    want = rows(G.rerank(pairs, queries, docs, "q", "id", "t", 4))
    assert rows(G.rerank(pairs, queries, docs, "q", "id", "t", 4, hot_rows=50)) == want and len(want) == 8


def test_words_are_counted_without_a_shuffle(spark):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["a", "b", "ü", "be", "B,", "1"]) for _ in range(r.randrange(12))) if i % 9 else None) for i in range(60)]
    for some in (texts, [*texts, (3, "a B a"), (3, "zz"), (None, "a ü"), (None, "ü ü"), (None, None)]):
        docs = spark.createDataFrame(some, "id int, t string")
        got = X.word_counts(docs, "id", "t")
        words = docs.select("id", F.explode(X.tokens(F.col("t"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))
        assert got.dtypes == words.dtypes and rows(got) == rows(words)
        if some is texts:
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        plain = rows(X.keywords(docs, "id", "t", 3, ["be"], hot_words=0))
        assert plain and all(rows(X.keywords(docs, "id", "t", 3, ["be"], hot_words=n)) == plain for n in (1, 2, 50000))


def test_split_join_counts_for_itself(spark):
    big = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 'hot' WHEN id < 80 THEN concat('k', id % 3) WHEN id < 90 THEN 'lost' END AS k", "id")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k1", 3), ("never", 4)], "k string, v int")
    want = rows(big.join(small, "k"))
    assert rows(split_join(big, small, "k", 10)) == want and rows(split_join(big, small, "k", 1000)) == want and rows(split_join(big, small, "k", 0)) == want


def test_vocabulary_too_large_to_send(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{'bc'[i % 2]} common {'xyz'[i % 3]}") for i in range(30)], "id int, t string")
    queries = spark.createDataFrame([(1, "ab common x"), (2, "ac nowhere")], "q int, t string")
    pairs = queries.select("q").crossJoin(docs.select("id"))
    want = rows(G.rerank(pairs, queries, docs, "q", "id", "t", 3))
    monkeypatch.setattr(G, "VOCABULARY", 0)
    assert rows(G.rerank(pairs, queries, docs, "q", "id", "t", 3)) == want


def test_modes_leave_what_the_finder_leaves(frame):
    """4111... passes its check digit, 1234... does not."""
    df = frame([("4111 1111 1111 1111 and 1234 5678 1234 5678 of a@b.org",), (None,)], "t string")
    got = {m: L.mask_pii(df, "t", m, keep_last=4).first().t for m in ("REPLACE", "REMOVE", "MASK")}
    assert got == {
        "REPLACE": "<CARD> and 1234 5678 1234 5678 of <EMAIL>", "REMOVE": " and 1234 5678 1234 5678 of ",
        "MASK": "***************1111 and 1234 5678 1234 5678 of ***.org",
    }
    assert L.mask_pii(df, "t", "RELEXIFY").first().t.startswith("0000000000000000 and 1234 5678 1234 5678 of ")
    assert L.mask_pii(df, "t", "MASK", exclude=["CARD", "EMAIL"]).first().t == df.first().t
    with pytest.raises(ValueError):
        L.mask_pii(df, "t", "FORGET")


def test_spend_without_budget_or_commitment_stays(frame):
    spend = frame([("a", at(0), 5.0), ("b", at(0), 7.0)], "k string, ts timestamp_ntz, c double")
    status = B.budget_status(spend, frame([("a", 5.0)], "k string, budget double"), "k", "ts", "c", [("actual", 100)])
    assert sorted((r.k, r.kind, r.threshold) for r in status.collect()) == [("a", "actual", 100.0), ("b", "unbudgeted", None)]
    burn = B.burn_down(spend, frame([("a", 3.0)], "k string, commitment double"), "k", "ts", "c")
    assert sorted((r.k, r.covered, r.overage) for r in burn.collect()) == [("a", 3.0, 2.0), ("b", 0.0, 7.0)]


def test_problems_count_empty_periods(frame):
    week = timedelta(days=7)
    df = frame([("x", at(0)), ("x", at(0) + 2 * week), ("y", at(0) + week)], "team string, ts timestamp_ntz")
    got = {(r.team, r.n, r.change) for r in GR.problems(df, ["team"], "ts", "week").where("level = 'period,team'").collect()}
    assert got == {("x", 1, None), ("x", 0, -1), ("x", 1, 1), ("y", 0, None), ("y", 1, 1), ("y", 0, -1)}


def test_seasonal_forecast_of_short_groups(frame):
    df = frame([("one", 3, 5.0), (None, 0, 1.0), (None, 1, 3.0), (None, 2, None)], "k string, x bigint, y double")
    got = {(r.k, r.x): round(r.forecast, 6) for r in M.seasonal_forecast(df, ["k"], 2, 2).collect()}
    assert got == {("one", 4): 5.0, ("one", 5): 5.0, (None, 2): 5.0, (None, 3): 7.0}
