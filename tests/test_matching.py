"""Lookups by pattern and network against a test of every pair, and plans without that product."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from opsloom.operators import matching as MA
from tests.conftest import rows


def plain(values, entries, matches):
    out = []
    for i, v in values:
        hits = sorted((o, n) for p, n, o in entries if v is not None and p is not None and matches(v, p))
        out.append((i, hits[0][1] if hits else None))
    return sorted(out, key=lambda r: str(r[0]))


def wild(value, pattern):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), value, re.S) is not None


def found(spark, values, entries, kind):
    df = spark.createDataFrame(values, "id int, v string")
    ref = spark.createDataFrame(entries, "p string, name string, o int")
    return sorted(rows(MA.lookup_match(df, ref, "v", "p", kind, ["name"], "o").select("id", "name")), key=lambda r: str(r[0]))


@pytest.mark.parametrize("seed", range(3))
def test_wildcards(spark, seed):
    r = random.Random(seed)
    word = lambda a, n: "".join(r.choice(a) for _ in range(r.randrange(n)))
    values = [(i, word("ab.*?\n[", 9)) for i in range(150)] + [(900, None), (901, ""), (902, "a" * 50)]
    entries = [(word("ab.*?*?", 7), f"n{j}", r.randrange(40)) for j in range(60)] + [(None, "null", 0), ("", "empty", 3), ("??*", "two", 99), ("?*?", "two again", 98), ("*", "any", 100), ("***", "any again", 101)]
    assert found(spark, values, entries, "wildcard") == plain(values, entries, wild)


def test_networks(spark):
    r = random.Random(4)
    ip = lambda: ".".join(str(r.choice([10, 10, 11, 0, 255])) for _ in range(4))
    values = [(i, ip()) for i in range(120)] + [(500, "no ip"), (501, None), (502, "1.2.3"), (503, "1.2.3.256")]
    entries = [(f"{ip()}/{r.choice([1, 8, 12, 16, 25, 32])}", f"n{j}", j) for j in range(30)] + [("0.0.0.0/0", "all", 90), ("1.2.3.4/0", "all again", 91), ("x/8", "bad", 0), ("1.1.1.1/99", "bad", 0), (None, "null", 0)]

    def inside(v, p):
        try:
            return ipaddress.ip_address(v) in ipaddress.ip_network(p, strict=False)
        except ValueError:
            return False

    assert found(spark, values, entries, "cidr") == plain(values, entries, inside)


def test_exact_and_nocase_and_repeated_rows(spark):
    values = [(1, "Ab"), (1, "Ab"), (2, "ab"), (3, None)]
    entries = [("ab", "low", 2), ("ab", "first", 1), ("AB", "up", 3), (None, "null", 0)]
    assert found(spark, values, entries, "exact") == [(1, None), (1, None), (2, "first"), (3, None)]
    assert found(spark, values, entries, "nocase") == [(1, "first"), (1, "first"), (2, "first"), (3, None)]
    with pytest.raises(ValueError):
        found(spark, values, entries, "sounds like")


@pytest.mark.parametrize("kind", ["exact", "nocase", "wildcard", "cidr"])
def test_no_rows_or_no_entries(spark, kind):
    assert found(spark, [], [("a*", "n", 1)], kind) == []
    assert found(spark, [(1, "a")], [], kind) == [(1, None)]


def test_values_meet_only_patterns_whose_literal_they_hold(spark):
    """300 patterns with a leading wildcard on 1,000 values: the join gives about one pair a value."""
    values = spark.range(1000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".x"), (F.col("id") % 500).cast("string")).alias("_value"))
    for make in (lambda j: f"*.x{j}", lambda j: f"*t{j}.*"):
        entries = spark.createDataFrame([(make(j), (j,), (j,)) for j in range(300)], "_ref string, _order struct<o:int>, _hit struct<n:int>")
        hits = MA._wildcard_hits(values, entries)
        plan = hits._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        keys = entries.select(MA.pattern_key(F.col("_ref")).alias("k"))
        assert keys.distinct().count() == 300
        assert hits.count() == (600 if make(1) == "*.x1" else 300)


def test_keys_take_the_longest_literal(frame):
    df = frame([("abc*de",), ("*de",), ("a?bcd*e",), ("?*?",), ("??",), ("plain",), ("ab*cd",)], "p string")
    got = [tuple(r.k) for r in df.select(MA.pattern_key(F.col("p")).alias("k")).collect()]
    assert got == [("prefix", "abc"), ("suffix", "de"), ("inside", "bcd"), ("none", "2+"), ("none", "2"), ("prefix", "plain"), ("prefix", "ab")]
