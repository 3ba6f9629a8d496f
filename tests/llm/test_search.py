"""FM-index, near duplicates, line dedup and top-k against brute force."""

import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import fmindex, hyperminhash, linejoin, maxproduct
from opsloom.llm.catalog import QUERIES
from opsloom.llm.shingles import shingle_sets

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0).astype(np.int32)
        index = fmindex.FMIndex(text, sample=4)
        phrases = [rng.integers(1, 6, rng.integers(1, 5)).astype(np.int32) for _ in range(6)]
        for p, low, high in zip(phrases, *index.search(phrases)):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


@pytest.mark.parametrize("block_words", [3, 10**6])
def test_contamination(spark, awkward, block_words):
    tests = spark.createDataFrame([("a", "ran low THAT year, and the boats lay dry on both of its banks"), ("b", "short"), ("c", None), ("d", "..."), ("e", "word word"), ("b", "not there at all")], "item_id string, text string")
    got = fmindex.contamination(awkward, tests, cut=True, block_words=block_words).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert [(s.start, s.end) for s in by_id[1].spans] == [(2, 16)] and by_id[1]["items"] == ["a"] and by_id[1].clean_text == "The river\n."
    assert [(s.start, s.end) for s in by_id[6].spans] == [(0, 40_000)] and by_id[6].n_words == 40_000
    assert by_id[9]["items"] == ["b"] and by_id[2].n_words == 0 and by_id[2].spans == [] and by_id[None]["items"] == []
    assert by_id[8].n_words == len(WORD.findall("é漢字😀   ß x"))


def test_contamination_without_tests(spark, awkward, nothing):
    tests = spark.createDataFrame([], "item_id bigint, text string")
    assert {len(r.spans) for r in fmindex.contamination(awkward, tests).collect()} == {0}
    assert fmindex.contamination(nothing, awkward.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4) if words else 0)}


def test_shingles_count_like_plain_sets(awkward):
    texts = [r.text for r in awkward.collect()] + ["a b c d e f", "A b C d E f", "a b c d\x0be f", "x"]
    sets = shingle_sets([None if t is None else t.encode() for t in texts], 5)
    assert [len(s) for s in sets] == [len(plain_sets(t)) for t in texts]
    assert sets[-4].tolist() == sets[-3].tolist() == sets[-2].tolist()


@pytest.mark.parametrize("n_words", range(7))
def test_shingles_of_a_short_batch_in_a_fresh_worker(n_words):
    text = " ".join("abcdefg"[:n_words])
    code = f"from opsloom.llm.shingles import shingle_sets; print([len(s) for s in shingle_sets([{text!r}.encode()], 5)])"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert got.strip() == str([len(plain_sets(text))])


def test_near_duplicate_groups(spark):
    rng = random.Random(4)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            words = base[:]
            for _ in range(rng.randrange(0, max(1, len(words) // 40) + 1)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 501, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: plain_sets(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(awkward).collect())
    assert len(got) == awkward.count()
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert [g[2:] for g in got if g[0] == 7] == [(1, False), (1, False)]
    assert [g[2:] for g in got if g[0] == -1] == [(None, True)]
    assert hyperminhash.near_duplicates(nothing).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.75, 0.95):
        a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        n = round(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**64, 4000 - n, dtype=np.uint64)])
        ra, rb = (hyperminhash.registers(np.unique(x))[None, :] for x in (a, b))
        got, used = hyperminhash.estimated(ra, rb, np.array([4000.0]), np.array([4000.0]))
        assert abs(got[0] - share) < 5 * np.sqrt(share * (1 - share) / used[0]) + 0.01


def test_edit_distance_in_the_band(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, kind = rng.randint(0, len(b)), rng.random()
            if kind < 0.4 or not b:
                b.insert(k, rng.choice("abé"))
            elif kind < 0.7:
                b.pop(min(k, len(b) - 1))
            else:
                b[min(k, len(b) - 1)] = rng.choice("abé")
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for threshold in (1, 2, 3):
        assert df.where(linejoin.within(F.col("a"), F.col("b"), threshold) != (F.levenshtein("a", "b") <= threshold)).count() == 0


def test_a_line_makes_each_key_once(spark):
    """Two edits: three segments that are entered and looked up at once, and nine other pieces; the same piece of lines with other signs has the same key."""
    lines = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",), ("äbcdefghijklmnopqrstuvwx😀z",)], "line string")
    signs, size = linejoin.signs_of(F.col("line")), F.length("line")
    keys = [linejoin.entries(signs, size, 2), linejoin.lookups(signs, size, 2)]
    a, b = lines.select(*(F.array(*some) for some in keys)).collect()
    assert [len(some) for some in a] == [3, 9] and len({*a[0], *a[1]}) == 12
    assert a[0][1] == b[0][1] and a[0][0] != b[0][0] and a[0][2] != b[0][2]


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_classes_and_links(spark, threshold):
    rng = random.Random(threshold)
    lines = ["".join(rng.choice("abcd ") for _ in range(rng.randint(6, 14))) for _ in range(25)]
    for _ in range(60):
        line = list(rng.choice(lines))
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = rng.choice(["", "x", "yz"])
        lines.append("".join(line))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(17)]
    got = linejoin.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), threshold, 8).collect()
    flat = [(i, k, line) for i, t in docs for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, k, line in flat:
        if len(line) >= 8:
            first.setdefault(line, (i, k))

    def near(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            last, row[0] = row[0], row[0] + 1
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1] <= threshold

    want = {}
    for i, k, line in flat:
        others = [o for o in first if line in first and o != line and near(line, o)]
        own = first.get(line, (i, k))
        want[i, k] = (*own, len(others), own == (i, k) and all(first[o] > own for o in others))
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.links, r.kept) for r in got} == want


def test_lines_of_every_length_have_classes_and_links(spark):
    docs = [(1, "All rights reserved.\nok\na line of 23 signs here\n"), (2, "All rights reserved.\nok\nno"), (3, "a line of 23 signs here!\n\nAll rights reserved")]
    got = linejoin.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.links, r.kept) for r in got} == {
        (1, 0): (1, 0, 1, True),
        (1, 1): (1, 1, 0, True),
        (1, 2): (1, 2, 1, True),
        (1, 3): (1, 3, 0, True),
        (2, 0): (1, 0, 1, False),
        (2, 1): (1, 1, 0, False),
        (2, 2): (2, 2, 0, True),
        (3, 0): (3, 0, 1, False),
        (3, 1): (1, 3, 0, False),
        (3, 2): (3, 2, 1, False),
    }


def test_short_lines_link_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = linejoin.lines_of(docs, "doc_id", "text")
    known = lines.where(F.length("line") <= 26).select("line").distinct()
    near = known.alias("a").join(known.alias("b"), (F.col("a.line") != F.col("b.line")) & (F.least(F.length("a.line"), F.length("b.line")) > 2) & (F.levenshtein("a.line", "b.line") <= 2))
    want = {r.line: r.n for r in near.groupBy("a.line").agg(F.count("*").alias("n")).collect()}
    got = QUERIES["op10_segment_line_dedup"](spark, "/root/testdata/sf0.001").join(lines, ["doc_id", "line_no"]).where(F.length("line") <= 24).collect()
    first = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.line_no)):
        assert (r.class_doc_id, r.class_line_no) == first.setdefault(r.line, (r.doc_id, r.line_no))
        assert r.links == want.get(r.line, 0)
    assert any(r.links for r in got) and len(first) < len(got)


def test_short_lines_of_a_document_outlive_its_boilerplate(spark):
    shared = "This line of boilerplate stands in many documents."
    docs = [(1, f"{shared}\nfirst"), (2, f"{shared}\nO rose\nthou art sick"), (3, f"{shared}\nfirst"), (4, f"{shared}\n \n"), (5, f"{shared}\nx\ny"), (6, f"{shared}\ny\nx"), (None, "first of all")]
    got = linejoin.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    # 5 and 6 hold the same rest: one of them stays
    assert {r.doc_id: r.text for r in got} == {1: docs[0][1], 2: "O rose\nthou art sick", 5: "x\ny", None: "first of all"}


def test_lines_of_awkward_rows(awkward, nothing):
    got = linejoin.repeated_lines(awkward).collect()
    assert {r.kept for r in got if r.doc_id in (1, 3, 4, 5, 6, 8, 9, None)} == {True}
    assert [(r.class_doc_id, r.kept) for r in got if r.doc_id == 7] == [(1, False), (1, False)]
    assert not [r for r in got if r.doc_id == 2] and linejoin.repeated_lines(nothing).count() == 0
    cut = linejoin.without_repeats(awkward)
    assert cut.columns == awkward.columns
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert 7 not in {i for i, _ in texts} and (2, None) in texts and (3, "") in texts and (6, "word " * 40_000) in texts and cut.count() == awkward.count() - 2


def test_top_products(spark):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(150, 6)), np.zeros((3, 6)), np.tile(rng.normal(size=6), (30, 1)), rng.normal(size=(40, 6)) * 20])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(1000, None, "x"), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (1020, [float("nan")] * 6, "x"), (1040, [float("inf")] + [0.0] * 5, "x"), (1060, [1.0, 2.0], "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, ids string")
    got = sorted(tuple(r) for r in maxproduct.top_products(df, F.col("vec_id") % 20 == 0, k=7, bucket=16, block=4).collect())
    whole = np.floor(64 * vectors).astype(np.int64)
    want = []
    for q in range(0, len(vectors), 20):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:7]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == want
    assert maxproduct.top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
