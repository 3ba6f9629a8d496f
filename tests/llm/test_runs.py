"""Periodic runs against a comparison of every word with those in front of it."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from opsloom.llm import grammarruns
from opsloom.llm.catalog import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period in turn: maximal stretches that agree with themselves one period later."""
    n, found = len(words), {}
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end + q - start >= max(6, 4 * q):
                found.setdefault((start, end + q), q)  # the least period comes first
    return sorted((s, e - s, q) for (s, e), q in found.items()) if found else []


def plain_row(doc_id, text, drilled=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if drilled and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    lines = sha("".join(f"{s},{size},{q}\n" for s, size, q in runs))
    if not runs:
        return doc_id, 0, None, None, None, None, lines, kept
    start, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return doc_id, len(runs), start, size, q, 1000 * size // q, lines, kept


def key(row):
    return tuple(str(x) for x in row)


def test_whole_table(spark):
    docs = table(spark, FOLDER, "documents").collect()
    got = sorted(map(tuple, QUERIES["op12_grammar_runs"](spark, FOLDER).collect()), key=key)
    want = sorted((plain_row(r.doc_id, r.text) for r in docs), key=key)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 5


def test_awkward_rows(spark, awkward, nothing):
    got = sorted(map(tuple, grammarruns.periodic_runs(awkward).collect()), key=key)
    by_id = {r[0]: r for r in got}
    assert by_id[6][1:6] == (1, 0, 40_000, 1, 40_000_000) and by_id[6][7] == hashlib.sha256(b"word").hexdigest()
    assert len(got) == awkward.count()
    assert all(r == plain_row(r[0], {x.doc_id: x.text for x in awkward.collect()}[r[0]], drilled=False) for r in got if r[0] != 6)
    assert grammarruns.periodic_runs(nothing, drilled=True).count() == 0


def random_text(rng):
    """Words of a small alphabet with nested repeats and repeated passages."""
    out = [rng.choice("abc") for _ in range(rng.randrange(4))]
    for _ in range(rng.randrange(6)):
        kind = rng.random()
        if kind < 0.5:
            unit = out[-rng.randrange(1, 12) :] if out and rng.random() < 0.6 else [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
            out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        else:
            out += [rng.choice("abcdefgh") for _ in range(rng.randrange(8))]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_batches(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 9))]
        texts += [rng.choice(texts)[:] for _ in range(rng.randrange(3))]
        numbers = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        low, high, period = grammarruns.maximal_runs(words, bounds)
        got = [(s, e - s, q) for s, e, q in zip(low.tolist(), high.tolist(), period.tolist())]
        want = [(s + a, n, q) for t, a in zip(texts, bounds.tolist()) for s, n, q in plain_runs(t)]
        assert sorted(got) == sorted(want)
        assert grammarruns.Grammar(words, bounds).expanded().tolist() == words.tolist()


def test_batches_keep_long_texts_whole(monkeypatch):
    monkeypatch.setattr(grammarruns, "BATCH_BYTES", 10)
    texts = [b"a b c", b"d " * 40, None, b"", b"e f", b"g h i j"]
    parts = list(grammarruns._batches(range(6), texts, False))
    assert [i for ids, _ in parts for i in ids] == list(range(6))
    assert [w for _, some in parts for w in some] == [(t or b"").split() for t in texts]
    assert len(parts) > 2


def test_symbols_of_a_repeated_passage_are_derived_at_all_places():
    passage = list(range(40))
    words = np.array(passage * 3 + [99] + passage, np.int64)
    grammar = grammarruns.Grammar(words, np.array([0, 120, 161]))
    assert len(grammar.sequence) < 20
    assert all((np.bincount(nodes.symbol) >= 2).all() for nodes in grammar.rounds)
