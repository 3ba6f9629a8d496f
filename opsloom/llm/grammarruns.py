"""Periodic runs of words, found on a Re-Pair grammar of the texts of a batch.

Re-Pair replaces pairs of neighbours that occur again by new symbols, here in rounds: a round
counts all pairs and replaces, at the same time, each occurrence whose pair is more frequent
than the pairs that overlap it.  What no round shortens any more, the start sequence of each
text, is paired up to a balanced tree.  Every node of the derivation then has two halves, and a
run lies in the smallest node that holds it and crosses the middle of that node.  A symbol has the
same runs wherever it is derived, so they are computed once, at its first place, and moved to its
other places.  Parts of a run that lower nodes have found lie inside the whole of it and are merged.

A run of period q and length 4 q that crosses the middle covers 2 q words on one side of it, so a
node of n words has to test a square of each period up to n / 4 on either side: one comparison of
words, then of block hashes (two polynomials modulo 2^31 - 1), then a binary search for both ends.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many periods, and at least so many words.
LEAST_PERIODS = 4
LEAST_WORDS = 6
#: Rounds of replacement at most; the balanced tree takes over from whatever they leave.
ROUNDS = 32
#: A round that replaces fewer occurrences than one symbol in so many is the last.
WORTH = 64
#: Texts are treated together until they have so many bytes; a longer text is treated alone, whole.
BATCH_BYTES = 1 << 21

_PRIME = np.uint64((1 << 31) - 1)
_BASES = (np.uint64(1_102_911_371), np.uint64(744_190_261))
_powers = [np.ones(1, np.uint64)] * 2


def _powers_to(n: int) -> list[np.ndarray]:
    """The powers of both bases, kept for the next batch."""
    for k, base in enumerate(_BASES):
        while len(_powers[k]) <= n:
            known = _powers[k]
            step = known[-1] * base % _PRIME
            _powers[k] = np.concatenate([known, known * step % _PRIME])
    return _powers


class Blocks:
    """Comparison of blocks of a sequence of numbers by hash."""

    def __init__(self, words: np.ndarray) -> None:
        self.powers = _powers_to(len(words))
        values = words.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p[: len(words)] % _PRIME, dtype=np.uint64) % _PRIME]) for p in self.powers]

    def equal(self, at: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the blocks of ``size`` at ``at`` and at ``at + shift`` are equal."""
        out = np.ones(len(at), bool)
        for sums, powers in zip(self.sums, self.powers):
            first = (sums[at + size] + _PRIME - sums[at]) % _PRIME
            second = (sums[at + shift + size] + _PRIME - sums[at + shift]) % _PRIME
            out &= first * powers[shift] % _PRIME == second
        return out

    def reach(self, at: np.ndarray, shift: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How far the sequence agrees with itself ``shift`` later from ``at``, ``limit`` at most, or backwards in front of it."""
        low, high = np.zeros_like(limit), limit.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            good = self.equal(at - middle if back else at, shift, middle)
            low = np.where(open_ & good, middle, low)
            high = np.where(open_ & ~good, middle - 1, high)
        return low


class Nodes:
    """Derivations of symbols by pairs: the first word of each, and the sizes of its halves."""

    def __init__(self, start: np.ndarray, left: np.ndarray, right: np.ndarray, symbol: np.ndarray) -> None:
        self.start, self.left, self.right, self.symbol = start, left, right, symbol


class Grammar:
    """Re-Pair over several texts at once: ``rules`` (pairs of symbols, after the ``terminals``), the start ``sequence`` with its texts, and the nodes of each round."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray) -> None:
        self.terminals = int(words.max()) + 1 if len(words) else 0
        self.rules: list[np.ndarray] = []
        self.rounds: list[Nodes] = []
        self.sequence = words.astype(np.int64)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.start = np.arange(len(words))
        self.size = np.ones(len(words), np.int64)
        self.symbols = self.terminals
        while len(self.rounds) < ROUNDS and self._round():
            pass

    def _round(self) -> bool:
        """Replace pairs; whether another round is worth it."""
        seq = self.sequence
        if len(seq) < 2:
            return False
        key = seq[:-1] * self.symbols + seq[1:]
        inside = self.text[:-1] == self.text[1:]
        code, pairs = pd.factorize(key[inside])
        count = np.bincount(code, minlength=len(pairs))
        # more frequent pairs first, then by a permutation of their numbers, so that a passage of equal counts
        # is cut at many places at once; no two pairs weigh alike, and one met once is never replaced
        mixed = np.arange(len(pairs), dtype=np.int64) * 0x9E3779B1 & 0xFFFFFFFF
        weight = np.zeros(len(key), np.int64)
        weight[inside] = np.where(count > 1, (count << 32) + mixed, 0)[code]
        around = np.concatenate([[0], weight, [0]])
        best = (weight > 0) & (weight >= around[:-2]) & (weight >= around[2:])
        # in a chain such as a a a a the pair overlaps itself: every other place
        place = np.arange(len(weight))
        chain = np.maximum.accumulate(np.where(weight != around[:-2], place, 0))
        chosen = np.flatnonzero(best & ((place - chain) % 2 == 0))
        code, pairs = pd.factorize(key[chosen])
        again = np.bincount(code, minlength=len(pairs))[code] > 1 if len(code) else np.zeros(0, bool)
        chosen = chosen[again]
        if not len(chosen):
            return False
        code, pairs = pd.factorize(key[chosen])
        self.rules.append(np.stack([pairs // self.symbols, pairs % self.symbols], axis=1))
        self.rounds.append(Nodes(self.start[chosen], self.size[chosen], self.size[chosen + 1], code))
        self.sequence = seq.copy()
        self.sequence[chosen] = self.symbols + code
        self.size[chosen] += self.size[chosen + 1]
        self.symbols += len(pairs)
        stays = np.ones(len(seq), bool)
        stays[chosen + 1] = False
        self.sequence, self.text, self.start, self.size = self.sequence[stays], self.text[stays], self.start[stays], self.size[stays]
        return len(chosen) * WORTH >= len(seq)

    def expanded(self) -> np.ndarray:
        """All words again, by the rules alone."""
        rules = np.concatenate(self.rules) if self.rules else np.zeros((0, 2), np.int64)
        seq = self.sequence
        while len(seq) and seq.max() >= self.terminals:
            wide = seq >= self.terminals
            out = np.stack([seq, np.full(len(seq), -1)], axis=1)
            out[wide] = rules[seq[wide] - self.terminals]
            seq = out[out >= 0]
        return seq

    def tree(self) -> Iterator[Nodes]:
        """The levels of the balanced tree over each text's start sequence; no node occurs twice."""
        text, start, size = self.text, self.start, self.size
        while len(text) > 1:
            first = np.concatenate([[True], text[1:] != text[:-1]])
            place = np.arange(len(text))
            place = place - np.maximum.accumulate(np.where(first, place, 0))
            pair = np.flatnonzero((place[:-1] % 2 == 0) & ~first[1:])
            if not len(pair):
                return
            yield Nodes(start[pair], size[pair], size[pair + 1], np.arange(len(pair)))
            size = size.copy()
            size[pair] += size[pair + 1]
            stays = np.ones(len(text), bool)
            stays[pair + 1] = False
            text, start, size = text[stays], start[stays], size[stays]


def _crossing(words: np.ndarray, blocks: Blocks, start: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``node, from, to, period`` of the runs across the middle of each node, as far as they lie in it."""
    found = []
    middle = start + left
    for behind in (True, False):
        half = right if behind else left
        limit = np.minimum(half // 2, (left + right) // LEAST_PERIODS)
        limit[left + right < LEAST_WORDS] = 0
        node = np.repeat(np.arange(len(start)), limit)
        period = np.arange(len(node)) - np.repeat(np.cumsum(limit) - limit, limit) + 1
        at = middle[node]
        hit = np.flatnonzero(words[at] == words[at + period] if behind else words[at - 1] == words[at - 1 - period])
        node, period = node[hit], period[hit]
        # the first of two neighbouring blocks of the period
        at = middle[node] if behind else middle[node] - 2 * period
        hit = np.flatnonzero(blocks.equal(at, period, period))
        found.append((node[hit], period[hit], middle[node[hit]] if behind else middle[node[hit]] - period[hit]))
    node, period, at = (np.concatenate(parts) for parts in zip(*found))
    low = at - blocks.reach(at, period, at - start[node], back=True)
    high = at + period + blocks.reach(at, period, (middle + right)[node] - at - period, back=False)
    long = high - low >= np.maximum(LEAST_PERIODS * period, LEAST_WORDS)
    node, low, high, period = node[long], low[long], high[long], period[long]
    # a stretch with more than one period has the smallest; the others are multiples of it
    order = np.lexsort((period, high, low, node))
    node, low, high, period = node[order], low[order], high[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return node[new], low[new], high[new], period[new]


def maximal_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``from, to, period`` of all maximal runs, by start and period; text t is ``words[bounds[t]:bounds[t + 1]]``, and no run leaves its text."""
    grammar = Grammar(words, bounds)
    blocks = Blocks(words)
    lows, highs, periods = [], [], []
    for nodes in grammar.rounds:
        order = np.argsort(nodes.symbol, kind="stable")
        first = order[np.searchsorted(nodes.symbol[order], np.arange(nodes.symbol.max() + 1))]
        symbol, low, high, period = _crossing(words, blocks, nodes.start[first], nodes.left[first], nodes.right[first])
        if not len(symbol):
            continue
        # to every place where the symbol is derived
        at = np.searchsorted(nodes.symbol[order], symbol)
        times = np.searchsorted(nodes.symbol[order], symbol, "right") - at
        run = np.repeat(np.arange(len(symbol)), times)
        place = order[at[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)]
        shift = nodes.start[place] - nodes.start[first][symbol[run]]
        lows.append(low[run] + shift)
        highs.append(high[run] + shift)
        periods.append(period[run])
    for nodes in grammar.tree():
        _, low, high, period = _crossing(words, blocks, nodes.start, nodes.left, nodes.right)
        lows.append(low)
        highs.append(high)
        periods.append(period)
    none = [np.zeros(0, np.int64)]
    low, high, period = (np.concatenate(none + parts) for parts in (lows, highs, periods))
    # a part of a run lies inside the whole, which has the same period and begins no later
    order = np.lexsort((-high, low, period))
    low, high, period = low[order], high[order], period[order]
    # ends of smaller periods stay below those of larger ones once a step is added to each
    step = len(words) + 1
    lifted = high + period * step
    before = np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]]) if len(high) else lifted
    whole = lifted > np.where(before // step == period, before, -1)
    low, high, period = low[whole], high[whole], period[whole]
    order = np.lexsort((period, high, low))
    low, high, period = low[order], high[order], period[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    low, high, period = low[new], high[new], period[new]
    order = np.lexsort((period, low))
    return low[order], high[order], period[order]


def drill(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the checksum of its id repeats a stretch of itself up to its end; a null id has no checksum."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def described(texts: list[list[bytes]]) -> Iterator[tuple]:
    """``n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of each text, given as its words."""
    flat = [word for text in texts for word in text]
    words, _ = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), None)
    bounds = np.concatenate([[0], np.cumsum([len(text) for text in texts], dtype=np.int64)])
    low, high, period = maximal_runs(words, bounds)
    cuts = np.zeros(len(words) + 1, np.int64)
    np.add.at(cuts, low + period, 1)
    np.add.at(cuts, high, -1)
    kept = np.cumsum(cuts)[:-1] == 0
    edges = np.searchsorted(low, bounds)
    for text, a, i, j in zip(texts, bounds.tolist(), edges.tolist(), edges[1:].tolist()):
        if i == j:
            yield 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(text)).hexdigest()
            continue
        starts, sizes, steps = (low[i:j] - a).tolist(), (high[i:j] - low[i:j]).tolist(), period[i:j].tolist()
        size, start, step = max((size, -start, -step) for start, size, step in zip(starts, sizes, steps))
        step, start = -step, -start
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(starts, sizes, steps))
        rest = b" ".join(compress(text, kept[a : a + len(text)]))
        yield j - i, start, size, step, 1000 * size // step, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


_SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _batches(ids: Iterable[int | None], texts: Iterable[bytes | None], drilled: bool) -> Iterator[tuple[list, list]]:
    """Ids and words of as many texts as are treated together."""
    some_ids, some, size = [], [], 0
    for doc_id, text in zip(ids, texts):
        if some and size + len(text or b"") > BATCH_BYTES:
            yield some_ids, some
            some_ids, some, size = [], [], 0
        words = (text or b"").split()
        some_ids.append(doc_id)
        some.append(drill(words, doc_id) if drilled else words)
        size += len(text or b"")
    if some:
        yield some_ids, some


def periodic_runs(docs: DataFrame, drilled: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal periodic runs of words of each text, and the text without their repeats, as checksums.

    A row per row of ``docs``.  The run named is the longest one (the first of those, then the one of
    least period); a text without a run, without words or null has ``n_runs`` 0 and nulls there, and
    the checksum of no line.  Dropped are the words of a run behind its first period.  With ``drilled``, every tenth document is
    first made periodic (see ``drill``).  Texts of any length are treated whole, in memory of about 250
    bytes a word; equal rows, null ids and empty tables need no care; other columns are ignored.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column("text"))
            for ids, some in _batches(batch.column("doc_id").to_pylist(), texts, drilled):
                columns = [ids, *zip(*described(some))]
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _SCHEMA.split(", ")])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)
