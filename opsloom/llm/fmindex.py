"""Benchmark decontamination with an FM-index per shard of training documents.

Words are numbered by the test set's vocabulary; any other word is a separator, as no
test phrase can hold it, and so is the end of a document.  What lies between two
separators and is shorter than the shortest phrase cannot hold a phrase either, so the
indexed text is the rest.  Each shard's suffixes are sorted, its Burrows-Wheeler text
goes into a wavelet matrix, and all phrases are searched backwards at once, two ranks
per symbol.  The rows found are located by walking to the next sampled suffix, and the
places become word spans, which are merged per document.

A shard ends after ``shard_words`` words, so a task's memory is bounded by that and one
document.  The test set is searched in blocks of ``block_words`` words, which bounds what
is broadcast; each further block is a further pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.held import drop

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = "array<struct<start: int, end: int>>"


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z."""
    return text.translate(_BYTES).split() if text else []


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text in order, by doubling; a separator (0) comes first and differs from every other."""
    n, ends = len(text), int((text == 0).sum())
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text.astype(np.int64) + ends - 1)
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    # a suffix with an own rank is done: later steps sort only the tied ones
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        same = np.zeros(n, bool)
        same[1:] = sorted_rank[1:] == sorted_rank[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        some = order[at]
        # rank is the place of a tied group's first member, so groups keep their places
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        rank[order] = first
        after = rank[np.minimum(some + step, n - 1)]
        by = np.lexsort((after, rank[some]))
        some = some[by]
        order[at] = some
        key, after = rank[some], after[by]
        new = np.ones(len(some), bool)
        new[1:] = (key[1:] != key[:-1]) | (after[1:] != after[:-1])
        rank[some] = at[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        step *= 2


class FMIndex:
    """Counts and places of phrases in a text of numbers from 1, in which 0 separates; the text ends with 0."""

    def __init__(self, text: np.ndarray, sample: int = 32) -> None:
        self.n = n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        size = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels = max(1, (size - 1).bit_length())
        #: Per bit of the wavelet matrix: ones before each place, and the number of zeros.
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rows = last
        for level in reversed(range(self.levels)):
            bits = (rows >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(int(n - bits.sum()))
            rows = np.concatenate([rows[~bits], rows[bits]])
        # suffixes at every ``sample``-th place, and those that follow a separator, where a walk would end
        self.sampled = (order % sample == 0) | (last == 0)
        self.places = order[self.sampled]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before each place."""
        low, high = np.zeros_like(places), places
        for ones, zeros, level in zip(self.ones, self.zeros, reversed(range(self.levels))):
            bit = (symbols >> level & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes start with each phrase."""
        lengths = np.array([len(p) for p in phrases], np.int64)
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        flat, starts = np.concatenate(phrases).astype(np.int64), np.cumsum(lengths) - lengths
        for back in range(1, int(lengths.max()) + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            symbols = flat[starts[live] + lengths[live] - back]
            known = symbols < len(self.first) - 1
            low[live[~known]] = high[live[~known]] = 0
            some, symbols = live[known], symbols[known]
            low[some] = self.first[symbols] + self.rank(symbols, low[some])
            high[some] = self.first[symbols] + self.rank(symbols, high[some])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of some rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        away = np.flatnonzero(~self.sampled[rows])
        while len(away):
            place, symbol = rows[away], np.zeros(len(away), np.int64)
            for ones, zeros in zip(self.ones, self.zeros):
                before = ones[place]
                bit = ones[place + 1] > before
                place = np.where(bit, zeros + before, place - before)
                symbol = symbol << 1 | bit
            rows[away] = self.first[symbol] + self.rank(symbol, rows[away])
            steps[away] += 1
            away = away[~self.sampled[rows[away]]]
        return self.places[self.sampled_before[rows]] + steps


class Phrases:
    """Windows of test items: ``width`` consecutive words each, or the whole item if it has fewer."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.numbers: dict[bytes, int] = {}
        by_words: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            found = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            for i in range(max(1, len(found) - width + 1) if found else 0):
                by_words[found[i : i + width]].add(item)
        self.phrases = [np.array(p, np.int32) for p in by_words]
        self.items = [sorted(x) for x in by_words.values()]
        self.shortest = min(map(len, self.phrases), default=0)

    def hits(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Merged word spans and items per document of a shard."""
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[str]] = [set() for _ in docs]
        if not self.phrases or not docs:
            return spans, items
        get = self.numbers.get
        text = np.concatenate([np.array([get(w, 0) for w in d] + [0], np.int32) for d in docs])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], text > 0, [0]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return spans, items
        # each run with the separator behind it
        sizes = ends - starts + 1
        places = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        index = FMIndex(text[places])
        low, high = index.search(self.phrases)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        rows = np.arange(counts.sum()) + np.repeat(low[found] - (np.cumsum(counts) - counts), counts)
        phrase = np.repeat(found, counts)
        at = places[index.locate(rows)]
        firsts = np.cumsum([0] + [len(d) + 1 for d in docs])
        doc = np.searchsorted(firsts, at, side="right") - 1
        for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0).tolist():
            items[d].update(self.items[p])
        lengths = np.array([len(p) for p in self.phrases])[phrase]
        cover = np.cumsum(np.bincount(at, minlength=len(text) + 1) - np.bincount(at + lengths, minlength=len(text) + 1)) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            d = int(np.searchsorted(firsts, start, side="right")) - 1
            spans[d].append((start - int(firsts[d]), end - int(firsts[d])))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some spans and what stands between them; a line break takes each span's place."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]].rstrip())
        at = places[end - 1][1]
    return "\n".join([*out, text[at:].lstrip()]).strip("\n")


def _search(phrases: Callable[[], Phrases], again: bool, last: bool, cut: bool, shard_words: int, id_kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of one pass: spans and items of one block of phrases, added to those of the passes before."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases()
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            found = known.hits([row[2] for row in held])
            columns: list[list] = [[] for _ in range(6)]
            for (doc_id, text, parts, old_spans, old_items), spans, items in zip(held, *found):
                spans, items = (merged(old_spans + spans), sorted({*old_items, *items})) if again else (spans, sorted(items))
                clean = cut_spans(text.decode(), spans) if last and cut and spans else None
                for column, value in zip(columns, (doc_id, None if last else text, len(parts), [{"start": a, "end": b} for a, b in spans], items, clean)):
                    column.append(value)
            held.clear()
            kinds = [id_kind, pa.binary(), pa.int64(), span, pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text", "n_words", "spans", "items", "clean_text"])

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for i, (doc_id, text) in enumerate(zip(lists[0], lists[1])):
                before = ([(s["start"], s["end"]) for s in lists[2][i]], lists[3][i]) if again else ([], [])
                held.append((doc_id, text, words(text), *before))
                count += len(held[-1][2]) + 1
                if count >= shard_words:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return task


def contamination(docs: DataFrame, tests: DataFrame, width: int = 10, cut: bool = False, shard_words: int = 1_000_000, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document the spans of words that lie in an occurrence of a test phrase, and the items with such phrases.

    Columns: ``doc_id, n_words, spans, items`` and, with ``cut``, ``clean_text``: the text
    without its spans (null where there is none).  One row per row of ``docs``, repeated
    ids included.  Null and empty texts have no words; items without words, an empty test
    set and an empty table hit nothing.  Items are named as strings; rows of ``tests``
    with one id are one item.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_kind = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    items = tests.select(tests[item_col].cast("string").alias("item"), tests[item_text_col].cast("string").cast("binary").alias("text")).where("text is not null")
    # words are at least a byte and what follows it
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 2 / block_words))
    for block in range(blocks):
        # at most about block_words words, by the size measured above
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in some.collect()])
        last = block == blocks - 1
        task = _search(lambda sent=sent: Phrases(sent.value, width), block > 0, last, cut, shard_words, id_kind)
        rows = rows.select("doc_id", "text", *(["spans", "items"] if block else [])).mapInArrow(task, f"doc_id {kind}, text binary, n_words bigint, spans {SPANS}, items array<string>, clean_text string")
    return rows.drop("text", *([] if cut else ["clean_text"]))
