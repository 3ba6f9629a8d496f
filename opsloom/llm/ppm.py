"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes with the counts of the
bytes that followed them.  A byte costs what its context's counts say; a byte that did
not follow there costs the context's escape and then what the next shorter context
says (method C: the escape counts as often as there are different followers), down to
256 equally likely bytes.  The counts are frozen before scoring, so the costs of all
contexts and bytes can be laid out once: the contexts of all trees are the states of one
automaton, which steps to the longest known context of what it has read, and a step
adds one cost per language.  The sum is the exact code length of the whole text.

Counting runs as a Spark aggregation.  Trees are fitted on a bounded sample of the
distinct labelled texts, about ``train_docs`` of each language chosen by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.held import drop, held

RESULT = "doc_id {kind}, lang_pred string, score double, bits_per_byte double"
#: Languages whose costs are laid out in one table; with more, a text is scored table by table.
PER_TABLE = 16
#: Bytes that are stepped through side by side with those of other pieces of text.
PIECE = 256
#: Bytes of text scored at once, and bytes of training text counted at once.
BATCH_BYTES, COUNT_BYTES = 2 << 20, 2 << 20
#: Contexts whose costs are copied at once.
SLICE = 4096


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _count_grams(order: int):
    """A task that counts, per language, each byte with the up to ``order`` bytes before it: (length of context, bytes as a number)."""

    def counted(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for k in range(order + 1):
            lists = []
            for text in texts:
                data = np.frombuffer(text, np.uint8).astype(np.int64)
                n = max(0, len(data) - k)
                lists.append(sum((data[k - i : k - i + n] << 8 * i for i in range(k + 1)), np.zeros(n, np.int64)))
            values, counts = np.unique(np.concatenate(lists), return_counts=True)
            columns = [pa.array([lang] * len(values), pa.string()), pa.array([k] * len(values), pa.int32()), pa.array(values), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "gram", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()  # what an earlier stage kept
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                some, size = [], 0
                for i in (i for i, x in enumerate(langs) if x == lang):
                    text = batch.column("text")[i].as_py()
                    if some and size + len(text) > COUNT_BYTES:
                        yield from counted(lang, some)
                        some, size = [], 0
                    some.append(text)
                    size += len(text)
                yield from counted(lang, some)

    return task


class Model:
    """Frozen counts of all languages; ``tables`` lays out their costs."""

    def __init__(self, languages: list[str], grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.languages, self.order = languages, order
        #: Per (language number, context length): grams (context bytes and the following byte as one number) ascending, and counts.
        self.grams = grams

    def tables(self) -> list[Table]:
        """The tables of this model, about 1.3 KB a context for four languages; a worker keeps them until it needs something else."""
        return held(self.grams, lambda: [Table(self, range(i, min(i + PER_TABLE, len(self.languages)))) for i in range(0, len(self.languages), PER_TABLE)])

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        return np.concatenate([table.bits(texts) for table in self.tables()], axis=1) if self.languages else np.zeros((len(texts), 0))


class Table:
    """The automaton of a few languages: next state and costs by state and byte."""

    def __init__(self, model: Model, some: range) -> None:
        self.order = model.order
        grams = {k: [model.grams[lang, k] for lang in some] for k in range(model.order + 1)}
        seen = np.unique(np.concatenate([g for g, _ in grams[0]]))
        #: Bytes by number: 0 starts anew and costs nothing, 1 is any byte that no language knows.
        self.number = np.ones(256, np.uint16)
        self.number[seen] = np.arange(2, len(seen) + 2)
        width = len(seen) + 2
        contexts = [np.zeros(1, np.int64)] + [np.unique(np.concatenate([g >> 8 for g, _ in grams[k]])) for k in range(1, model.order + 1)]
        first = np.cumsum([0] + [len(c) for c in contexts])
        states = int(first[-1])
        move = np.zeros((states, width), np.int32)
        cost = np.zeros((states, width, len(some)), np.float32)
        cost[0, 1:] = 8.0
        for k, own in enumerate(contexts):
            ids = np.arange(first[k], first[k + 1])
            if k:
                shorter = first[k - 1] + np.searchsorted(contexts[k - 1], own & ((1 << 8 * (k - 1)) - 1))
                for a in range(0, len(own), SLICE):  # no second copy of the table beside it
                    part, source = slice(first[k] + a, first[k] + min(a + SLICE, len(own))), shorter[a : a + SLICE]
                    move[part], cost[part] = move[source], cost[source]
            for lang, (gram, count) in enumerate(grams[k]):
                if not len(gram):
                    continue
                at = np.searchsorted(own, gram >> 8)
                total = np.bincount(at, count, len(own))
                kinds = np.bincount(at, minlength=len(own))
                known = total > 0
                escape = np.log2((total + kinds)[known] / kinds[known])
                for a in range(0, len(escape), SLICE):
                    cost[ids[known][a : a + SLICE], 1:, lang] += escape[a : a + SLICE, None].astype(np.float32)
                cost[ids[at], self.number[gram & 255], lang] = np.log2((total + kinds)[at] / count)
            if k < model.order:  # the context with its byte is a context too: step there
                longer = contexts[k + 1]
                at = np.searchsorted(own, longer >> 8)
                move[ids[at], self.number[longer & 255]] = first[k + 1] + np.arange(len(longer))
        cost[:, 0] = 0
        move[:, 0] = 0
        self.width, self.move, self.cost = width, move.ravel(), cost.reshape(-1, len(some))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // PIECE)
        out = np.zeros((len(texts), self.cost.shape[1]))
        if not pieces.sum():
            return out
        codes = np.zeros(int(lengths.sum()) + 1, self.number.dtype)  # the largest array beside the tables: two bytes a byte of text
        codes[1:] = self.number[np.frombuffer(b"".join(texts), np.uint8)]
        start = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(texts)), pieces)
        at = start[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        end = start[doc] + lengths[doc]
        state = np.zeros(len(doc), np.int64)
        total = np.zeros((len(doc), out.shape[1]))
        # the bytes before a piece bring the automaton to its state; they are not charged again
        for step in range(-self.order, PIECE):
            place = at + step
            inside = (place < end) & (place >= start[doc])
            cell = state * self.width + codes[np.where(inside, place + 1, 0)]
            if step >= 0:
                total += self.cost[cell]
            state = self.move[cell].astype(np.int64)
        np.add.at(out, doc, total)
        return out


def fit(docs: DataFrame, order: int = 4, train_docs: int = 1000, longest: int = 1 << 20, least: int = 2, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Trees of all languages of ``docs``.

    Rows without a language or a letter, and texts of more than ``longest`` bytes, teach nothing,
    so what is counted is bounded by ``train_docs * longest`` bytes a language.  About ``train_docs`` distinct texts of
    each language are taken, by a hash of the text, whole and once each, however many rows
    share one; contexts met fewer than ``least``
    times in a language are left out of its tree.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where(F.col("lang").isNotNull() & (F.octet_length("text") <= longest) & has_letter(F.col("text")))
    share = F.lit(0.0)
    for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect():  # one row per language
        share = F.when(F.col("lang") == r["lang"], F.lit(train_docs / max(1, r["texts"]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", F.col("text").cast("binary").alias("text")).distinct()
    counted = sample.mapInArrow(_count_grams(order), "lang string, k int, gram bigint, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    # bounded by the sample, not by the table
    known = counted.toArrow()
    lang = known.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    number_of = np.array([languages.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    numbers = number_of[lang.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
    lengths, all_grams, all_counts = (known.column(c).to_numpy() for c in ("k", "gram", "n"))
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for number in range(len(languages)):
        for k in range(order + 1):
            own = (numbers == number) & (lengths == k)
            gram, n = all_grams[own].astype(np.int64), all_counts[own].astype(np.int64)
            by = np.argsort(gram)
            gram, n = gram[by], n[by]
            if k:
                _, group = np.unique(gram >> 8, return_inverse=True)
                keep = np.bincount(group, n)[group] >= least if len(gram) else np.zeros(0, bool)
                gram, n = gram[keep], n[keep]
            grams[number, k] = gram, n
    return Model(languages, grams, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each row by the shortest code: ``doc_id, lang_pred, score, bits_per_byte``.

    The whole text is coded.  A null text and one without a letter, and every text if no
    language was learned, is ``und`` with score 0.  ``score`` is the share of the best
    language in 2^-bits of all; equal code lengths go to the first language by name.
    ``bits_per_byte`` is the best code length over the bytes (null for ``und``).  Repeated
    rows each have a row; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), F.when(has_letter(text), text).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            text = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
            i = 0
            while i < len(sizes):
                j, size = i, 0
                while j < len(sizes) and (j == i or size < BATCH_BYTES):
                    size += sizes[j]
                    j += 1
                some = text.slice(i, j - i).to_pylist()
                bits = model.bits([t or b"" for t in some])
                if model.languages:
                    best = bits.argmin(axis=1)
                    least = bits.min(axis=1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                columns: list[list] = [[], [], []]
                for k, t in enumerate(some):
                    known = t is not None and bool(model.languages)
                    for column, value in zip(columns, (model.languages[best[k]], float(score[k]), float(least[k] / len(t))) if known else ("und", 0.0, None)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])
                i = j

    return rows.mapInArrow(task, RESULT.format(kind=kind))
