"""How filters in a row act on each other: removals per order and step, from one table of counts.

Spark counts the rows of each part by the set of filters that they fail: 2 ** n counts, whatever
the size of the part.  Reshaped to 2 x 2 x ... (axis f: passes or fails filter f) they are a
contingency tensor, and every figure of every order is a contraction of it that selects pass,
fail or all along each axis: a row that reaches a step passes the filters before it, one that
the step removes also fails its own, and the filters after it may do either.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: Blanks between words.
_BLANKS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each of the filters A to D."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    # the words are cut once and their two counts kept side by side
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {
        "A": counts["n"] < 50,
        "B": counts["distinct"].cast("bigint") * 100 < counts["n"].cast("bigint") * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.length(text).cast("bigint") * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: rows per part and set of failed filters, bit 0 for A to bit 4 for E.

    E fails if an equal text has a smaller id in any part.  Equal texts are compared by SHA-256.  The
    rows of one text are counted by part, labels and id first, so a text that a third of the rows
    share is a few rows per part when its least id is looked for, and no text is shuffled.  A null id is neither smaller
    nor larger than another, so its row passes E; equal rows of one id do not fail by each other.
    A row is good (toxic) if any label of its id has quality (toxic) 1.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    known = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # each flag alone, so that the words are cut for A and B together
    rows = known.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.struct(*(fails.alias(f) for f, fails in text_filters(F.col("text")).items())).alias("fails"))
    mask = sum((F.col(f"fails.{f}").cast("int") * (1 << i) for i, f in enumerate("ABCD")), F.lit(0))
    rows = rows.select("id", "part", "digest", mask.alias("mask"))
    marks = labels.groupBy(labels[id_col].alias("id")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    per_id = marked.groupBy("id", *kind).agg(F.count("*").alias("n"))
    per_kind = per_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    least = per_kind.groupBy("digest").agg(F.min("first.id").alias("least"))
    both = per_kind.join(least, "digest")
    original = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    halves = F.explode(F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n"))))
    split = both.select("part", "good", "toxic", halves.alias("h")).select("part", "good", "toxic", "h.mask", "h.n")
    count = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def contract(tensor: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """``tensor`` (measure, 2, 2, ...) contracted with each row of ``selectors`` (row, axis, 2): (row, measure)."""
    axes = selectors.shape[1]
    rest = list(range(2, axes + 2))
    out = tensor
    # one axis after another, the last first; the first contraction makes the axis of rows
    out = np.einsum(out, [1, *rest], selectors[:, -1], [0, rest[-1]], [0, 1, *rest[:-1]])
    for axis in range(axes - 2, -1, -1):
        out = np.einsum(out, [0, 1, *rest[: axis + 1]], selectors[:, axis], [0, rest[axis]], [0, 1, *rest[:axis]])
    return out


class Orders:
    """The selectors of every step of every order of ``n`` filters."""

    def __init__(self, n: int) -> None:
        self.names = ["".join(p) for p in permutations("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:n])]
        self.steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(self.names))
        self.filter = np.array([p for p in permutations(range(n))]).reshape(-1)
        place = np.argsort(self.filter.reshape(-1, n), axis=1)  # of each filter in its order
        at = np.repeat(place, n, axis=0) - np.tile(np.arange(n), len(self.names))[:, None]
        pick = lambda before, own, after: np.where((at < 0)[..., None], before, np.where((at == 0)[..., None], own, after)).astype(np.int64)
        self.kept, self.removed = pick(PASS, PASS, ALL), pick(PASS, FAIL, ALL)
        self.failing, self.alone = pick(ALL, FAIL, ALL), pick(PASS, FAIL, PASS)

    def figures(self, tensor: np.ndarray) -> dict[str, np.ndarray]:
        """The figures of one part, a value per order and step; ``tensor`` counts rows, good rows and toxic rows."""
        everything = tensor[:1]
        removed = contract(tensor, self.removed)
        own = np.zeros(self.filter.max() + 1, np.int64)
        np.add.at(own, self.filter, removed[:, 0])
        return {
            "kept": contract(everything, self.kept)[:, 0],
            "removed": removed[:, 0],
            "redundant": contract(everything, self.failing)[:, 0] - removed[:, 0],
            "unique_fails": contract(everything, self.alone)[:, 0],
            "good_lost": removed[:, 1],
            "toxic_lost": removed[:, 2],
            "shapley": own[self.filter],
        }


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, n_filters: int = 5) -> DataFrame:
    """``part, filter_order, step`` and the figures, from ``part, mask, n, good, toxic``.

    One row per part, order of the filters and step, zeros included: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fail it, but went before), ``unique_fails`` (fail nothing
    else), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``, the rows that its
    filter removes summed over all orders.  A part is 2 ** n counts at most, so parts of any size
    weigh the same; a task holds one batch of parts.  No part, no row.
    """
    if factorial(n_filters) * n_filters > 100_000:
        raise ValueError("seven filters at most")
    cells = F.collect_list(F.struct("mask", F.array("n", "good", "toxic").alias("counts")))
    parts = counts.groupBy("part").agg(cells.alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(n_filters)
        names = pa.array(np.repeat(np.array(orders.names, object), n_filters), pa.string())
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                flat = np.zeros((3, 1 << n_filters), np.int64)
                for cell in cells:
                    flat[:, cell["mask"]] = cell["counts"]
                # bit f of the mask is axis f, so the axes of the reshaped counts run backwards
                tensor = flat.reshape(3, *[2] * n_filters).transpose(0, *range(n_filters, 0, -1))
                found = orders.figures(tensor)
                columns = [pa.array([part] * len(names), pa.string()), names, pa.array(orders.steps, pa.int32()), *(pa.array(found[f], pa.int64()) for f in _FIGURES)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *_FIGURES])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in _FIGURES))


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the five filters over whole texts, per part.

    A: under 50 words; B: fewer than 65 distinct words in 100; C: more than 5 characters of 100 in A-Z;
    D: holds one of ``#$%&*|``; E: an equal text has a smaller id.  A null text is an empty one
    (it fails A only, and E if an empty text comes before it), a null part is the empty string;
    labels without a row, and null labels, are 0.  Texts of any length are treated whole; an
    empty table gives no row; other columns are ignored.
    """
    return audit(failures(docs, labels, id_col, text_col, part_col))
