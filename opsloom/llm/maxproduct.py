"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are turned into whole numbers, sorted by length and cut into buckets of similar
length.  Queries come in blocks.  A first bucket of long vectors gives every query a score
that its k-th best reaches at least; a later bucket matters to a query only if the product of
its own and the bucket's greatest length can reach that score, which is the bucket's
local cosine threshold.  Inside a bucket the threshold chooses the pruning: a high one
bounds the coordinates that a candidate may have, a low one only its length.  What is
left is verified by whole-number products.

Blocks and buckets have a fixed number of rows, so a task holds one of each and the best
scores of a block.  Each surviving pair of block and bucket is one row of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.storage import cut_lineage

#: Local cosine threshold from which candidates are pruned by coordinates.
COORDINATES_FROM = 0.5
#: Coordinates looked at, the largest of the query.
FOCUS = 6
#: Buckets that one task takes one after the other for a block.
RUN = 8
GROUP = "dim int, number bigint, high double, low double, ids binary, vectors binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, dim, norm, v``: components times ``scale``, rounded down; rows with a missing or non-finite component are left out."""
    doubles = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    usable = vectors[vector_col].isNotNull() & ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.where(usable).select(vectors[id_col].cast("bigint").alias("vec_id"), F.transform(doubles, lambda x: F.floor(x * scale)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return whole.where("vec_id is not null").select("vec_id", F.size("v").alias("dim"), norm.alias("norm"), "v")


def _grouped(rows: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors of similar length, longest first, as matrices; numbers are unique per dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            dim, ids = held[0][1], [r[0] for r in held]
            norms = [r[2] for r in held]
            row = [dim, ids[0], max(norms), min(norms), np.array(ids, "<i8").tobytes(), np.array([r[3] for r in held], "<i8").tobytes()]
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["dim", "number", "high", "low", "ids", "vectors"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][1] != row[1] or len(held) == size):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    keys = [F.col("dim"), F.desc("norm"), F.col("vec_id")]
    return cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(task, GROUP))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows: in doubles where those are exact, else in 64-bit numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best candidates of each query of a block, and the scores that a newcomer has to reach."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = np.maximum(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)), 1e-300)
        self.units = queries / self.norms[:, None]
        self.floors = floors.copy()
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a bucket, whose vectors come longest first."""
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        longest = max(float(norms[0]), 1e-300)
        units = vectors / np.maximum(norms, 1e-300)[:, None]
        cosine = self.floors / (self.norms * longest)
        for by_coordinates in (True, False):
            chosen = np.flatnonzero((cosine >= COORDINATES_FROM) == by_coordinates)
            chosen = chosen[cosine[chosen] <= 1 + 1e-9]
            if by_coordinates:
                for q in chosen.tolist():
                    self._take(q, ids, vectors, self._near(q, float(cosine[q]), units, norms))
            elif len(chosen):
                # by length alone: the shortest vector that any of these queries can use bounds all of them
                reach = np.min(np.where(self.floors[chosen] > 0, self.floors[chosen] / self.norms[chosen], -np.inf))
                n = int((norms >= reach * (1 - 1e-9)).sum())
                scores = _product(self.queries[chosen], vectors[:n])
                for q, row in zip(chosen.tolist(), scores):
                    self._merge(q, ids[:n], row)

    def _near(self, q: int, cosine: float, units: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Candidates whose unit vectors lie, in each of the query's largest coordinates, where a cosine that high allows."""
        keep = norms >= self.floors[q] / self.norms[q] * (1 - 1e-9)
        cosine = min(max(cosine - 1e-9, 0.0), 1.0)
        unit = self.units[q]
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            middle, width = unit[f] * cosine, np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[f] ** 2))) + 1e-9
            # beyond the query's own direction the cone holds everything up to 1
            high = 1.0 if unit[f] >= cosine else middle + width
            low = -1.0 if unit[f] <= -cosine else middle - width
            keep &= (units[:, f] >= low - 1e-9) & (units[:, f] <= high + 1e-9)
        return np.flatnonzero(keep)

    def _take(self, q: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        if len(rows):
            self._merge(q, ids[rows], _product(self.queries[q : q + 1], vectors[rows])[0])

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.floors[q]) & (ids != self.ids[q])
        ids, scores = np.concatenate([self.found[q][0], ids[keep]]), np.concatenate([self.found[q][1], scores[keep]])
        if len(ids) > self.k:  # all that tie with the k-th best stay for the final order
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            ids, scores = ids[keep], scores[keep]
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
            self.floors[q] = max(self.floors[q], float(least))
        self.found[q] = ids, scores

    def rows(self) -> pa.RecordBatch:
        counts = [len(ids) for ids, _ in self.found]
        columns = [np.repeat(self.ids, counts), np.concatenate([x for x, _ in self.found]), np.concatenate([s for _, s in self.found])]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])


def _searched(k: int):
    """A task over pairs of block and bucket, those of a run one after the other by falling length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                run = row["dim"], row["block"], row["run"]
                if run != at:
                    if best is not None:
                        yield best.rows()
                    ids = np.frombuffer(row["q_ids"], "<i8")
                    best, at = Best(ids, np.frombuffer(row["q_vectors"], "<i8").reshape(len(ids), -1), np.frombuffer(row["floors"], "<f8"), k), run
                ids = np.frombuffer(row["ids"], "<i8")
                best.add(ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1))
        if best is not None:
            yield best.rows()

    return task


def _floors(k: int):
    """A task that gives each query of a block the score of its k-th best in one bucket, and the block the length it needs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, others = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                best = Best(ids, np.frombuffer(row["q_vectors"], "<i8").reshape(len(ids), -1), np.full(len(ids), -np.inf), k)
                best.add(others, np.frombuffer(row["vectors"], "<i8").reshape(len(others), -1))
                floors = np.array([s[-1] if len(s) == k else -np.inf for _, s in best.found], "<f8")
                needs = float(np.min(floors / best.norms)) * (1 - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([floors.tobytes()], pa.binary()), pa.array([needs], pa.float64())], ["dim", "block", "floors", "needs"])

    return task


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, bucket: int = 2048, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds (over ``vec_id``) its k best other rows.

    Scores are inner products of the whole-number vectors; equal scores go to the smaller
    id; a query with fewer than k others has all of them.  Rows with a null id, a null
    vector or a component that is null or not finite take no part, and vectors meet
    only those of their dimension.  Rows that repeat an id are candidates each, but
    never for a query of that id.  An empty table gives no row.
    """
    rows = cut_lineage(quantised(vectors, scale, id_col, vector_col))
    buckets = _grouped(rows, bucket)
    blocks = _grouped(rows.where(is_query), block).select("dim", F.col("number").alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # each block against its dimension's first bucket of longest vectors
    firsts = buckets.groupBy("dim").agg(F.max_by("number", F.struct("high", -F.col("number"))).alias("number"))
    floors = cut_lineage(blocks.join(buckets.join(firsts, ["dim", "number"]).select("dim", "ids", "vectors"), "dim").mapInArrow(_floors(k), "dim int, block bigint, floors binary, needs double"))
    # one row per bucket and block, without their vectors, to see which can matter
    place = Window.partitionBy("dim").orderBy(F.desc("high"), "number")
    heads = buckets.select("dim", "number", "high").withColumn("place", F.row_number().over(place))
    pairs = heads.join(floors.select("dim", "block", "needs"), "dim").where("high >= needs").withColumn("run", F.floor(F.col("place") / RUN))
    work = pairs.select("dim", "block", "run", "place", "number").join(buckets.select("dim", "number", "ids", "vectors"), ["dim", "number"]).join(blocks.join(floors.drop("needs"), ["dim", "block"]), ["dim", "block"])
    # a pair may be a megabyte: a few thousand runs to a task at most
    found = work.repartition("dim", "block", "run").sortWithinPartitions("dim", "block", "run", "place").mapInArrow(_searched(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
