"""Nearest vectors: exact search over all rows, and a bucket index for approximate search.

Rows are packed into blocks, a matrix beside its ids, where Spark holds them; a block of queries
and a block of vectors of the same dimension meet in a join, and a task scores the pair as one
matrix product and keeps the best k per query of all pairs it has seen.  Only those go on.

Vectors that are null, empty, or hold a null or non-finite component take no part; only vectors
of the query's dimension are compared with it.  Ids of queries must be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.plans.ordered import top_per_key
from opsloom.plans.predicates import to_column
from opsloom.plans.storage import cut_lineage

#: Rows in a block of vectors and in a block of queries (a pair is scored as one matrix), and numbers in a block.
VECTOR_ROWS, QUERY_ROWS, BLOCK_NUMBERS = 4096, 512, 1 << 19
#: Blocks of queries of up to so many bytes together are sent to every executor; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: Best rows that a task holds before it hands them on.
HELD_ROWS = 2_000_000
#: Vectors of a bucket that one task takes.
BUCKET_ROWS = 65_536


def _elements(df: DataFrame, vector: str) -> str:
    """Vectors of float keep four bytes a number; all others are doubles."""
    return "float" if df.schema[vector].dataType.elementType.simpleString() == "float" else "double"


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the usable vectors of each dimension."""
    rows = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    some = column.take(pa.array(rows))
    flat = some.flatten().to_numpy(zero_copy_only=False)  # a null becomes a NaN
    size = pc.list_value_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    bad = np.zeros(len(rows), bool)
    bad[np.repeat(np.arange(len(rows)), size)[~np.isfinite(flat)]] = True
    for dim in np.unique(size[~bad & (size > 0)]):
        good = np.flatnonzero(~bad & (size == dim))
        yield rows[good], flat[start[good][:, None] + np.arange(dim)]


def _plain(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vector`` alone."""
    return df.select(df[id_col].alias("id"), df[vector].cast(f"array<{_elements(df, vector)}>").alias("vector"))


def _packed(rows: DataFrame, keys: list[str], most_rows: int, names: tuple[str, str]) -> DataFrame:
    """Block rows ``keys, dim, ids, values`` from rows ``keys, id, vector`` whose equal keys are neighbours; ids ascend within a block."""
    element, ids, values = _elements(rows, "vector"), *names
    schema = ", ".join([*(f"{k} {_kind(rows, k)}" for k in keys), f"dim int, {ids} array<{_kind(rows, 'id')}>, {values} binary"])
    dtype = np.dtype("<f4" if element == "float" else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= column[1:] != column[:-1]
            group = np.cumsum(new)
            for at, matrix in _matrices(batch.column("vector")):
                dim = matrix.shape[1]
                most = max(1, min(most_rows, BLOCK_NUMBERS // dim))
                order = pc.sort_indices(pa.table({"g": group[at], "i": batch.column("id").take(pa.array(at))}), [("g", "ascending"), ("i", "ascending")]).to_numpy()
                at, matrix = at[order], matrix[order].astype(dtype, copy=False)
                edges = np.append(np.flatnonzero(np.diff(group[at], prepend=-1)), len(at)).tolist()
                for low, high in zip(edges, edges[1:]):
                    for a in range(low, high, most):
                        b = min(a + most, high)
                        own = batch.column("id").take(pa.array(at[a:b]))
                        lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), own)
                        first = pa.array(at[a : a + 1])
                        columns = [*(batch.column(k).take(first) for k in keys), pa.array([dim], pa.int32()), lists, pa.array([matrix[a:b].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, [*keys, "dim", ids, values])

    return rows.select(*keys, "id", "vector").mapInArrow(run, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Matrix queries x vectors, larger is nearer: cosine (0 for a zero vector), dot, or l2 as negative distance."""
    if metric == "cosine":
        return _unit(queries) @ _unit(vectors).T
    if metric == "dot":
        return queries @ vectors.T
    square = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * queries @ vectors.T
    return -np.sqrt(np.maximum(square, 0.0))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and vector numbers of the k best of each query and of what equals the last of them."""
    if score.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(score.shape))
    least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
    return np.nonzero(score >= least[:, None])


def _cut(query: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The k best per query, ties by id."""
    place = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
    order = np.lexsort((place, -score, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    at = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    order = order[at < k]
    return query[order], score[order], ids.take(pa.array(order))


def _scored(pairs: DataFrame, k: int, metric: str, query_kind: str, vec_kind: str, query_values: str, vec_values: str) -> DataFrame:
    """``query_id, vec_id, score`` of the best k per query of each task, from rows that hold two blocks."""
    kinds = {"float": "<f4", "double": "<f8"}
    query_dtype, vec_dtype = kinds[query_values], kinds[vec_values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        rows = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for names, query, score, ids in held.values():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids, pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                block = batch.column("query_block")[i].as_py()
                queries = np.frombuffer(batch.column("query_values")[i].as_buffer(), query_dtype).reshape(-1, dim).astype(float)
                vectors = np.frombuffer(batch.column("vec_values")[i].as_buffer(), vec_dtype).reshape(-1, dim).astype(float)
                found = np.round(scores(queries, vectors, metric), 9)
                query, at = _best(found, k)
                ids = batch.column("vec_ids")[i].values.take(pa.array(at))
                new = _cut(query, found[query, at], ids, k)
                if block in held:
                    names, *old = held[block]
                    rows -= len(old[0])
                    new = _cut(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]), pa.concat_arrays([old[2], new[2]]), k)
                else:
                    names = pa.concat_arrays([batch.column("query_ids")[i].values])
                held[block] = (names, *new)
                rows += len(new[0])
                if rows > HELD_ROWS:
                    yield from emit()
                    held, rows = {}, 0
        yield from emit()

    some = pairs.select("dim", "query_block", "query_ids", "query_values", "vec_ids", "vec_values")
    return some.mapInArrow(run, f"query_id {query_kind}, vec_id {vec_kind}, score double")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _checked(metric: str) -> None:
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric!r}")


def _ranked(found: DataFrame, k: int, vec_id: str) -> DataFrame:
    rows = top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return rows.withColumnRenamed("vec_id", vec_id)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id",
    vec_id: str = "vec_id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``query_id``, vector id, ``score`` and ``rank`` of the exact k nearest vectors per query; ties by vector id.

    The blocks of queries are written once, when this is called.  If they are small enough they go
    to every executor and the vectors stay where they are read; otherwise each block of vectors has
    a part, and a copy of the queries meets each part.  The plan is the same for any number of queries.
    """
    _checked(metric)
    asked = _packed(_plain(queries, query_id, vector), [], QUERY_ROWS, ("query_ids", "query_values"))
    asked = cut_lineage(asked.withColumn("query_block", F.monotonically_increasing_id()))
    blocks = _packed(_plain(vectors, vec_id, vector), [], VECTOR_ROWS, ("vec_ids", "vec_values"))
    size = asked.agg(F.sum(F.octet_length("query_values"))).first()[0] or 0
    if size <= broadcast_bytes:
        pairs = blocks.join(F.broadcast(asked), "dim")
    else:
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = blocks.withColumn("part", F.pmod(F.xxhash64("vec_ids"), F.lit(parts)).cast("int"))
        copies = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = dealt.join(copies, ["dim", "part"])
    found = _scored(pairs, k, metric, _kind(queries, query_id), _kind(vectors, vec_id), _elements(queries, vector), _elements(vectors, vector))
    return _ranked(found, k, vec_id)


def sign_planes(dim: int, bands: int, bits: int, seed: str = "plane") -> np.ndarray:
    """Random planes of +1 and -1 (band, bit, dim): the first digit of the MD5 of ``seed|band|bit|component``."""
    sign = lambda *at: 1.0 if hashlib.md5("|".join([seed, *map(str, at)]).encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[[sign(b, j, d) for d in range(dim)] for j in range(bits)] for b in range(bands)])


def _codes(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket number per vector and band, a bit per plane on whose positive side the vector lies."""
    bands, bits, dim = planes.shape
    signs = (matrix.astype(float) @ planes.reshape(-1, dim).T > 0).reshape(-1, bands, bits)
    return signs @ (1 << np.arange(bits))


def _coded(rows: DataFrame, bands: int, bits: int, probes: bool) -> DataFrame:
    """``band, code, id, vector``: each row once per band; with ``probes`` also under each code that differs in one bit."""
    flips = np.array([0, *(1 << np.arange(bits))] if probes else [0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, matrix in _matrices(batch.column("vector")):
                dim = matrix.shape[1]
                if dim not in planes:
                    planes[dim] = sign_planes(dim, bands, bits)
                codes = _codes(matrix, planes[dim])
                # a slice of rows at a time, as each becomes bands x probes rows
                for a in range(0, len(at), 512):
                    every = codes[a : a + 512, :, None] ^ flips
                    row = np.repeat(at[a : a + 512], bands * len(flips))
                    band = np.broadcast_to(np.arange(bands)[:, None], every.shape).ravel()
                    columns = [pa.array(band, pa.int32()), pa.array(every.ravel(), pa.int64()), *(batch.column(c).take(pa.array(row)) for c in ("id", "vector"))]
                    yield pa.RecordBatch.from_arrays(columns, ["band", "code", "id", "vector"])

    return rows.mapInArrow(run, f"band int, code bigint, id {_kind(rows, 'id')}, vector {_kind(rows, 'vector')}")


class BucketIndex:
    """A bucket index: ``blocks`` (``band, code, salt`` and a block of vectors) and ``buckets`` (``band, code, salts``).

    Every vector is in one bucket per band, beside its id, so that a bucket is scored where it
    lies.  A bucket with more than ``BUCKET_ROWS`` vectors is dealt out over salts.
    """

    def __init__(self, blocks: DataFrame, buckets: DataFrame, bands: int, bits: int, vec_id: str, vec_kind: str, element: str) -> None:
        self.blocks, self.buckets, self.bands, self.bits = blocks, buckets, bands, bits
        self.vec_id, self.vec_kind, self.element = vec_id, vec_kind, element


def bucket_index(vectors: DataFrame, bands: int = 20, bits: int = 8, vec_id: str = "vec_id", vector: str = "embedding", bucket_rows: int = BUCKET_ROWS) -> BucketIndex:
    """Index all vectors by the side of random planes on which they lie; written to the shared folder, for any number of searches.

    More bits make smaller buckets, more bands find more.  There are bands x 2 ** bits buckets at
    most, so the table of their sizes is bounded and meets the rows without a shuffle of them.
    """
    coded = _coded(_plain(vectors, vec_id, vector), bands, bits, probes=False)
    counted = coded.groupBy("band", "code").agg(F.count("*").alias("_n"))
    buckets = cut_lineage(counted.select("band", "code", F.ceil(F.col("_n") / bucket_rows).cast("int").alias("salts")))
    known = F.broadcast(buckets) if bands << bits <= 1 << 20 else buckets
    salted = coded.join(known, ["band", "code"]).withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    dealt = salted.repartition("band", "code", "salt").sortWithinPartitions("band", "code", "salt")
    blocks = _packed(dealt, ["band", "code", "salt"], VECTOR_ROWS, ("vec_ids", "vec_values"))
    return BucketIndex(cut_lineage(blocks), buckets, bands, bits, vec_id, _kind(vectors, vec_id), _elements(vectors, vector))


def search_index(index: BucketIndex, queries: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, vector id, ``score`` and ``rank`` of the k best among the vectors that share a bucket with the query.

    In every band a query looks into its own bucket and into those one plane away.  Queries of a
    bucket are packed and joined with its blocks by equality; what meets is scored exactly.
    """
    _checked(metric)
    coded = _coded(_plain(queries, query_id, vector), index.bands, index.bits, probes=True)
    sought = coded.join(F.broadcast(index.buckets) if index.bands << index.bits <= 1 << 20 else index.buckets, ["band", "code"])
    sought = sought.repartition("band", "code").sortWithinPartitions("band", "code", "salts")
    asked = _packed(sought, ["band", "code", "salts"], QUERY_ROWS, ("query_ids", "query_values"))
    asked = cut_lineage(asked.withColumn("query_block", F.monotonically_increasing_id()))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = index.blocks.join(asked, ["band", "code", "salt", "dim"])
    found = _scored(pairs, k, metric, _kind(queries, query_id), index.vec_kind, _elements(queries, vector), index.element)
    # a vector that shares several buckets with the query is found in each
    return _ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, index.vec_id)


def nearest_approx(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", bands: int = 20, bits: int = 8,
    query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Build a bucket index of the vectors and search it once."""
    return search_index(bucket_index(vectors, bands, bits, vec_id, vector), queries, k, metric, query_id, vector)


def retrieve(queries: DataFrame, vectors: DataFrame, cond, k: int, metric: str = "cosine", **columns) -> DataFrame:
    """The filter on metadata comes first and reaches the scan; then the exact search."""
    return nearest(queries, vectors.where(to_column(cond)), k, metric, **columns)
