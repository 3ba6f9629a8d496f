"""Near-duplicate documents with HyperMinHash.

A document's shingle hashes are dealt over ``REGISTERS`` buckets by their first bits.  A
register keeps of its bucket's least hash the number of leading zeros and the next
``MANTISSA`` bits.  Bands of registers make bucket keys; documents that share a key are
candidates, those whose registers agree too rarely, corrected for agreement by chance,
are left out, and the rest is decided on the full sets.

Documents with equal sets are one node from the start.  A key of many nodes does not yield
all its pairs: its nodes are first compared with its centre, the node that shares most
keys with others, and what is linked becomes one component.  In keys that still hold
several components, the nodes outside the largest one are then compared with all nodes
of other components, a pair under the first of its shared keys.  So no link between components is lost, a group of near copies costs
as many pairs as it has members, and only nodes that share a key with a group without belonging to it
cost more.  Each pair is tested on bit columns inside the join before it becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.held import drop
from opsloom.llm.shingles import mix, set_key, shingle_sets
from opsloom.plans.storage import cut_lineage

BUCKET_BITS = 9
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 5
BANDS = 40
#: Standard deviations by which an estimate may fall short before a pair is left out, and as much again for rounding.
SLACK, ROUNDING = 4.0, 0.01
_REST = 48
_ORDER = mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)
_BAND_POWERS = mix(np.arange(1, BAND + 1, dtype=np.uint64)) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers of an ascending set; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket, at = np.unique(shingles >> np.uint64(64 - BUCKET_BITS), return_index=True)
        rest = (shingles[at] >> np.uint64(64 - BUCKET_BITS - _REST)) & np.uint64((1 << _REST) - 1)
        zeros = _REST - np.frexp(rest.astype(np.float64))[1]
        tail = (rest << np.minimum(zeros + 1, _REST).astype(np.uint64)) & np.uint64((1 << _REST) - 1)
        out[bucket.astype(np.int64)] = 1 + (np.minimum(zeros, 62) << MANTISSA) + (tail >> np.uint64(_REST - MANTISSA)).astype(np.int64)
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key per band; an empty bucket takes over the register of another one, chosen by a fixed random order."""
    filled = np.flatnonzero(own)
    if len(filled) < REGISTERS:
        empty = np.flatnonzero(own == 0)
        own = own.copy()
        own[empty] = own[filled[_ORDER[empty][:, filled].argmin(axis=1)]]
    rows = own[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    return mix((rows * _BAND_POWERS).sum(axis=1, dtype=np.uint64) * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _octaves(n: np.ndarray) -> np.ndarray:
    """Chance that the least of n hashes of a bucket has so many leading zeros; a row per n."""
    edge = np.append(2.0 ** -np.arange(_REST + 1), 0) / REGISTERS
    alive = np.exp(n[:, None] * np.log1p(-edge[None, :]))
    return alive[:, 1:] - alive[:, :-1]


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity by the share of equal registers less those expected equal by chance, and the number of registers used."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    share = ((a == b) & (a > 0)).sum(axis=1) / used
    chance = (_octaves(n_a) * _octaves(n_b)).sum(axis=1) / 2.0**MANTISSA
    return (share - chance) / (1 - chance), used


def sketches(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key, registers`` per row; a text without words has no set key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()  # what an earlier stage has left in this worker
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "set_key", "registers"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, n_shingles bigint, set_key binary, registers binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in part.column("registers").to_pylist()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.repeat(part.column(c).to_numpy(), BANDS)) for c in ("node", "n"))], ["key", "node", "n"])


#: Columns of a register's presence, its last bit and the bit before, 64 registers to a number.
BITS = [f"{kind}{i}" for kind in "plm" for i in range(REGISTERS // 64)]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        parts = [np.packbits(x, axis=1).view(np.int64) for x in (own > 0, own & 1, own & 2)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(x[:, i])) for x in parts for i in range(x.shape[1]))], ["node", *BITS])


def _promising(least: float) -> Column:
    """Whether a pair may be similar by its registers' presence and last bits alone; the centre's columns end in ``_a``.

    Registers that only one of both has differ, and of those that differ in both three of
    four show it in their last two bits.  The bound lies ``SLACK`` standard deviations beyond the
    count that a pair of least similarity is expected to have.
    """
    numbers = range(REGISTERS // 64)
    used = sum((F.bit_count(F.col(f"p{i}").bitwiseOR(F.col(f"p{i}_a"))) for i in numbers), F.lit(0))
    alone = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_a"))) for i in numbers), F.lit(0))
    other = lambda i: F.col(f"l{i}").bitwiseXOR(F.col(f"l{i}_a")).bitwiseOR(F.col(f"m{i}").bitwiseXOR(F.col(f"m{i}_a")))
    apart = sum((F.bit_count(other(i).bitwiseAND(F.col(f"p{i}").bitwiseAND(F.col(f"p{i}_a")))) for i in numbers), F.lit(0))
    union = (F.col("n") + F.col("na")) / (1 + least)
    spread = least * (1 - least) * used * F.greatest(1 - used / union, F.lit(0.0)) + apart * 4 / 9 + 1
    return alone + apart * 4 / 3 - SLACK * F.sqrt(spread) <= (1 - least) * used


def _likely(least: float):
    """A task that keeps the pairs whose registers may belong to sets of that similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            share, used = estimated(a, b, na, nb)
            # registers are a sample without replacement of the union, which small sets fill almost whole
            union = (na + nb) / (1 + least)
            spread = np.sqrt(least * (1 - least) / used * np.clip(1 - used / union, 0, 1))
            keep = share >= least - SLACK * spread - ROUNDING
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return task


def _linked(width: int, part: int, whole: int):
    """A task that decides pairs on their full sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, ta, y in zip(batch.column("a").to_pylist(), batch.column("ta"), shingle_sets(batch.column("tb").to_pylist(), width)):
                if last[0] != a:  # pairs come ordered by their first node
                    last = a, shingle_sets([ta.as_py()], width)[0]
                x = last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return task


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of undirected links ``a, b``, by large and small stars in turn.

    Each round is written and read again; hot nodes are met by splitting skewed join
    partitions.  Ends when every node points to one that points to none.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut_lineage(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(least.select("u", F.col("m").alias("v")).union(small).distinct())
        # stars: each node has one edge down, and ends there
        if edges.count() == least.count() and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def links(docs: DataFrame, nodes: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """``node, component`` of the nodes (``node, n, registers``) that have links; texts are read from ``docs`` (``doc_id, text``)."""
    rows = cut_lineage(nodes.mapInArrow(_bands, "key bigint, node bigint, n bigint"))
    shared = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    rows = cut_lineage(rows.join(shared, "key"))
    weights = cut_lineage(rows.groupBy("node").agg(F.sum("size").alias("weight")))
    texts = cut_lineage(docs.join(weights.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))
    sketch = cut_lineage(nodes.join(weights, "node", "left_semi"))
    known = cut_lineage(weights.join(sketch.mapInArrow(_bits, "node bigint, " + ", ".join(f"{b} bigint" for b in BITS)), "node"))
    rows = cut_lineage(rows.drop("size").join(known, "node"))

    def compared(pairs: DataFrame) -> DataFrame:
        """The linked ones of some pairs ``a, b``."""
        pairs = cut_lineage(pairs.distinct())
        side = lambda name: sketch.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("registers").alias(f"r{name}"))
        likely = cut_lineage(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_likely(part / whole), "a bigint, b bigint").distinct())
        text = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))
        # first the many, then the centres, so that a centre's pairs come one after the other
        return likely.join(text("b"), "b").join(text("a"), "a").mapInArrow(_linked(width, part, whole), "a bigint, b bigint").distinct()

    similar = (whole * F.col("n") >= part * F.col("na")) & (whole * F.col("na") >= part * F.col("n")) & _promising(part / whole)
    # of each key the node of most weight
    heavy = F.max_by(F.struct(F.col("node").alias("a"), F.col("n").alias("na"), *(F.col(b).alias(f"{b}_a") for b in BITS)), F.struct("weight", -F.col("node")))
    centres = cut_lineage(rows.groupBy("key").agg(heavy.alias("centre")).select("key", "centre.*"))
    found = cut_lineage(compared(rows.join(centres, "key").where((F.col("node") != F.col("a")) & similar).select("a", F.col("node").alias("b"))))
    label = cut_lineage(components(found))
    rows = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # nodes of each key by component, and the largest component of each key that holds several
    sizes = cut_lineage(rows.groupBy("key", "component").agg(F.count("*").alias("size")))
    largest = cut_lineage(sizes.groupBy("key").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    rows = cut_lineage(rows.join(largest, "key"))
    # the keys of a node, a band's at most each: a pair is met under the least key of both alone
    rows = cut_lineage(rows.join(rows.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys")), "node"))
    outside = rows.where("component != main").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("keys").alias("keys_a"), *(F.col(b).alias(f"{b}_a") for b in BITS))
    # a pair of two nodes outside once
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("node"))
    first = F.array_min(F.array_intersect("keys", "keys_a")) == F.col("key")
    more = compared(rows.join(outside, "key").where((F.col("component") != F.col("ca")) & once & similar & first).select("a", F.col("node").alias("b")))
    more = cut_lineage(more)
    return label if more.isEmpty() else components(found.union(more))


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 75, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Rows are linked if whole * |intersection| >= part * |union| of their sets of distinct
    shingles of ``width`` words.  ``component_id`` is the least id reachable.  A null or
    empty text, or one without words, has no shingle and no link; a row with a null id
    has no link either, a null component, and stays.  Rows that repeat an id follow each
    its own text; an id with several texts is linked as soon as one of them is.  An empty
    table gives no row; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    sketched = cut_lineage(sketches(rows, width))
    usable = sketched.where("set_key is not null and doc_id is not null")
    classes = cut_lineage(usable.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    nodes = cut_lineage(usable.select("doc_id", F.col("n_shingles").alias("n"), "set_key", "registers").join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("node"), "n", "registers"))
    label = links(rows, nodes, width, part, whole)
    labelled = cut_lineage(classes.join(label, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id")))
    return (
        sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(labelled, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
