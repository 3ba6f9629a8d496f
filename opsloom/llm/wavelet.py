"""Token shards as wavelet matrices: succinct bit planes with rank and select in one compressed file.

The ids of a shard's documents, one after the other in ascending order of document
id, form one sequence.  Plane by plane from the highest bit, a plane holds that bit of
every id and the sequence is then reordered stably, zeros before ones.  With the number
of ones before each block, one lookup per plane gives the id at a place (access),
the number of times an id occurs before a place (rank) and the place of its k-th
occurrence (select), without decoding the rest.

File: ``WVM1``, 8 bytes with the length of the header, the header as JSON, then the
compressed parts that it lists by place and length: document ids, their first places,
and per plane blocks of ``BLOCK`` bits, so that a lookup opens only the blocks it needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm.files import read_all, write_new
from opsloom.llm.tokens import encoder
from opsloom.plans.storage import shared_path

MAGIC = b"WVM1"
#: Bits of a block that is compressed on its own.
BLOCK = 1 << 18
MANIFEST = "partition int, number int, path string, n_docs bigint, n_tokens bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def build(doc_ids: list[int | None], sequences: list[np.ndarray]) -> bytes:
    """The file of one shard."""
    ids = np.concatenate(sequences) if sequences else np.zeros(0, "<u2")
    firsts = np.cumsum([0, *map(len, sequences)])
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zipped = zstandard.ZstdCompressor(level=1)
    parts: list[bytes] = []
    place = 0

    def put(data: bytes) -> list[int]:
        nonlocal place
        parts.append(zipped.compress(data))
        place += len(parts[-1])
        return [place - len(parts[-1]), len(parts[-1])]

    known = np.array([d is not None for d in doc_ids], bool)
    header = {"n": len(ids), "levels": levels, "kind": ids.dtype.str, "docs": put(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), "known": put(np.packbits(known).tobytes()), "firsts": put(firsts.astype("<i8").tobytes()), "planes": []}
    for level in reversed(range(levels)):
        bits = (ids & np.array(1 << level, ids.dtype)) != 0
        blocks = [put(np.packbits(bits[i : i + BLOCK], bitorder="little").tobytes()) for i in range(0, len(bits), BLOCK)]
        before = np.array([np.count_nonzero(bits[i : i + BLOCK]) for i in range(0, len(bits), BLOCK)], np.int64)
        header["planes"].append({"blocks": blocks, "zeros": int(len(bits) - before.sum()), "before": np.cumsum(np.append(0, before))[:-1].tolist()})
        ids = np.concatenate([ids.take(np.flatnonzero(~bits)), ids.take(np.flatnonzero(bits))]) if level else ids
    head = json.dumps(header).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(parts)


class WaveletFile:
    """Reader of one shard; blocks are opened when a lookup needs them."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[4:12], "little")
        self.header = json.loads(data[12 : 12 + size])
        self._data, self._base = memoryview(data), 12 + size
        self._opened: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.n, self.levels = self.header["n"], self.header["levels"]

    def _part(self, at: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._data[self._base + at[0] : self._base + at[0] + at[1]])

    @cached_property
    def firsts(self) -> np.ndarray:
        """Place of the first id of each document, and the number of all ids."""
        return np.frombuffer(self._part(self.header["firsts"]), "<i8")

    @cached_property
    def doc_ids(self) -> list[int | None]:
        known = np.unpackbits(np.frombuffer(self._part(self.header["known"]), np.uint8))
        return [int(d) if k else None for d, k in zip(np.frombuffer(self._part(self.header["docs"]), "<i8"), known)]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        left = min(BLOCK, self.n - block * BLOCK)
        return np.unpackbits(np.frombuffer(self._part(self.header["planes"][plane]["blocks"][block]), np.uint8), count=left, bitorder="little")

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a block, and the number of ones before each of them in the whole plane."""
        if (plane, block) not in self._opened:
            bits = self._bits(plane, block)
            self._opened[plane, block] = bits, np.cumsum(np.append(0, bits)) + self.header["planes"][plane]["before"][block]
        return self._opened[plane, block]

    def _ones(self, plane: int, place: int) -> int:
        if not self.n:
            return 0
        block = min(place // BLOCK, len(self.header["planes"][plane]["blocks"]) - 1)
        return int(self._block(plane, block)[1][place - block * BLOCK])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for plane, info in enumerate(self.header["planes"]):
            bit = int(self._block(plane, place // BLOCK)[0][place % BLOCK])
            ones = self._ones(plane, place)
            place = info["zeros"] + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, place: int) -> tuple[int, int]:
        low, high = 0, place
        if token < 0 or token >> self.levels:
            return 0, 0
        for plane, info in enumerate(self.header["planes"]):
            a, b = self._ones(plane, low), self._ones(plane, high)
            low, high = (info["zeros"] + a, info["zeros"] + b) if token >> self.levels - 1 - plane & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, place: int) -> int:
        """How often an id occurs before a place."""
        low, high = self._range(token, place)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, self.n)[0] + k
        for plane in reversed(range(self.levels)):
            one = token >> self.levels - 1 - plane & 1
            place = self._find(plane, place - self.header["planes"][plane]["zeros"] if one else place, one)
        return place

    def _find(self, plane: int, k: int, one: int) -> int:
        """The place of the k-th one (or zero) of a plane."""
        before = np.array(self.header["planes"][plane]["before"])
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = self._block(plane, block)[0]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        """All places of an id, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the lowest bit up."""
        ids = np.zeros(self.n, self.header["kind"])
        for plane in reversed(range(self.levels)):
            bits = np.concatenate([self._bits(plane, b) for b in range(len(self.header["planes"][plane]["blocks"]))]).view(bool) if self.n else np.zeros(0, bool)
            above, zeros = np.empty_like(ids), self.header["planes"][plane]["zeros"]
            above[np.flatnonzero(~bits)], above[np.flatnonzero(bits)] = ids[:zeros], ids[zeros:] | np.array(1 << self.levels - 1 - plane, ids.dtype)
            ids = above
        return ids


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents, write them as shard files to the shared folder and return the manifest, one row per file.

    Files hold documents in ascending order of id, and the files of the manifest by
    (partition, number) too.  A null or empty text is the end id alone, a null id comes
    first, equal ids lie next to each other in any order.  A shard ends when it has
    ``shard_tokens`` ids, which bounds a task's memory by that and one document.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "shards")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encode.kind)
        doc_ids: list[int | None] = []
        sequences: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            row = [partition, number, write_new(folder, ".wvm", build(doc_ids, sequences)), len(doc_ids), held]
            number, held = number + 1, 0
            doc_ids.clear()
            sequences.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["partition", "number", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.encode(part.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    sequences.append(np.concatenate([ids, end]))
                    held += len(sequences[-1])
                    if held >= shard_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    manifest = shared_path(spark, "manifest")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(task, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of all shards, from the files alone: id, place of the first id in the whole collection, ids."""
    order = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file: a running sum over the manifest, never over documents
    starts = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    files = max(1, manifest.count())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                shard = WaveletFile(read_all(path))
                ids, bounds = shard.decode(), shard.firsts.tolist()
                doc_ids = shard.doc_ids
                for i in range(0, len(doc_ids), 1000):
                    some = range(i, min(i + 1000, len(doc_ids)))
                    columns = [pa.array(doc_ids[i : i + 1000], pa.int64()), pa.array([first + bounds[k] for k in some], pa.int64()), pa.array([bounds[k + 1] - bounds[k] for k in some], pa.int64()), pa.array([ids[bounds[k] : bounds[k + 1]].astype("<u4").tobytes() for k in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return starts.select("path", "first").repartition(files).mapInArrow(task, ROWS)
