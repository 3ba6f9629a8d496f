"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

A document's ids are cut into full windows first.  The rest is placed into one of
the partially filled windows: of all fill levels that leave room, and a new window,
the one that makes the sum of the squared numbers of open windows per level least.
A level array holds those numbers.  Each task packs its own rows, so nothing is
shuffled; its windows take numbers from a range of their own.

Windows may stay partially filled.  When ``max_open`` of them are open, and at the
end, the emptiest are poured into the fullest, pieces being cut where needed; the one
that may remain is cut into windows whose lengths are powers of two, which need no
padding.  So all but those few windows per task are exactly full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from opsloom.llm.tokens import encoder

#: Windows of one task are numbered from its partition number times this.
NUMBERS_PER_TASK = 1 << 36
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class Packer:
    def __init__(self, window: int, max_open: int) -> None:
        self.window, self.max_open = window, max_open
        #: Number of open windows per fill level.
        self.levels = np.zeros(window, np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.closed: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        whole = len(piece.ids) // self.window
        for _ in range(whole):
            full, piece = piece.cut(self.window)
            self.closed.append([full])
        if len(piece.ids):
            self._place(piece)
            if self.levels.sum() >= self.max_open:
                self.pour()

    def _place(self, piece: Piece) -> None:
        n = len(piece.ids)
        # change of the sum of squares by moving a window from level h to h + n, for h from 0 to window - n
        change = np.zeros(self.window - n + 1, np.int64)
        change[:-1] = 2 * self.levels[n:] + 1
        change[1:] += 1 - 2 * self.levels[1 : self.window - n + 1]
        usable = self.levels[: self.window - n + 1] > 0
        usable[0] = True
        at = np.flatnonzero(usable)
        level = int(at[len(at) - 1 - np.argmin(change[at][::-1])])
        pieces = self.open[level].pop() if level else []
        self.levels[level] -= level > 0
        self._keep([*pieces, piece], level + n)

    def _keep(self, pieces: list[Piece], level: int) -> None:
        if level == self.window:
            self.closed.append(pieces)
        elif level:
            self.open[level].append(pieces)
            self.levels[level] += 1

    def pour(self) -> None:
        """Fill the fullest open windows from the emptiest until at most one is partial."""
        rest = sorted(((level, pieces) for level, group in self.open.items() for pieces in group), key=lambda x: x[0])
        self.open.clear()
        self.levels[:] = 0
        low = 0
        while low < len(rest):
            level, pieces = rest.pop()
            while level < self.window and low < len(rest):
                have, donor = rest[low]
                piece = donor.pop()
                room = self.window - level
                if len(piece.ids) > room:
                    keep, piece = piece.cut(len(piece.ids) - room)
                    donor.append(keep)
                pieces.append(piece)
                level += len(piece.ids)
                rest[low] = (have - len(piece.ids), donor)
                low += have == len(piece.ids)
            self._keep(pieces, level)

    def finish(self) -> None:
        self.pour()
        for level, group in list(self.open.items()):
            for pieces in group:
                for bit in reversed(range(level.bit_length())):
                    if level >> bit & 1:
                        self.closed.append(taken := [])
                        room = 1 << bit
                        while room:
                            piece = pieces.pop(0)
                            if len(piece.ids) > room:
                                piece, rest = piece.cut(room)
                                pieces.insert(0, rest)
                            taken.append(piece)
                            room -= len(piece.ids)
        self.open.clear()
        self.levels[:] = 0

    def rows(self, first: int) -> pa.RecordBatch:
        """The closed windows as output rows, numbered from ``first``."""
        columns: list[list] = [[] for _ in range(7)]
        for number, pieces in enumerate(self.closed, first):
            offset = 0
            for piece in pieces:
                n = len(piece.ids)
                for column, value in zip(columns, (piece.doc_id, piece.start, n, piece.doc_tokens, number, offset, piece.ids.astype("<u4").tobytes())):
                    column.append(value)
                offset += n
        self.closed = []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, max_open: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents and the windows that hold them; one row per piece, with its ids as little-endian 32-bit numbers.

    A null or empty text is the end id alone.  Rows with equal ids or null ids are
    packed each for itself.  An empty table gives no row.  ``sequence_id`` is unique,
    ``offset`` runs without gaps from 0 inside it; other columns of ``docs`` are ignored.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(window, max_open)
        number = TaskContext.get().partitionId() * NUMBERS_PER_TASK
        end = np.array([end_id], encode.kind)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.encode(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    packer.add(Piece(doc_id, 0, ids, len(ids)))
                count = len(packer.closed)
                if count:
                    yield packer.rows(number)
                    number += count
        packer.finish()
        if packer.closed:
            yield packer.rows(number)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(task, SCHEMA)
