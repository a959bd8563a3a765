"""Packing of documents into windows by best fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .ids import ids as ids_of


class OpenWindows:
    """Open windows by what is still free in them: a segment tree over 0..size.

    A leaf holds the windows with so much room, a node how many there are below
    it; the tightest window for a piece is the first leaf at or after its
    length, found in O(log size). At most ``most`` windows stay open: beyond,
    one with the least room is closed.
    """

    def __init__(self, size: int, most: int = 1 << 20):
        self.size, self.most, self.n = size, most, 0
        self.width = 1 << size.bit_length()
        self.full = [0] * (2 * self.width)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.full[i] += by
            i >>= 1

    def add(self, room: int, window: tuple[int, int]) -> None:
        self.at[room].append(window)
        self._count(room, 1)
        if self.full[1] > self.most:
            self.take(self.tightest(1))

    def tightest(self, length: int) -> int | None:
        """The least room of ``length`` or more that a window has."""
        i = length + self.width
        if not self.full[i]:
            while i & 1 or not self.full[i + 1]:  # up while there is nothing to the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.width:
                i = 2 * i if self.full[2 * i] else 2 * i + 1
        return i - self.width

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.at[room].pop()

    def place(self, lengths: list[int]) -> list[tuple[int, int]]:
        """(window, offset) of each piece; ``lengths`` fall, also from call to call, and none is over ``size``."""
        out = []
        for length in lengths:
            room = self.tightest(length)
            if room is None:
                window, offset = self.n, 0
                self.n += 1
            else:
                window, offset = self.take(room)
            out.append((window, offset))
            left = self.size - offset - length
            if left:
                self.add(left, (window, offset + length))
        return out


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; ``lengths`` fall, none is over ``size``."""
    return OpenWindows(size).place(lengths)


def cut_documents(docs: DataFrame, path: str, size: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids (with ``end_id`` after them): full windows, then the rest.

    ``copy`` numbers what is alike in ids and start among the pieces of a task.
    """
    base.ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        base.claim("ids")
        enc = ids_of(path)
        copies: dict[tuple[int, int, int], int] = {}
        for b in base.slices(batches, text_col, 8 << 20):
            rows, start, length, crc, total, copy = [], [], [], [], [], []
            for k, t in enumerate(base.strings(b.column(1))):
                ids = np.append(enc.encode(t), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    rows.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    like = (at, len(piece), crc[-1])
                    copy.append(copies.get(like, 0))
                    copies[like] = copy[-1] + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, copy)], [id_col, "start", "length", "ids_crc32", "doc_tokens", "copy"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, copy long")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into windows of at most ``size`` ids.

    A document's ids are those of the tokenizers file ``path`` followed by
    ``end_id``. Documents over ``size`` ids are first cut into full windows;
    what is left of each is packed by best fit decreasing. Pieces are dealt to
    tasks by a hash of what they hold and which copy of it they are, so that
    neither null or repeated ids nor equal texts share a task; each task packs
    its own share as it comes in, longest first, and keeps only open windows
    (a million at most). A task leaves about one window partly filled, little
    beside the thousands that it fills.

    Returns per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is the single id ``end_id``. Ids may be null or
    repeat: each row is a document, also of any length. No rows: an empty result. Sequence ids are
    unique; they depend on the rows and on how many tasks the pieces are dealt to.
    """
    pieces = cut_documents(docs, path, size, end_id, id_col, text_col)
    names = [c for c in pieces.columns if c != "copy"]

    def run(batches):
        from pyspark import TaskContext

        first = np.int64(TaskContext.get().partitionId()) << np.int64(40)
        windows = OpenWindows(size)
        for b in batches:
            placed = np.array(windows.place(b.column("length").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])], [*names, "sequence_id", "offset"])

    dealt = pieces.repartition(F.xxhash64("start", "length", "ids_crc32", "copy", id_col)).sortWithinPartitions(F.desc("length"), id_col, "start", "ids_crc32")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return dealt.select(*names).mapInArrow(run, f"{fields}, sequence_id long, offset long")
