"""Harmonic packing of token sequences.

Class k of the harmonic scheme holds pieces of length (C/(k+1), C/k], and every
bin of class k takes exactly k of them.  Which bin a piece enters depends only
on its class, so each worker fills its bins alone: no shuffle, no shared state.
A document is cut so that its pieces fill their slots: whole sequences first
(class 1), then the longest slot that the rest covers, until the rest is within
``slack`` tokens of its own slot.  Bins still open at the end of a worker's rows
are joined end to end, cut at the capacity, and the last of these sequences is
cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
#: Tokens by which a last piece may fall short of its slot before it is cut again.
SLACK = 6
END_ID = 0
_BATCH = 4096

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
)


def cut(n: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest  # the class whose slot is the shortest that holds the rest
        if capacity // k - rest <= slack:
            out.append((rest, k))
            break
        length = capacity // (k + 1)
        out.append((length, k + 1))
        rest -= length
    return out


class Packer:
    """Fills bins; ``rows`` of a finished bin are (piece, sequence, offset)."""

    def __init__(self, first_id: int, capacity: int):
        self.next_id, self.capacity = first_id, capacity
        self.open: dict[int, list] = {}

    def _close(self, bin_: list) -> Iterator[tuple]:
        at = 0
        for piece in bin_:
            yield piece, self.next_id, at
            at += piece[2]
        self.next_id += 1

    def add(self, piece: tuple, k: int) -> Iterator[tuple]:
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            yield from self._close(self.open.pop(k))

    def finish(self, resized) -> Iterator[tuple]:
        """``resized(piece, from, length)`` is a part of a piece."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p[2] for p in left)
        room = []
        while total:  # whole sequences, then powers of two from the largest down
            room.append(min(self.capacity, 1 << (total.bit_length() - 1)) if total < self.capacity else self.capacity)
            total -= room[-1]
        bin_, free, sizes = [], room[0] if room else 0, iter(room[1:])
        for piece in left:
            at = 0
            while at < piece[2]:
                take = min(free, piece[2] - at)
                bin_.append(resized(piece, at, take))
                at, free = at + take, free - take
                if not free:
                    yield from self._close(bin_)
                    bin_, free = [], next(sizes, 0)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece of every document, with its ids (little-endian unsigned
    32-bit) where ``keep_ids``.

    A document's ids are those of its whole text (null: empty) and ``end_id``;
    each id lies in one piece.  doc_id may be null or repeated: every row is a
    document of its own.  Other columns aren't read.  No rows give no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def resized(piece, at, length):
        doc, start, _, total, raw = piece
        return doc, start + at, length, total, raw[4 * at : 4 * (at + length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 36, capacity)
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids = [p[4] for p, _, _ in done]
            cols = [
                pa.array([p[0] for p, _, _ in done], pa.int64()),
                pa.array([p[1] for p, _, _ in done], pa.int64()),
                pa.array([p[2] for p, _, _ in done], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([p[3] for p, _, _ in done], pa.int64()),
                pa.array([s for _, s, _ in done], pa.int64()),
                pa.array([o for _, _, o in done], pa.int64()),
                pa.array(ids if keep_ids else [None] * len(ids), pa.binary()),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                total, at = len(raw) // 4, 0
                for length, k in cut(total, capacity, slack):
                    done.extend(packer.add((doc, at, length, total, raw[4 * at : 4 * (at + length)]), k))
                    at += length
                if len(done) >= _BATCH:
                    yield batch()
        done.extend(packer.finish(resized))
        if done:
            yield batch()

    small_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
    return out if keep_ids else out.drop("ids")
