"""Packed token-id matrices by best-fit-decreasing with a segment tree.

Each worker tokenises its rows, splits documents that are longer than a sequence
into full pieces and a rest, and packs blocks of pieces: the longest first, each
into the fullest open sequence that still holds it.  A segment tree over the free
capacities (how many open sequences have each) finds that sequence in
O(log capacity).  A block is bounded by its tokens, so a worker's memory is too;
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoder

LENGTH = 2048
BLOCK_TOKENS = 4_000_000
END_ID = 50256
PAD_ID = 50256

ROWS = (
    "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<long>, doc_rows array<long>, starts array<long>"
)


class CapacityTree:
    """A segment tree over free capacities 0..capacity: the least one >= x in use."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)

    def change(self, free: int, by: int) -> None:
        at = free + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def best_fit(self, need: int) -> int | None:
        at = need + self.base
        if self.count[at]:
            return need
        while at > 1:  # up to the first right sibling in use, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths`` (each from 1 to the capacity)."""
    tree, open_, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        free = tree.best_fit(n)
        if free is None:
            bins.append([])
            at, free = len(bins) - 1, capacity
        else:
            at = open_[free].pop()
            tree.change(free, -1)
        bins[at].append(i)
        if free > n:
            open_.setdefault(free - n, []).append(at)
            tree.change(free - n, 1)
    return bins


def token_matrix(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, end_id: int = END_ID, pad_id: int = PAD_ID, dtype: str = "<u2") -> DataFrame:
    """One row per packed sequence.

    ids: ``length`` ids in ``dtype`` bytes, padded with ``pad_id`` after n_tokens.
    cu_seqlens: cumulative segment lengths from 0 to n_tokens.  position_resets:
    places where the position starts again from 0, the segments' starts.
    doc_ids, doc_rows, starts: of each segment its document, the row it came from
    (rows with one doc_id differ) and the number of that row's ids before it.

    A document's ids are those of its whole text (null: empty) and ``end_id``; none
    is lost, whatever its length.  No rows give no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).ids, TaskContext.get().partitionId()
        row, seq, pieces, tokens = part << 33, part << 36, [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            bins = best_fit_decreasing([len(p[3]) for p in pieces], length)
            for at in range(0, len(bins), 512):
                out = []
                for bin_ in bins[at : at + 512]:
                    got = [pieces[i] for i in bin_]
                    cu = np.cumsum([0, *(len(p[3]) for p in got)]).tolist()
                    ids = np.full(length, pad_id, dtype)
                    ids[: cu[-1]] = np.concatenate([p[3] for p in got])
                    out.append((seq, cu[-1], len(got), ids.tobytes(), cu, cu[:-1], [p[0] for p in got], [p[1] for p in got], [p[2] for p in got]))
                    seq += 1
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])
            pieces.clear()

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                ids = np.append(np.frombuffer(encode(text.as_py() or ""), "<u4"), end_id)
                if width < 4 and ids.max() >= 1 << (8 * width):
                    raise ValueError(f"ids of this vocabulary don't fit {dtype}")
                ids = ids.astype(dtype)
                for at in range(0, len(ids), length):
                    pieces.append((doc, row, at, ids[at : at + length]))
                row, tokens = row + 1, tokens + len(ids)
                if tokens >= block_tokens:
                    yield from blocks()
                    tokens = 0
        if pieces:
            yield from blocks()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def write_token_matrix(docs: DataFrame, path: str, **how) -> None:
    """Write the packed sequences as Parquet files under ``path``."""
    token_matrix(docs, **how).write.parquet(path)
