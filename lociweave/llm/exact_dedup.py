"""Exact dedup by a tree-merge of sorted digest runs.

Every reader partition sorts its (digest, identifier) records into runs.  The
runs then travel through binomial rounds: in round r the partitions whose slot
numbers differ only in digit r form a group, each hands every partner the
records whose digest carries the partner's digit, and each merges the sorted runs
it received as a tournament, in which each pair of runs is merged by the places of
one in the other, keeping one record per digest with the smallest identifier and
the summed count.  After the last round a slot holds every record of its digest
range exactly once.  No slot ever receives more than its share of the *distinct*
digests, so a text that fills a third of the table is one record per run; there are
as many slots as keep that share within SLOT_ROWS records, whatever the table holds.

Verification: a record is keyed by SHA-256 of the normalised text, its length in
bytes and an independent XXH64; at every merge two records are taken for one
text only if all three agree, so texts that share a digest but not the others
stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, fresh, looked_up, row_key, shuffle_width, stash, whole_text

#: key: 32 bytes SHA-256, 8 bytes length, 8 bytes XXH64 (both big-endian).
RECORD = np.dtype([("key", "S48"), ("no_id", "u1"), ("doc_id", "<i8"), ("row", "<i8"), ("size", "<i8")])
#: Two bits a round: four runs meet at each merge.
BITS = 2
RUN_ROWS = 400_000
#: Records that a slot may hold, about: 100 MB.
SLOT_ROWS = 1_000_000
BLOB_ROWS = 20_000

_BLOBS = "dest int, body binary"
_GROUPS = "sha binary, n_bytes long, xx long, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, key (of the text as it is), sha, n_bytes, xx of every row; ``row`` numbers the rows."""
    text = F.regexp_replace(whole_text(), SPACES, " ")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text.alias("_t"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "key",
            F.unhex(F.sha2(F.col("_t"), 256)).alias("sha"),
            F.octet_length("_t").cast("long").alias("n_bytes"),
            F.xxhash64("_t").alias("xx"),
        )
    )


def _one_per_key(rows: np.ndarray) -> np.ndarray:
    """Of sorted rows, the first of every key with the summed size."""
    if not len(rows):
        return rows
    starts = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
    out = rows[starts]
    out["size"] = np.add.reduceat(rows["size"], starts)
    return out


def sorted_run(rows: np.ndarray) -> np.ndarray:
    """Rows as a run: by (key, null identifiers last, identifier, row), one per key."""
    return _one_per_key(rows[np.lexsort((rows["row"], rows["doc_id"], rows["no_id"], rows["key"]))])


def _merged_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One run from two.  A key is once in each, so its two records come together."""
    out = np.empty(len(a) + len(b), RECORD)
    at = np.searchsorted(a["key"], b["key"], "right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = b, a
    second = np.flatnonzero(out["key"][1:] == out["key"][:-1]) + 1
    if not len(second):
        return out
    x, y = out[second - 1], out[second]
    smaller = (y["no_id"] < x["no_id"]) | (y["no_id"] == x["no_id"]) & ((y["doc_id"] < x["doc_id"]) | (y["doc_id"] == x["doc_id"]) & (y["row"] < x["row"]))
    kept = np.where(smaller, y, x)
    kept["size"] = x["size"] + y["size"]
    out[second - 1] = kept
    return np.delete(out, second)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run from several, by a tournament of merges; equal keys become the
    record with the smallest (identifier, row), null identifiers last, and the
    summed size."""
    while len(runs) > 1:
        runs = sorted(runs, key=len)
        runs = [_merged_pair(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


def _records(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, RECORD)
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    fixed = np.empty((batch.num_rows, 48), np.uint8)
    fixed[:, :32] = np.frombuffer(b"".join(col["sha"].to_pylist()), np.uint8).reshape(-1, 32)
    for at, name in ((32, "n_bytes"), (40, "xx")):
        fixed[:, at : at + 8] = col[name].to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
    out["key"] = fixed.reshape(-1).view("S48")
    out["no_id"] = col["doc_id"].is_null().to_numpy(zero_copy_only=False)
    out["doc_id"] = col["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
    out["row"] = col["row"].to_numpy(zero_copy_only=False)
    out["size"] = 1
    return out


def _slots(run: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(run["key"]).view(np.uint8).reshape(-1, 48)
    return np.ascontiguousarray(raw[:, :4]).view(">u4").reshape(-1).astype(np.int64)


def _hand_out(slot: int, run: np.ndarray, digit: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The run's parts for the partners of ``slot`` in the round of ``digit``."""
    mask = ((1 << min(BITS, bits - digit)) - 1) << digit
    dest = (slot & ~mask) | (_slots(run) & mask)
    for to in np.unique(dest):
        part = run[dest == to]
        for at in range(0, len(part), BLOB_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(to)], pa.int32()), pa.array([part[at : at + BLOB_ROWS].tobytes()], pa.binary())], ["dest", "body"]
            )


def _first_runs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % (1 << bits)
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_records(batch))
                n += batch.num_rows
            if n >= RUN_ROWS:
                yield from _hand_out(slot, sorted_run(np.concatenate(held)), 0, bits)
                held, n = [], 0
        if held:
            yield from _hand_out(slot, sorted_run(np.concatenate(held)), 0, bits)

    return run


def _round(digit: int | None, bits: int):
    """Merge what each slot received; hand on for ``digit``, or give the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for to, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = by.setdefault(to, [])
                runs.append(np.frombuffer(body, RECORD))
                if len(runs) >= 64:  # a bounded number of open runs
                    by[to] = [merge_runs(runs)]
        for slot, runs in by.items():
            merged = merge_runs(runs)
            if digit is not None:
                yield from _hand_out(slot, merged, digit, bits)
                continue
            for at in range(0, len(merged), BLOB_ROWS):
                part = merged[at : at + BLOB_ROWS]
                raw = np.ascontiguousarray(part["key"]).view(np.uint8).reshape(-1, 48)
                whole = lambda a, b: np.ascontiguousarray(raw[:, a:b]).view(">i8").reshape(-1).astype(np.int64)  # noqa: B023, E731
                shas = np.ascontiguousarray(raw[:, :32]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shas[i : i + 32] for i in range(0, len(shas), 32)], pa.binary()),
                        pa.array(whole(32, 40)),
                        pa.array(whole(40, 48)),
                        pa.array(part["doc_id"], mask=part["no_id"].astype(bool)),
                        pa.array(part["row"]),
                        pa.array(part["size"]),
                    ],
                    ["sha", "n_bytes", "xx", "keep_id", "keep_row", "group_size"],
                )

    return run


def merged_groups(keyed: DataFrame) -> DataFrame:
    """One row per distinct text of ``digests()`` rows, by the tree-merge."""
    wanted = max(2, shuffle_width(keyed.sparkSession), keyed.count() // SLOT_ROWS)
    bits = max(BITS, math.ceil(math.log2(wanted)))
    slots = 1 << bits
    state = keyed.mapInArrow(_first_runs(bits), _BLOBS)
    for digit in range(BITS, bits, BITS):
        state = state.repartitionById(slots, F.col("dest")).mapInArrow(_round(digit, bits), _BLOBS)
    return state.repartitionById(slots, F.col("dest")).mapInArrow(_round(None, bits), _GROUPS)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept, sha of every row."""
    keyed = stash(digests(docs), "digests")
    groups = merged_groups(keyed.drop("key"))
    same = [F.col("k.sha") == F.col("g.sha"), F.col("k.n_bytes") == F.col("g.n_bytes"), F.col("k.xx") == F.col("g.xx")]
    both = keyed.alias("k").join(groups.alias("g"), same[0] & same[1] & same[2])
    return both.select(F.col("k.doc_id"), "key", "keep_id", "group_size", (F.col("k.row") == F.col("g.keep_row")).alias("kept"), F.col("k.sha").alias("sha"))


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, dropped ones too: doc_id, keep_id,
    group_size, kept, text_sha256.

    Null and empty texts are one text; long texts count whole.  A null doc_id sorts
    after all others, so keep_id is null only where a whole group has none.  Of
    repeated rows (one doc_id, one text) one is kept.  Only doc_id and text are read;
    other columns, whatever their names, don't matter.  An empty table gives no rows.
    """
    return _marked(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is found again by its doc_id and a hash of its text as it is.  Rows that
    repeat both are copies of each other in all that counts here; one of them stays.
    Only rows that may go are shuffled, if any.
    """
    marked = stash(_marked(docs).select("doc_id", "key", "kept"), "marked")
    id_, key = fresh(docs, "gone_id", "gone_key")
    gone = stash(marked.filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct(), "copies")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("key") == F.col(key))
    twice = stash(marked.filter("kept").join(gone, same, "left_semi").select(F.col("doc_id").alias(id_), F.col("key").alias(key)), "repeated")
    if twice.isEmpty():
        return looked_up(docs, gone, "left_anti")
    mine = F.col(f"g.{id_}").eqNullSafe(F.col(f"t.{id_}")) & (F.col(f"g.{key}") == F.col(f"t.{key}"))
    all_gone = stash(gone.alias("g").join(twice.alias("t"), mine, "left_anti"), "copies-alone")
    (own,) = fresh(docs, "own")
    one = looked_up(docs, twice, "inner").withColumn(own, row_key()).dropDuplicates(["doc_id", own]).drop(own)
    return looked_up(looked_up(docs, all_gone, "left_anti"), twice, "left_anti").unionByName(one)
