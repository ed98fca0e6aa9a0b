"""Sharding by longest processing time over groups that stay together.

Rows with equal texts are one group.  Groups, the largest first, go to the
least-loaded shard through a heap.  Only a bounded number of items meet on the
driver: groups of at least total/HEAVY bytes (HEAVY of them at most) stand for
themselves, and all lighter groups are dealt by their digest into LIGHT buckets,
each of which is one item.  A group never leaves its bucket, so it stays together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import stash, whole_text

SHARDS = 8
HEAVY = 8192
LIGHT = 16384
#: Rows that are numbered in one task, about.
_NUMBERED = 100_000


def schedule(items: list[tuple[int, object]], shards: int) -> dict:
    """LPT: key -> shard for (size, key) items; ties by key, then by shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heap[0]
        out[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes plus 1), text_crc32,
    law (``bytes``), shard, slot (gapless in the shard from 0), grown_shard (null).

    Null and empty texts are one group of size-1 rows; long texts count whole.
    Repeated rows are rows of their own, and null doc_ids are numbered like any
    other: rows are dealt to the tasks that number them by their place in the table,
    so no value of a column can crowd one of them.  Groups of equal size go by
    digest.  Other columns aren't read.  No rows give no rows.
    """
    text = whole_text()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
    ).withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(LIGHT)).cast("int"))
    rows = stash(rows, "sized")
    groups = rows.groupBy("sha", "bucket").agg(F.sum("size").alias("size"))
    groups = stash(groups, "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy = [(r["size"], bytes(r["sha"])) for r in groups.filter(F.col("size") * HEAVY >= F.lit(total)).collect()] if total else []
    light = [(r["size"], r["bucket"]) for r in groups.filter(F.col("size") * HEAVY < F.lit(total)).groupBy("bucket").agg(F.sum("size").alias("size")).collect()] if total else []
    plan = schedule([(n, ("group", k.hex())) for n, k in heavy] + [(n, ("bucket", k)) for n, k in light], shards)
    spark = docs.sparkSession
    by_group = spark.createDataFrame([(bytearray.fromhex(k), s) for (kind, k), s in plan.items() if kind == "group"], "h_sha binary, h_shard int")
    by_bucket = spark.createDataFrame([(k, s) for (kind, k), s in plan.items() if kind == "bucket"], "b_bucket int, b_shard int")
    # both are bounded: HEAVY and LIGHT rows
    placed = rows.join(F.broadcast(by_group), F.col("sha") == F.col("h_sha"), "left").join(F.broadcast(by_bucket), F.col("bucket") == F.col("b_bucket"), "left")
    placed = placed.select("row", "doc_id", "size", "text_crc32", F.coalesce("h_shard", "b_shard").alias("shard"))
    parts = max(1, -(-rows.count() // (_NUMBERED * shards)))
    placed = stash(placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "placed")
    # parts x shards counts, a hundred-thousandth of the rows
    before = placed.groupBy("shard", "part").count().select(F.col("shard").alias("_s"), F.col("part").alias("_p"), F.col("count").alias("_n"))
    before = before.select("_s", "_p", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_p")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    numbered = placed.withColumn("_local", local - 1)
    out = numbered.join(before, (F.col("shard") == F.col("_s")) & (F.col("part") == F.col("_p")))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_local")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
