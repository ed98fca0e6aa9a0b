"""Node weights: how central a node is."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import stash
from ..plans.params import Heuristic
from .distance import Made, by_strips, row_strip

#: Decimals of a harmonic mean that count; below lies the noise of the summing order.
DECIMALS = 9


def _ranked(scored: DataFrame, *order) -> DataFrame:
    """Ranks from 0 over one row a node, and rank/n as the weight."""
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    return scored.select("node_id", rank.cast("long").alias("rank"), (rank / n).alias("weight"))


def harmonic(nodes: DataFrame, dist: DataFrame) -> DataFrame:
    """(node_id, rank, weight): by the harmonic mean of a row's distances, the
    smaller first; ties by the larger group, then by node_id."""
    n = nodes.count()
    mean = dist.groupBy(F.col("i").alias("node_id")).agg(F.round(F.lit(float(n)) / F.sum(1 / (F.col("d") + 0.1)), DECIMALS).alias("h"))
    return _ranked(mean.join(nodes.select("node_id", "n_str"), "node_id"), "h", F.desc("n_str"), "node_id")


def _float_means(strip: np.ndarray) -> np.ndarray:
    total = np.sum(np.float32(1) / (strip + np.float32(0.1)), axis=1)
    return (np.float32(strip.shape[1]) / total).astype(np.float64)


def harmonic_exact(nodes: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Like harmonic() in float32 throughout, summed as NumPy sums a row; from the
    rectangles of the matrix, whose rows meet a block at a time."""

    def mean(table: pa.Table) -> pa.Table:
        ids, strip = row_strip(table)
        return pa.table({"node_id": ids, "h": _float_means(strip)})

    rows = rectangles.groupBy("i").applyInArrow(mean, "node_id long, h double")
    return _ranked(rows.join(nodes.select("node_id", "n_str"), "node_id"), "h", F.desc("n_str"), "node_id")


def harmonic_made(nodes: DataFrame, make: Callable[[], Made]) -> DataFrame:
    """harmonic_exact() of strips that are made in place."""

    def mean(ids: np.ndarray, strip: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node_id": ids, "h": _float_means(strip)})

    rows = by_strips(nodes.sparkSession, nodes.count(), make, mean, "node_id long, h double")
    return _ranked(rows.join(nodes.select("node_id", "n_str"), "node_id"), "h", F.desc("n_str"), "node_id")


def eburst(nodes: DataFrame, dist: DataFrame) -> DataFrame:
    """(node_id, rank, weight): by the number of neighbours at whole distance 1,
    then 2 and so on, the more the earlier, and the group's size last."""
    whole = dist.select(F.col("i").alias("node_id"), F.col("d").cast("int").alias("d"))
    most = whole.agg(F.max("d")).first()[0] or 0
    counts = whole.groupBy("node_id", "d").count().join(nodes.select("node_id", "n_str"), "node_id")
    held = counts.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("d", (F.col("count") + F.when(F.col("d") == 0, F.col("n_str")).otherwise(0)).alias("c")))).alias("by"))
    places = [*range(1, most + 1), 0]
    key = F.transform(F.array(*[F.lit(p) for p in places]), lambda p: -F.coalesce(F.col("by")[p], F.lit(0)))
    return _ranked(held.select("node_id", key.alias("key")), "key", "node_id")


def eburst_made(nodes: DataFrame, make: Callable[[], Made]) -> DataFrame:
    """eburst() of strips that are made in place, whose rows are counted there."""

    def counted(ids: np.ndarray, strip: np.ndarray) -> pa.RecordBatch:
        whole = strip.astype(np.int32)
        wide = int(whole.max(initial=0)) + 1
        counts = np.bincount((whole + np.arange(len(ids), dtype=np.int64)[:, None] * wide).ravel(), minlength=len(ids) * wide).reshape(-1, wide)
        return pa.RecordBatch.from_pydict({"node_id": ids, "by": pa.array(list(counts), pa.list_(pa.int64()))})

    held = stash(by_strips(nodes.sparkSession, nodes.count(), make, counted, "node_id long, by array<long>"), "counts")
    most = held.agg(F.max(F.size("by"))).first()[0] or 1
    key = F.transform(F.concat(F.sequence(F.lit(1), F.lit(most)), F.array(F.lit(0))), lambda k: -(F.coalesce(F.get("by", k), F.lit(0)) + F.when(k == 0, F.col("n_str")).otherwise(0)))
    return _ranked(held.join(nodes.select("node_id", "n_str"), "node_id").select("node_id", key.alias("key")), "key", "node_id")


def harmonic_rounded(nodes: DataFrame, make: Callable[[], Made]) -> DataFrame:
    """harmonic() of strips that are made in place."""

    def mean(ids: np.ndarray, strip: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node_id": ids, "h": strip.shape[1] / np.sum(1 / (strip.astype(np.float64) + 0.1), axis=1)})

    rows = by_strips(nodes.sparkSession, nodes.count(), make, mean, "node_id long, h double").withColumn("h", F.round("h", DECIMALS))
    return _ranked(rows.join(nodes.select("node_id", "n_str"), "node_id"), "h", F.desc("n_str"), "node_id")


def weights_made(nodes: DataFrame, make: Callable[[], Made], heuristic: Heuristic) -> DataFrame:
    """weights() of strips that are made in place."""
    return harmonic_rounded(nodes, make) if heuristic is Heuristic.HARMONIC else eburst_made(nodes, make)


def weights(nodes: DataFrame, dist: DataFrame, heuristic: Heuristic) -> DataFrame:
    return harmonic(nodes, dist) if heuristic is Heuristic.HARMONIC else eburst(nodes, dist)
