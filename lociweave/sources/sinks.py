"""PHYLIP matrices and NEWICK trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distance import BLOCK, Made, row_strip

#: Cells of a strip of rows that become text together.
TEXT_CELLS = 1 << 20


def phylip_cells(nodes: DataFrame, dist: DataFrame, scale: float | None = None) -> DataFrame:
    """(row_node, row_name, col_node, col_name, cell): every member of a group of
    equal rows has a row and a column; cells are divided by ``scale`` as floats."""
    members = nodes.select("node_id", F.explode("members").alias("member"))
    a = members.select(F.col("node_id").alias("i"), F.col("member").alias("row_name"))
    b = members.select(F.col("node_id").alias("j"), F.col("member").alias("col_name"))
    cell = F.col("d") if scale is None else (F.col("d").cast("double") / F.lit(float(scale))).cast("float").cast("double")
    out = dist.join(a, "i").join(b, "j")
    return out.select(F.col("i").alias("row_node"), "row_name", F.col("j").alias("col_node"), "col_name", cell.alias("cell"))


def phylip_lines(cells: DataFrame) -> DataFrame:
    """(ord, line) of the square matrix; the first line holds the number of rows."""
    rows = cells.groupBy("row_node", "row_name").agg(F.array_sort(F.collect_list(F.struct("col_node", "col_name", "cell"))).alias("cs"))

    def text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:  # Java's rounding of %.6f differs from C's on ties
            lines = [f"{n:<10} " + " ".join(f"{c['cell']:.6f}" for c in cs) for n, cs in zip(f["row_name"], f["cs"], strict=True)]
            yield pd.DataFrame({"row_node": f["row_node"], "row_name": f["row_name"], "line": lines})

    lines = rows.mapInPandas(text, "row_node long, row_name string, line string")
    head = rows.agg(F.concat(F.lit("    "), F.count("*").cast("string")).alias("line")).select(F.lit(-1).cast("long").alias("row_node"), F.lit("").alias("row_name"), "line")
    return head.unionByName(lines)


def phylip_text_made(nodes: DataFrame, make: Callable[[], Made], scale: float | None = None) -> DataFrame:
    """phylip_text() of rows that are made in place, a few at a time."""
    spark = nodes.sparkSession
    held = nodes.select("node_id", "members").orderBy("node_id").collect()  # the names of one matrix
    members = [r["members"] for r in held]
    times = np.repeat(np.arange(len(members)), [len(m) for m in members])
    step = max(1, min(BLOCK, TEXT_CELLS // max(1, len(times))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = make()
        for rows in batches:
            for k in rows.column(0).to_pylist():
                ids = np.arange(k * step, min(len(members), (k + 1) * step))
                strip = m.block(ids)
                if scale is not None:
                    strip = (strip.astype(np.float64) / scale).astype(np.float32)
                for i, row in zip(ids.tolist(), strip, strict=True):
                    values, at = np.unique(row, return_inverse=True)
                    text = np.array([f"{x:.6f}" for x in values.tolist()], object)
                    cells = " ".join(text[at[times]].tolist())
                    for name in members[i]:  # one line at a time: it is as long as the matrix is wide
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([name]), pa.array([f"{name:<10} {cells}"])], ["row_node", "row_name", "line"])

    count = -(-len(members) // step)
    lines = spark.range(0, count, 1, max(1, min(count, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "row_node long, row_name string, line string")
    head = spark.createDataFrame([(-1, "", f"    {len(times)}")], "row_node long, row_name string, line string")
    return head.unionByName(lines)


def phylip_text(nodes: DataFrame, rectangles: DataFrame, scale: float | None = None) -> DataFrame:
    """The rows of phylip_lines() from the rectangles of a matrix, a strip of rows at a
    time, without a row for each cell."""
    times = [r["n_str"] for r in nodes.select("node_id", "n_str").orderBy("node_id").collect()]  # a number a column of one matrix

    def text(table: pa.Table) -> pa.Table:
        ids, strip = row_strip(table)
        if scale is not None:
            strip = (strip.astype(np.float64) / scale).astype(np.float32)
        lines = [" ".join(v for x, n in zip(row, times, strict=True) for v in [f"{x:.6f}"] * n) for row in strip.tolist()]
        return pa.table({"node_id": ids, "cells": lines})

    members = nodes.select("node_id", F.explode("members").alias("row_name"))
    rows = rectangles.groupBy("i").applyInArrow(text, "node_id long, cells string").join(members, "node_id")
    name = F.when(F.length("row_name") < 10, F.rpad("row_name", 10, " ")).otherwise(F.col("row_name"))
    lines = rows.select(F.col("node_id").alias("row_node"), "row_name", F.concat(name, F.lit(" "), "cells").alias("line"))
    head = members.agg(F.concat(F.lit("    "), F.count("*").cast("string")).alias("line")).select(F.lit(-1).cast("long").alias("row_node"), F.lit("").alias("row_name"), "line")
    return head.unionByName(lines)


def write_phylip(lines: DataFrame, path: str) -> None:
    """The lines of a matrix as text, in order; files are in the order of their names."""
    lines.orderBy("row_node", "row_name").select("line").write.text(path)


def write_newick(trees: DataFrame, path: str) -> None:
    """One tree a line."""
    trees.select("newick").write.text(path)
