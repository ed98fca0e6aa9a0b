"""Whole methods: from a profile to a matrix or a tree.

The relational stages are DataFrame plans, and distances are made by all tasks.  The
kernels that are sequential by nature (contraction, refinement, joining, the
tree's text) run in one task per profile.  They make what they need of the matrix from
the codes; joining holds n^2 / 3 bytes at most, a network 4 m^2 for the m nodes that no shortcut
absorbs.  Codes of more than BROADCAST_BYTES go through the written matrix, 4 n^2 bytes.
Many profiles run side by side, one a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stash
from ..operators import branching, distance, encode, mst, network, nj, recraft, tree
from ..operators import weights as node_weights
from ..sources import sinks
from .params import Heuristic, Matrix, Method, Missing, Params


def distance_matrix(profile: DataFrame, params: Params) -> DataFrame:
    """Cells of the PHYLIP matrix: see sinks.phylip_cells.  Divided by the number of
    loci except where distances are absolute or block-wise."""
    nodes = encode.nodes_of(profile, params.missing)
    dist = distance.distances(nodes, params.matrix, params.missing, params.block_penalty)
    plain = params.missing is Missing.ABSOLUTE_DISTANCE or params.matrix is Matrix.BLOCKWISE
    first = nodes.select(F.size("codes")).first()
    return sinks.phylip_cells(nodes, dist, None if plain or first is None else float(first[0]))


def distance_text(profile: DataFrame, params: Params) -> DataFrame:
    """(row_node, row_name, line) of the PHYLIP matrix as text."""
    nodes = encode.nodes_of(profile, params.missing)
    plain = params.missing is Missing.ABSOLUTE_DISTANCE or params.matrix is Matrix.BLOCKWISE
    first = nodes.select(F.size("codes")).first()
    scale = None if plain or first is None else float(first[0])
    if make := distance.made(nodes, params.matrix, params.missing, params.block_penalty):
        return sinks.phylip_text_made(nodes, make, scale)
    return sinks.phylip_text(nodes, distance.rectangles(nodes, params.matrix, params.missing, params.block_penalty), scale)


def matrix_of(nodes: DataFrame, matrix: Matrix, missing: Missing) -> DataFrame:
    """The rectangles of a matrix, written once."""
    return stash(distance.rectangles(nodes, matrix, missing), "matrix")


def network_edges(nodes: DataFrame, params: Params, weights: DataFrame | None = None) -> DataFrame:
    """(ord, src, tgt, brlen) of the directed network, refined where asked; weights
    are those of the asymmetric distances unless given, harmonic ones in float32."""
    make = distance.made(nodes, Matrix.ASYMMETRIC, params.missing)
    rects = matrix_of(nodes, Matrix.ASYMMETRIC, params.missing) if make is None else None  # codes that are too large to be sent
    if weights is None:
        if params.heuristic is Heuristic.EBURST:
            weights = node_weights.eburst(nodes, distance.cells_of(rects)) if make is None else node_weights.eburst_made(nodes, make)
        else:
            weights = node_weights.harmonic_exact(nodes, rects) if make is None else node_weights.harmonic_made(nodes, make)
    w = np.array([r["weight"] for r in weights.select("node_id", "weight").orderBy("node_id").collect()])  # a number a node of one matrix
    first = nodes.select(F.size("codes")).first()
    loci = first[0] if first else 0

    short = None if make is None else [(r["src"], r["tgt"]) for r in network.shortcuts_made(nodes.sparkSession, make, w).orderBy("tgt").collect()]  # a row a node of one matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if make is None:
            d = distance.as_matrix(batches, len(w))
        else:
            d = make()
            for _ in batches:
                pass
        edges = network.asymmetric_network(d, w, params.native, short)
        if params.recraft and edges:
            edges = recraft.recraft(edges, d, w, loci, "native" if params.native else params.recraft_mode)
        src, tgt, length = ([e[k] for e in edges] for k in range(3))
        cols = [pa.array(range(len(edges)), pa.int64()), pa.array(src, pa.int64()), pa.array(tgt, pa.int64()), pa.array(length, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, ["ord", "src", "tgt", "brlen"])

    return (distance.one_task(nodes.sparkSession) if make else rects.coalesce(1)).mapInArrow(run, "ord long, src long, tgt long, brlen double")


def tree_edges(profile: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges (ord, src, tgt, len)) of a spanning method."""
    params = params.resolved()
    nodes = encode.nodes_of(profile, params.missing)
    if params.matrix is Matrix.ASYMMETRIC:
        edges = network_edges(nodes, params)
    elif make := distance.made(nodes, params.matrix, params.missing, params.block_penalty):
        w = node_weights.weights_made(nodes, make, params.heuristic).orderBy("node_id").collect()  # a number a node of one matrix
        tree = mst.spanning_tree_made(nodes.sparkSession, make, np.array([r["weight"] for r in w]))
        edges = tree.select("ord", F.col("i").alias("src"), F.col("j").alias("tgt"))
    else:  # codes that are too large to be sent
        dist = stash(distance.distances(nodes, params.matrix, params.missing, params.block_penalty).filter("i <= j"), "dist")
        both = dist.unionByName(dist.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
        w = node_weights.weights(nodes, both, params.heuristic)
        edges = mst.spanning_tree(mst.costs(dist, w)).select("ord", F.col("i").alias("src"), F.col("j").alias("tgt"))
    return nodes, mst.linked(stash(edges, "edges"), nodes, params.missing)


def newick_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(newick): the oriented tree with rows that were collapsed put back."""

    def run(key, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        names = dict(zip(f["node_id"].tolist(), f["name"].tolist(), strict=True))
        members = {i: list(m) for i, m in zip(f["node_id"].tolist(), f["members"].tolist(), strict=True)}
        triples = [(int(s), int(t), float(x)) for s, t, x in e.sort_values("ord")[["src", "tgt", "len"]].itertuples(index=False)]
        return pd.DataFrame({"newick": [tree.newick(tree.build_tree(triples, names, members))]})

    one = edges.withColumn("_k", F.lit(0)).groupBy("_k")
    two = nodes.select("node_id", "name", "members").withColumn("_k", F.lit(0)).groupBy("_k")
    return one.cogroup(two).applyInPandas(run, "newick string")


def neighbour_joining(profile: DataFrame, params: Params, post_process: bool = False) -> DataFrame:
    """(newick) over symmetric distances, whatever matrix is named; ``post_process``
    roots it in its middle and collapses tiny branches, as is done to the trees of
    external programs."""
    nodes = encode.nodes_of(profile, params.missing)
    labels = [list(r["members"]) for r in nodes.select("node_id", "members").orderBy("node_id").collect()]  # the rows of one matrix

    make = distance.made(nodes, Matrix.SYMMETRIC, params.missing)
    first = nj.starts(nodes.sparkSession, len(labels), make) if make and len(labels) > nj.FEW else None  # NEAR columns a node of one matrix

    def joined(d, keys: list[str]) -> str:
        return nj.neighbour_joining(d, keys, own=True) if first is None else nj.neighbour_joining_made(make, keys, *first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = None
        if make is None:
            d = distance.as_matrix(batches, len(labels), np.float64)
        elif first is None:
            d = make().block(np.arange(len(labels))).astype(np.float64)
        for _ in batches:
            pass
        if post_process and len(labels) > 2:
            keys = [f"n{k}" for k in range(len(labels))]
            text = nj.post_processed(joined(d, keys), dict(zip(keys, labels, strict=True)))
        else:
            text = joined(d, [nj.group_label(m) for m in labels])
        yield pa.RecordBatch.from_arrays([pa.array([text])], ["newick"])

    rows = distance.one_task(nodes.sparkSession) if make else matrix_of(nodes, Matrix.SYMMETRIC, params.missing).coalesce(1)
    return rows.mapInArrow(run, "newick string")


def run(profile: DataFrame, **given) -> DataFrame:
    """Any method by name: matrix cells for ``distance``, else (newick)."""
    params = Params.of(**given)
    if params.method is Method.DISTANCE:
        return distance_matrix(profile, params.resolved())
    if params.method in (Method.NJ, Method.RAPID_NJ, Method.NINJA):
        return neighbour_joining(profile, params)
    return newick_of(*tree_edges(profile, params))


def branching_of_matrix(spark, path: str | None = None, text: str | None = None) -> DataFrame:
    """(from_node, to_node) of the optimum branching of a dense cost matrix, given
    as tab-separated rows."""
    from ..sources.profiles import numbered_lines

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = [[float(x) for x in line.split("\t")] for line in f.sort_values("line_no")["value"]]
        return pd.DataFrame(branching.lazy_branching(np.array(rows)), columns=["from_node", "to_node"])

    return numbered_lines(spark, path, text).groupBy().applyInPandas(run, "from_node long, to_node long")


__all__ = ["Heuristic", "Method", "Params", "branching_of_matrix", "distance_matrix", "distance_text", "neighbour_joining", "network_edges", "newick_of", "run", "tree_edges"]
