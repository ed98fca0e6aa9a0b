"""Symmetric minimum spanning trees and the lengths of their edges.

Edges are totally ordered by (cost, i, j), so the tree is unique: each partition
keeps the tree of its own edges, and the tree of those survivors is the tree of
the whole.  A partition hands on n - 1 edges at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.params import Missing
from .distance import Made, kernel, one_task

FAN_IN = 8
#: Edges that a task gathers before it reduces them to their forest.
AT_ONCE = 2_000_000


def costs(dist: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, j, cost) with i < j: the rounded distance and the smaller weight.  A cost
    of exactly 0 is no edge."""
    w = weights.select("node_id", "weight")
    out = dist.filter("i < j").join(w.select(F.col("node_id").alias("i"), F.col("weight").alias("wi")), "i")
    out = out.join(w.select(F.col("node_id").alias("j"), F.col("weight").alias("wj")), "j")
    return out.select("i", "j", (F.round("d") + F.least("wi", "wj")).alias("cost")).filter("cost <> 0")


def kruskal(f: pd.DataFrame) -> pd.DataFrame:
    """The spanning forest of edges (i, j, cost), the one that taking them by (cost, i,
    j) gives.  That order is total, so rounds in which every component takes its first
    edge outwards find the same edges, with arrays."""
    order = np.lexsort((f["j"].to_numpy(), f["i"].to_numpy(), f["cost"].to_numpy()))
    names, ends = np.unique(np.concatenate([f["i"].to_numpy()[order], f["j"].to_numpy()[order]]), return_inverse=True)
    a, b = ends[: len(order)], ends[len(order) :]
    label, at, kept = np.arange(len(names)), np.arange(len(order)), []
    while len(at):
        x, y = label[a[at]], label[b[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            break
        both = np.concatenate([x, y])
        first = np.full(len(names), len(at))
        np.minimum.at(first, both, np.tile(np.arange(len(at)), 2))
        picks = np.unique(first[first < len(at)])
        kept.append(at[picks])
        up = np.arange(len(names))
        for p, q in zip(x[picks].tolist(), y[picks].tolist(), strict=True):
            while up[p] != p:
                up[p] = p = up[up[p]]
            while up[q] != q:
                up[q] = q = up[up[q]]
            up[q] = p
        while (up != up[up]).any():
            up = up[up]
        label = up[label]
    return f.iloc[np.sort(order[np.concatenate(kept)])] if kept else f.iloc[:0]


def prim(m: Made, w: np.ndarray) -> pd.DataFrame:
    """The tree of spanning_tree(costs(...)) as (i, j, cost), of a matrix whose rows are made as a
    node joins the tree.  Edges are compared by (cost, i, j) too, so it is the same; several
    components, where costs of 0 part them, are a forest.  It holds a few numbers a node."""
    n, out = len(w), []
    rest = np.arange(1, n)  # nodes outside, each with its best edge inwards; some are done
    cost, inner, done = np.full(len(rest), np.inf), np.zeros(len(rest), np.int64), np.zeros(len(rest), bool)
    bits, u = m.bits[rest] if n > 1 else None, 0
    while (left := len(rest) - np.count_nonzero(done)) > 0:
        if left < 0.8 * len(rest):
            rest, cost, inner, bits = rest[~done], cost[~done], inner[~done], bits[~done]
            done = np.zeros(left, bool)
        c = np.floor(kernel(m.bits[np.array([u])], bits, *m.rule)[0].astype(np.float64) + 0.5) + np.minimum(w[u], w[rest])
        c[(c == 0) | done] = np.inf
        # of equal edges to a node, that from the smaller one comes first, whichever end is smaller
        nearer = (c < cost) | ((c == cost) & (u < inner) & (c < np.inf))
        cost[nearer], inner[nearer] = c[nearer], u
        ties = np.flatnonzero(cost == cost.min())
        if np.isinf(cost[ties[0]]):
            k = int(np.flatnonzero(~done)[0])  # another component
        else:
            k = int(min(ties, key=lambda k: (min(inner[k], rest[k]), max(inner[k], rest[k]))) if len(ties) > 1 else ties[0])
            out.append((min(int(inner[k]), int(rest[k])), max(int(inner[k]), int(rest[k])), float(cost[k])))
        u, done[k], cost[k] = int(rest[k]), True, np.inf
    return pd.DataFrame(out, columns=["i", "j", "cost"]).astype({"i": "int64", "j": "int64", "cost": "float64"})


def spanning_tree_made(spark: SparkSession, make: Callable[[], Made], w: np.ndarray) -> DataFrame:
    """spanning_tree() of a matrix that is made in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            yield prim(make(), w)

    return numbered(one_task(spark).mapInPandas(run, "i long, j long, cost double"), "i", "cost", "j")


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= AT_ONCE:
            held = [kruskal(pd.concat(held))]
            n = 0
    if held:
        yield kruskal(pd.concat(held))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(ord, i, j, cost) of the minimum spanning tree, ordered by (i, cost, j)."""
    schema = "i long, j long, cost double"
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = edges.select("i", "j", "cost").mapInPandas(_local, schema)
    while parts > FAN_IN:  # forests meet a few at a time
        parts = -(-parts // FAN_IN)
        kept = kept.repartition(parts).mapInPandas(_local, schema)
    kept = kept.repartition(1).mapInPandas(_local, schema)
    return numbered(kept, "i", "cost", "j")


def numbered(edges: DataFrame, *order: str) -> DataFrame:
    """At most a row a node, in one task: their order is part of the result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if rows:
            f = pd.concat(rows).sort_values(list(order), kind="stable").reset_index(drop=True)
            f.insert(0, "ord", np.arange(len(f)))
            yield f

    return edges.repartition(1).mapInPandas(run, "ord long, " + ", ".join(f"{n} {t}" for n, t in edges.dtypes))


def linked(edges: DataFrame, nodes: DataFrame, missing: Missing) -> DataFrame:
    """(ord, src, tgt, len): edges (ord, src, tgt) with the number of loci that
    differ, of those that ``missing`` compares."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("codes").alias("x"))
    b = nodes.select(F.col("node_id").alias("tgt"), F.col("codes").alias("y"))
    out = edges.select("ord", "src", "tgt").join(a, "src").join(b, "tgt")
    if missing is Missing.COMPLETE_DELETE:
        gaps = nodes.select(F.posexplode("codes").alias("k", "c")).groupBy("k").agg(F.min("c").alias("m")).orderBy("k").collect()  # a row a locus
        held = F.array(*[F.lit(r["m"] > 0) for r in gaps]) if gaps else F.array().cast("array<boolean>")
        counted = F.zip_with(F.zip_with("x", "y", lambda x, y: x != y), held, lambda d, h: (d & h).cast("int"))
    elif missing is Missing.AS_ALLELE:
        counted = F.zip_with("x", "y", lambda x, y: (x != y).cast("int"))
    else:
        counted = F.zip_with("x", "y", lambda x, y: ((x > 0) & (y > 0) & (x != y)).cast("int"))
    return out.select("ord", "src", "tgt", F.aggregate(counted, F.lit(0), lambda s, c: s + c).cast("long").alias("len"))
