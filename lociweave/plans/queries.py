"""Queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import UNSAFE, is_locus, safe_name
from ..functions.derived import cells_sql, derived_profile
from ..functions.storage import stage_folder, stash
from ..operators import branching, distance, encode, margin, mst, network, tree
from ..operators import weights as node_weights
from ..sources import profiles, sinks
from . import estimate as estimates
from . import pipelines
from .params import Heuristic, Matrix, Missing, Params

PAIR, COMPLETE, ALLELE, ABSOLUTE = Missing


def _profile(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return derived_profile(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rule)


def _nodes(spark: SparkSession, sf_dir: str, rule: str, missing: Missing = PAIR) -> DataFrame:
    return encode.nodes_of(_profile(spark, sf_dir, rule), missing)


# -- encoding ---------------------------------------------------------------


def encode_alleles(spark, sf_dir):
    return encode.encode_cells(_profile(spark, sf_dir, "emb_clonal_miss")).select("row_idx", "locus", F.col("code").cast("long").alias("code"))


def complete_delete_columns(spark, sf_dir):
    return encode.incomplete_loci(encode.encode_cells(_profile(spark, sf_dir, "emb_clonal_miss"))).select(F.col("locus").cast("long").alias("locus"))


def dedup_groups(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "emb_narrow")
    return nodes.select("node_id", "name", F.array_join("members", ",").alias("members"), F.col("n_str").cast("long").alias("n_str"))


def sanitise_names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.concat("c_name", F.lit(" ('"), F.col("c_mktsegment"), F.lit("', \"x\");"))
    return c.select("c_custkey", safe_name(raw).alias("name"))


_HEADER = ("#Name", "ST", "st_id", "#comment", "aspA", "ST_ID", "glnA", "st", "abcZ", "STx")


def profile_columns(spark, sf_dir):
    return spark.createDataFrame([(c, i > 0 and is_locus(c)) for i, c in enumerate(_HEADER)], "col string, is_locus boolean")


def read_profile_text(spark, sf_dir):
    """A profile written out as text and read again: rows, names and alleles."""
    rows = _profile(spark, sf_dir, "emb_clonal_miss")
    lines = rows.select("row_idx", F.concat_ws("\t", "name", F.array_join("alleles", "\t")).alias("line"))
    header = "#name\t" + "\t".join(f"locus{k}" for k in range(64))
    text = spark.createDataFrame([(-1, header)], "row_idx long, line string").unionByName(lines).withColumn("part", F.lit(0))
    back = profiles.read_profile(spark, path=_written(spark, text))
    return back.select("name", F.array_join("alleles", ",").alias("alleles"))


def _written(spark: SparkSession, lines: DataFrame, **how) -> str:
    """The lines (row_idx, part, line) as one file, as a profile is by nature."""
    folder = f"{stage_folder(spark)}/text-{uuid.uuid4().hex}"
    lines.repartition(1).sortWithinPartitions("row_idx", "part").select("line").write.text(folder, **how)
    return folder


def read_profile_headers(spark, sf_dir):
    """Comments, two headers of which the last counts, columns that aren't loci, blank
    lines, unsafe names and lower-case alleles."""
    rows = _profile(spark, sf_dir, "emb_narrow").withColumn("a", F.transform("alleles", lambda a: F.concat(F.lit("x"), a)))
    name = F.concat("name", F.lit(" ('a');"))
    body = rows.select("row_idx", F.lit(0).alias("part"), F.concat_ws("\t", name, F.lit("7"), F.array_join(F.slice("a", 1, 3), "\t"), F.lit("note"), F.array_join(F.slice("a", 4, 3), "\t")).alias("line"))
    blank = rows.select("row_idx", F.lit(1).alias("part"), F.lit("  ").alias("line"))
    head = [(-4, 0, "##made for a query"), (-3, 0, "#name\told"), (-2, 0, "## again"), (-1, 0, "#name\tST\tl0\tl1\tl2\t#note\tl3\tl4\tl5")]
    text = spark.createDataFrame(head, "row_idx long, part int, line string").unionByName(body).unionByName(blank)
    back = profiles.read_profile(spark, path=_written(spark, text))
    return back.select("name", F.array_join("alleles", ",").alias("alleles"))


def read_fasta_gzip(spark, sf_dir):
    """An alignment of lower-case letters over two lines a record, zipped."""
    rows = _profile(spark, sf_dir, "emb_clonal")
    letters = F.transform("alleles", lambda a: F.substring(F.lit("acgt"), a.cast("int") % 4 + 1, F.lit(1)))
    halves = [F.concat(F.lit(">"), "name", F.lit(" made up")), F.array_join(F.slice(letters, 1, 32), ""), F.array_join(F.slice(letters, 33, 32), "")]
    text = rows.select("row_idx", F.posexplode(F.array(*halves)).alias("part", "line"))
    back = profiles.read_profile(spark, path=_written(spark, text, compression="gzip"))
    return back.select("name", F.array_join("alleles", "").alias("sequence"))


# -- distances ----------------------------------------------------------------


def _distance(rule: str, matrix: Matrix, missing: Missing, digits: int = 6):
    def query(spark, sf_dir):
        return distance.rectangles(_nodes(spark, sf_dir, rule, missing), matrix, missing, cells=True, digits=digits)

    return query


def phylip_cells(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "emb_narrow")
    cells = sinks.phylip_cells(nodes, distance.distances(nodes), 6.0)
    return cells.select("row_node", "row_name", "col_node", "col_name", F.round("cell", 6).alias("cell"))


def phylip_text(spark, sf_dir):
    return pipelines.distance_text(_profile(spark, sf_dir, "emb_clonal"), Params())


# -- weights ------------------------------------------------------------------


def _weights(rule: str, matrix: Matrix, which):
    def query(spark, sf_dir):
        nodes = _nodes(spark, sf_dir, rule)
        dist = stash(distance.distances(nodes, matrix), "dist")
        return which(nodes, dist).select("node_id", "rank", F.round("weight", 9).alias("weight"))

    return query


def weights_harmonic_exact(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "emb_clonal_miss")
    make = distance.made(nodes, Matrix.ASYMMETRIC)
    w = node_weights.harmonic_exact(nodes, pipelines.matrix_of(nodes, Matrix.ASYMMETRIC, PAIR)) if make is None else node_weights.harmonic_made(nodes, make)
    return w.select("node_id", "rank", F.round("weight", 9).alias("weight"))


# -- trees --------------------------------------------------------------------


def _asymmetric(spark, sf_dir, rule: str):
    nodes = _nodes(spark, sf_dir, rule)
    dist = stash(distance.distances(nodes, Matrix.ASYMMETRIC), "dist")
    return nodes, dist, stash(node_weights.harmonic(nodes, dist), "weights")


def shortcuts(spark, sf_dir):
    nodes, dist, w = _asymmetric(spark, sf_dir, "emb_clonal")
    return network.shortcuts(dist, w, nodes.count())


def _symmetric(spark, sf_dir, rule: str):
    nodes = _nodes(spark, sf_dir, rule)
    dist = stash(distance.distances(nodes), "dist")
    edges = mst.spanning_tree(mst.costs(dist, node_weights.eburst(nodes, dist)))
    return nodes, stash(edges, "edges")


def mst_edges(spark, sf_dir):
    edges = _symmetric(spark, sf_dir, "emb_narrow")[1]
    return edges.select("ord", "i", "j", F.round("cost", 6).alias("cost"))


def _linked(spark, sf_dir, rule: str = "emb_narrow", missing: Missing = PAIR):
    nodes, edges = _symmetric(spark, sf_dir, rule)
    return nodes, mst.linked(edges.select("ord", F.col("i").alias("src"), F.col("j").alias("tgt")), nodes, missing)


def _relinked(missing: Missing):
    return lambda spark, sf_dir: _linked(spark, sf_dir, "emb_narrow_miss", missing)[1]


def linked_edges(spark, sf_dir):
    return _linked(spark, sf_dir)[1]


def tree_parents(spark, sf_dir):
    nodes, edges = _linked(spark, sf_dir)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = f.sort_values("ord")[["src", "tgt", "len"]].itertuples(index=False, name=None)
        triples = [(int(a), int(b), int(x)) for a, b, x in rows]
        return pd.DataFrame([(k, *e) for k, e in enumerate(tree.oriented(triples, len(triples) + 1))], columns=["ord", "parent", "child", "len"])

    return edges.groupBy().applyInPandas(run, "ord long, parent long, child long, len long")


def _float_weights(weights: DataFrame) -> np.ndarray:
    return np.array([r["weight"] for r in weights.orderBy("node_id").collect()])


def arborescence(spark, sf_dir):
    """The optimum branching over quantised costs, in its order."""
    nodes = _nodes(spark, sf_dir, "emb_wide")
    make = distance.made(nodes, Matrix.ASYMMETRIC)
    rects = pipelines.matrix_of(nodes, Matrix.ASYMMETRIC, PAIR) if make is None else None
    w = _float_weights(node_weights.harmonic_exact(nodes, rects) if make is None else node_weights.harmonic_made(nodes, make))

    cheap = None if make is None or len(w) < 2 else distance.cheapest_sources(spark, len(w), lambda: network.Quantised(make(), w))

    def run(batches):
        if make is None:
            cost = network.quantised(distance.as_matrix(batches, len(w)), w)
        else:
            cost = network.Quantised(make(), w)
            for _ in batches:
                pass
        edges = branching.ordered_branching(cost, cheap=cheap)
        told = (lambda s, t: float(cost[s, t])) if make is None else cost.cell
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(k, s, t, told(s, t)) for k, (s, t) in enumerate(edges)], columns=["ord", "src", "tgt", "cost"]))

    return (distance.one_task(spark) if make else rects.coalesce(1)).mapInArrow(run, "ord long, src long, tgt long, cost double")


def _network(rule: str, **given):
    def query(spark, sf_dir):
        params = Params.of(**{"heuristic": "harmonic", "matrix": "asymmetric", "method": "MSTree", **given})
        return pipelines.network_edges(_nodes(spark, sf_dir, rule), params)

    return query


def _method(rule: str, **given):
    return lambda spark, sf_dir: pipelines.run(_profile(spark, sf_dir, rule), **given)


def shortcut_edges(spark, sf_dir):
    """The edges of the network that come from shortcuts, with their lengths."""
    nodes, dist, w = _asymmetric(spark, sf_dir, "emb_clonal")
    edges = pipelines.network_edges(nodes, Params.of(heuristic="harmonic", matrix="asymmetric", method="MSTree"), w)
    short = network.shortcuts(dist, w, nodes.count())
    return edges.join(short, ["src", "tgt"], "left_semi").select("src", "tgt", "brlen")


def _leaves(rule: str, **given):
    """The names of a tree's leaves, out of its text."""

    def query(spark, sf_dir):
        text = pipelines.run(_profile(spark, sf_dir, rule), **given)
        return text.select(F.explode(F.regexp_extract_all("newick", F.lit("[(,]([^(),:;]+)[:,);]"), F.lit(1))).alias("name"))

    return query


def margin_report(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "emb_wide")
    if make := distance.made(nodes, Matrix.ASYMMETRIC):
        return _margins_made(spark, nodes, make)
    rects = pipelines.matrix_of(nodes, Matrix.ASYMMETRIC, PAIR)
    w = _float_weights(node_weights.harmonic_exact(nodes, rects))

    def run(batches):
        d = distance.as_matrix(batches, len(w))
        edges = branching.dense_branching(np.floor(d.astype(float) + 0.5) + w[:, None])
        yield pa.RecordBatch.from_pandas(pd.DataFrame(margin.subtree_ranges(edges), columns=["node", "parent", "tin", "tout"]))

    ranges = stash(rects.coalesce(1).mapInArrow(run, "node long, parent long, tin long, tout long"), "ranges")
    return margin.margin_histogram(margin.margins(ranges, distance.distances(nodes, Matrix.ASYMMETRIC).filter("i <> j")))


def _margins_made(spark: SparkSession, nodes: DataFrame, make) -> DataFrame:
    w = _float_weights(node_weights.harmonic_made(nodes, make))
    far = (nodes.select(F.size("codes")).first()[0] + 2.0) * (len(w) + 1) if len(w) else 0.0  # no distance is above the number of loci
    cheap = None if len(w) < 2 else distance.cheapest_sources(spark, len(w), lambda: network.Rounded(make(), w))

    def run(batches):
        edges = branching.round_branching(network.Rounded(make(), w), far, cheap=cheap)
        for _ in batches:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(margin.subtree_ranges(edges), columns=["node", "parent", "tin", "tout"]))

    found = distance.one_task(spark).mapInArrow(run, "node long, parent long, tin long, tout long").collect()  # a row a node of one matrix
    ranges = np.array([tuple(r) for r in found], np.int64).reshape(-1, 4)
    return margin.margin_histogram(margin.margins_made(spark, ranges, len(w), make))


_CASES = [(m, x, p, loci, n) for m in ("MSTree", "NJ", "RapidNJ", "ninja", "distance") for x in ("symmetric", "asymmetric") for p in (1, 5) for loci in (7, 1500) for n in (100, 3000, 60000)]


def check_reports(spark, sf_dir):
    """The check lines of the cases, taken apart again."""
    rows = spark.createDataFrame(_CASES, "method string, matrix string, n_proc long, n_loci long, n_profile long")
    keys = ("method", "matrix", "n_proc", "n_loci", "n_profile")
    back = estimates.check_report(rows, 1e9, *keys).withColumn("r", F.from_json("report", "time double, memory double, affordable boolean"))
    return back.select(*keys, F.round("r.time", 3).alias("time"), F.round("r.memory", 0).alias("memory"), "r.affordable")


def estimate(spark, sf_dir):
    rows = spark.createDataFrame(_CASES, "method string, matrix string, n_proc long, n_loci long, n_profile long")
    return estimates.estimate(rows).select("method", "matrix", "n_proc", "n_loci", "n_profile", F.round("seconds", 3).alias("seconds"), F.round("bytes", 0).alias("bytes"))


QUERIES = {
    f.__name__: f for f in (encode_alleles, complete_delete_columns, dedup_groups, sanitise_names, profile_columns, read_profile_text, phylip_cells, phylip_text, shortcuts, mst_edges, linked_edges, tree_parents, arborescence, margin_report, estimate, read_profile_headers, read_fasta_gzip, weights_harmonic_exact, shortcut_edges, check_reports)
} | {
    "distance_pair_delete": _distance("emb_clonal_miss", Matrix.SYMMETRIC, PAIR),
    "distance_complete_delete": _distance("emb_clonal_miss", Matrix.SYMMETRIC, COMPLETE),
    "distance_as_allele": _distance("emb_clonal_miss", Matrix.SYMMETRIC, ALLELE),
    "distance_absolute": _distance("emb_wide", Matrix.SYMMETRIC, ABSOLUTE),
    "distance_asymmetric": _distance("emb_wide", Matrix.ASYMMETRIC, PAIR),
    "distance_asymmetric_absolute": _distance("emb_clonal_miss", Matrix.ASYMMETRIC, ABSOLUTE),
    "distance_wgmlst": _distance("emb_wide", Matrix.ASYMMETRIC_WGMLST, PAIR, 4),
    "distance_blockwise": _distance("emb_clonal_miss", Matrix.BLOCKWISE, PAIR),
    "weights_harmonic": _weights("emb_clonal_miss", Matrix.ASYMMETRIC, node_weights.harmonic),
    "weights_eburst": _weights("emb_narrow", Matrix.SYMMETRIC, node_weights.eburst),
    "network_edges": _network("emb_clonal"),
    "network_edges_native": _network("emb_clonal", native=True),
    "recraft_edges": _network("emb_clonal", recraft=True),
    "recraft_edges_native": _network("emb_clonal", recraft=True, recraft_mode="native"),
    "mstreev2_newick": _method("emb_clonal_miss", method="MSTreeV2"),
    "mstree_newick": _method("emb_clonal_miss", method="MSTree"),
    "mstree_blockwise_newick": _method("emb_clonal_miss", method="MSTree", matrix="blockwise"),
    "mstreev2_complete_newick": _method("emb_clonal_miss", method="MSTreeV2", missing=1),
    "mstreev2_as_allele_newick": _method("emb_clonal_miss", method="MSTreeV2", missing=2),
    "mstreev2_absolute_newick": _method("emb_clonal_miss", method="MSTreeV2", missing=3),
    "mstreev2_leaves": _leaves("emb_clonal_miss", method="MSTreeV2"),
    "mstree_leaves": _leaves("emb_clonal_miss", method="MSTree"),
    "nj_leaves": _leaves("emb_clonal_miss", method="NJ"),
    "nj_newick": _method("emb_clonal_miss", method="NJ"),
    "rapidnj_newick": _method("emb_clonal_miss", method="RapidNJ"),
    "ninja_newick": _method("emb_clonal_miss", method="ninja"),
    "nj_rooted_newick": lambda spark, sf_dir: pipelines.neighbour_joining(_profile(spark, sf_dir, "emb_clonal_miss"), Params.of(method="NJ"), post_process=True),
    "dropped_rows": lambda spark, sf_dir: _nodes(spark, sf_dir, "emb_gaps").select("node_id", F.array_join("members", ",").alias("members")),
    "linked_complete_delete": _relinked(COMPLETE),
    "linked_as_allele": _relinked(ALLELE),
}


# -- SQL ----------------------------------------------------------------------


def _nodes_sql(rule: str, missing: Missing = PAIR) -> str:
    kept = "WHERE locus IN (SELECT locus FROM enc WHERE code = 0)" if missing is COMPLETE else ""
    return f"""
cells AS ({cells_sql(rule)}),
enc AS (SELECT row_idx, name, locus, CASE WHEN upper(allele) IN ('0', 'N', '-') THEN 0 ELSE dense_rank() OVER (PARTITION BY locus ORDER BY allele) END AS code FROM cells),
rws AS (SELECT row_idx, name, list(code ORDER BY locus) AS codes FROM enc {kept} GROUP BY row_idx, name),
grp AS (SELECT codes, list(name ORDER BY row_idx) AS members FROM rws WHERE list_max(codes) > 0 GROUP BY codes),
nodes AS (SELECT row_number() OVER (ORDER BY list_reverse(codes)) - 1 AS node_id, codes, members FROM grp),
nc AS (SELECT node_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS locus FROM nodes),
loc AS (SELECT locus, count(*) FILTER (code > 0) AS p, count(*) AS n FROM nc GROUP BY locus),
prs AS (SELECT a.node_id AS i, b.node_id AS j, count(*) AS l, count(*) FILTER (a.code > 0 AND b.code > 0) AS both_,
               count(*) FILTER (a.code > 0 AND b.code > 0 AND a.code <> b.code) AS pd, count(*) FILTER (a.code <> b.code) AS neq,
               count(*) FILTER (a.code <> b.code AND p = n) AS held, count(*) FILTER (b.code > 0) AS pb,
               count(*) FILTER (b.code > 0 AND a.code <> b.code) AS gone,
               sum(CASE WHEN a.code = 0 AND b.code > 0 THEN p * (p - 1) / (n * (n - 1)::DOUBLE) ELSE 0 END) AS rare
        FROM nc a JOIN nc b ON a.locus = b.locus AND a.node_id <> b.node_id JOIN loc ON loc.locus = a.locus GROUP BY a.node_id, b.node_id)"""


_D = {
    "pair": "((pd + 0.01::DOUBLE) * l) / (both_ + 0.01::DOUBLE)",
    "complete": "held",
    "allele": "neq",
    "absolute": "pd",
    "asymmetric": "gone * l::DOUBLE / pb",
    "asymmetric_absolute": "gone",
    "wgmlst": "(pd + rare) * l::DOUBLE / pb",
}


def _dist(kind: str) -> str:
    return f"dist AS (SELECT i, j, CAST(CAST({_D[kind]} AS FLOAT) AS DOUBLE) AS d FROM prs)"


def _distance_sql(rule: str, kind: str, missing: Missing = PAIR, digits: int = 6) -> str:
    return f"WITH {_nodes_sql(rule, missing)}, {_dist(kind)} SELECT i, j, round(d, {digits}) AS d FROM dist"


_HARMONIC = """
hm AS (SELECT i AS node_id, round((SELECT count(*) FROM nodes) / (sum(1 / (d + 0.1::DOUBLE)) + 1 / 0.1::DOUBLE), 9) AS h FROM dist GROUP BY i),
wts AS (SELECT node_id, row_number() OVER (ORDER BY h, len(members) DESC, node_id) - 1 AS rank, (row_number() OVER (ORDER BY h, len(members) DESC, node_id) - 1) / count(*) OVER ()::DOUBLE AS weight
        FROM hm JOIN nodes USING (node_id))"""

_EBURST = """
whole AS (SELECT i AS node_id, CAST(trunc(d) AS INTEGER) AS d, count(*) AS c FROM dist GROUP BY ALL UNION ALL SELECT node_id, 0, 1 + len(members) FROM nodes),
cnt AS (SELECT node_id, d, sum(c) AS c FROM whole GROUP BY ALL),
kys AS (SELECT n.node_id, list(-coalesce(c.c, 0) ORDER BY CASE WHEN k = 0 THEN 1000000 ELSE k END) AS ky
        FROM nodes n CROSS JOIN (SELECT unnest(range(0, (SELECT max(d) + 1 FROM cnt))) AS k) LEFT JOIN cnt c ON c.node_id = n.node_id AND c.d = k GROUP BY n.node_id),
wts AS (SELECT node_id, row_number() OVER (ORDER BY ky, node_id) - 1 AS rank, (row_number() OVER (ORDER BY ky, node_id) - 1) / count(*) OVER ()::DOUBLE AS weight FROM kys)"""

_WEIGHTS = "SELECT node_id, CAST(rank AS BIGINT) AS rank, round(weight, 9) AS weight FROM wts"

_PRIM = """
cst AS (SELECT i, j, round(d) + least(a.weight, b.weight) AS cost FROM dist JOIN wts a ON a.node_id = i JOIN wts b ON b.node_id = j WHERE i < j),
edg AS MATERIALIZED (SELECT i, j, cost, row_number() OVER (ORDER BY cost, i, j) AS r FROM cst WHERE cost <> 0),
prim AS (SELECT [0::BIGINT] AS held, NULL::BIGINT AS r
         UNION ALL
         SELECT list_append(held, CASE WHEN list_contains(held, e.i) THEN e.j ELSE e.i END), e.r
         FROM (SELECT held, (SELECT min(edg.r) FROM edg WHERE list_contains(held, edg.i) <> list_contains(held, edg.j)) AS m FROM prim) p JOIN edg e ON e.r = p.m),
tre AS (SELECT i, j, cost, row_number() OVER (ORDER BY i, cost, j) - 1 AS ord FROM edg WHERE r IN (SELECT r FROM prim)),
lnk AS (SELECT ord, t.i AS src, t.j AS tgt, pd AS len FROM tre t JOIN prs p ON p.i = t.i AND p.j = t.j)"""


def _tree_sql(tail: str, rule: str = "emb_narrow", length: str = "pd") -> str:
    head = f"WITH RECURSIVE {_nodes_sql(rule)}, {_dist('pair')}, {_EBURST}, {_PRIM.replace('pd AS len', f'{length} AS len')}"
    return f"{head} {tail}"


_PARENTS = """,
lst AS (SELECT src, tgt, len, row_number() OVER (ORDER BY len DESC, ord) AS pos FROM lnk),
both_ways AS (SELECT src AS a, tgt AS b, len, pos FROM lst UNION ALL SELECT tgt, src, len, pos FROM lst),
down AS (SELECT NULL::BIGINT AS parent, src AS child, NULL::BIGINT AS len, 0 AS pass, 0::BIGINT AS pos FROM lst WHERE pos = 1
         UNION ALL SELECT w.a, w.b, w.len, d.pass + CASE WHEN w.pos < d.pos THEN 1 ELSE 0 END, w.pos
         FROM down d JOIN both_ways w ON w.a = d.child WHERE d.parent IS NULL OR w.b <> d.parent)
SELECT row_number() OVER (ORDER BY pass, pos) - 1 AS ord, parent, child, CAST(len AS BIGINT) AS len FROM down WHERE parent IS NOT NULL"""

_SHORT = """,
ky AS (SELECT i, j, CAST(CAST(d + CAST(a.weight AS FLOAT)::DOUBLE AS FLOAT) AS DOUBLE) AS k, trunc(d + a.weight) AS brlen FROM dist JOIN wts a ON a.node_id = i JOIN wts b ON b.node_id = j
       WHERE a.weight < b.weight AND d < 1 + (SELECT CASE WHEN count(*) < 3000 THEN 2 WHEN count(*) < 10000 THEN 5 WHEN count(*) < 30000 THEN 10 ELSE 20 END FROM nodes))
SELECT i AS src, j AS tgt{brlen} FROM ky QUALIFY row_number() OVER (PARTITION BY j ORDER BY k, i) = 1"""

_UNSAFE_SQL = UNSAFE.replace("'", "''")
_CASES_SQL = ", ".join(f"('{m}', '{x}', {p}, {loci}, {n})" for m, x, p, loci, n in _CASES)
_ASYM, _OTHER, _CUBE = estimates.ASYMMETRIC, estimates.OTHERS, estimates.CUBIC

_ESTIMATE = f"""WITH c AS (SELECT method, matrix, CAST(p AS BIGINT) AS n_proc, CAST(l AS BIGINT) AS n_loci, CAST(n AS BIGINT) AS n_profile FROM (VALUES {_CASES_SQL}) t(method, matrix, p, l, n)),
x AS (SELECT *, n_profile::DOUBLE AS q, n_loci::DOUBLE AS l, n_proc::DOUBLE AS p, method IN ('MSTree', 'RapidNJ', 'ninja') AS known FROM c),
y AS (SELECT method, matrix, n_proc, n_loci, n_profile,
  round(greatest(5.0::DOUBLE, CASE WHEN known AND matrix = 'asymmetric' THEN {_ASYM[0][0]!r}::DOUBLE * q * q + {_ASYM[0][1]}::DOUBLE + {_ASYM[0][2]!r}::DOUBLE * l * q * q / p
     WHEN known THEN {_OTHER[0][0]!r}::DOUBLE * q * q + {_OTHER[0][1]}::DOUBLE + {_OTHER[0][2]!r}::DOUBLE * l * q * q / p
     WHEN method = 'NJ' THEN {_CUBE[0]!r}::DOUBLE * q * q * q ELSE 5.0 END), 3) AS seconds,
  round(greatest({estimates.LEAST_BYTES}::DOUBLE, CASE WHEN known AND matrix = 'asymmetric' THEN {_ASYM[1][0]}::DOUBLE * q * q + {_ASYM[1][1]}::DOUBLE
     WHEN known THEN {_OTHER[1][0]}::DOUBLE * q * q + {_OTHER[1][1]}::DOUBLE
     WHEN method = 'NJ' THEN greatest({_CUBE[1]}::DOUBLE * q * q * q, {_CUBE[2]}::DOUBLE * q - {_CUBE[3]}::DOUBLE) ELSE 0 END), 0) AS bytes FROM x)"""

ORACLE_SQL = {
    "encode_alleles": f"WITH {_nodes_sql('emb_clonal_miss')} SELECT row_idx, CAST(locus AS INTEGER) AS locus, CAST(code AS BIGINT) AS code FROM enc",
    "complete_delete_columns": f"WITH {_nodes_sql('emb_clonal_miss')} SELECT CAST(locus AS BIGINT) AS locus FROM enc GROUP BY locus HAVING min(code) = 0",
    "dedup_groups": f"WITH {_nodes_sql('emb_narrow')} SELECT node_id, members[1] AS name, array_to_string(members, ',') AS members, len(members) AS n_str FROM nodes",
    "sanitise_names": f"""SELECT c_custkey, translate(c_name || ' (''' || c_mktsegment || ''', "x");', '{_UNSAFE_SQL}', '{'_' * len(UNSAFE)}') AS name FROM customer""",
    "profile_columns": "SELECT col, i > 0 AND NOT starts_with(col, '#') AND lower(col) NOT IN ('st', 'st_id') AS is_locus FROM (VALUES "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_HEADER))
    + ") t(i, col)",
    "read_profile_text": f"SELECT name, string_agg(allele, ',' ORDER BY locus) AS alleles FROM ({cells_sql('emb_clonal_miss')}) GROUP BY row_idx, name",
    "distance_pair_delete": _distance_sql("emb_clonal_miss", "pair"),
    "distance_complete_delete": _distance_sql("emb_clonal_miss", "complete", COMPLETE),
    "distance_as_allele": _distance_sql("emb_clonal_miss", "allele"),
    "distance_absolute": _distance_sql("emb_wide", "absolute"),
    "distance_asymmetric": _distance_sql("emb_wide", "asymmetric"),
    "distance_asymmetric_absolute": _distance_sql("emb_clonal_miss", "asymmetric_absolute"),
    "distance_wgmlst": _distance_sql("emb_wide", "wgmlst", digits=4),
    "distance_blockwise": f"""WITH {_nodes_sql("emb_clonal_miss")},
dlt AS (SELECT a.node_id AS i, b.node_id AS j, a.locus, a.code - b.code AS c FROM nc a JOIN nc b ON a.locus = b.locus AND a.node_id <> b.node_id),
lgd AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY i, j ORDER BY locus) AS before FROM dlt)
SELECT i, j, count(*) FILTER (c <> 0 AND c <> before) + (count(*) FILTER (c <> 0) - count(*) FILTER (c <> 0 AND c <> before)) * 0.5::DOUBLE AS d FROM lgd GROUP BY i, j""",
    "phylip_cells": f"""WITH {_nodes_sql("emb_narrow")}, {_dist("pair")},
mem AS (SELECT node_id, unnest(members) AS name FROM nodes),
alld AS (SELECT * FROM dist UNION ALL SELECT node_id, node_id, 0 FROM nodes)
SELECT i AS row_node, a.name AS row_name, j AS col_node, b.name AS col_name, round(CAST(CAST(d / 6.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS cell FROM alld JOIN mem a ON a.node_id = i JOIN mem b ON b.node_id = j""",
    "weights_harmonic": f"WITH {_nodes_sql('emb_clonal_miss')}, {_dist('asymmetric')}, {_HARMONIC} {_WEIGHTS}",
    "weights_eburst": f"WITH {_nodes_sql('emb_narrow')}, {_dist('pair')}, {_EBURST} {_WEIGHTS}",
    "shortcuts": f"WITH {_nodes_sql('emb_clonal')}, {_dist('asymmetric')}, {_HARMONIC} {_SHORT.format(brlen='')}",
    "shortcut_edges": f"WITH {_nodes_sql('emb_clonal')}, {_dist('asymmetric')}, {_HARMONIC} {_SHORT.format(brlen=', brlen')}",
    "dropped_rows": f"WITH {_nodes_sql('emb_gaps')} SELECT node_id, array_to_string(members, ',') AS members FROM nodes",
    "linked_complete_delete": _tree_sql("SELECT ord, src, tgt, CAST(len AS BIGINT) AS len FROM lnk", "emb_narrow_miss", "held"),
    "linked_as_allele": _tree_sql("SELECT ord, src, tgt, CAST(len AS BIGINT) AS len FROM lnk", "emb_narrow_miss", "neq"),
    "read_profile_headers": f"SELECT name || '___a___' AS name, string_agg('X' || allele, ',' ORDER BY locus) AS alleles FROM ({cells_sql('emb_narrow')}) GROUP BY row_idx, name",
    "read_fasta_gzip": f"SELECT name, string_agg(substr('ACGT', CAST(allele AS INTEGER) % 4 + 1, 1), '' ORDER BY locus) AS sequence FROM ({cells_sql('emb_clonal')}) GROUP BY row_idx, name",
    "phylip_text": f"""WITH {_nodes_sql("emb_clonal")}, {_dist("pair")},
mem AS (SELECT node_id, unnest(members) AS name FROM nodes),
alld AS (SELECT * FROM dist UNION ALL SELECT node_id, node_id, 0 FROM nodes)
SELECT i AS row_node, a.name AS row_name, rpad(a.name, CAST(greatest(10, length(a.name)) AS INTEGER), ' ') || ' ' || string_agg(printf('%.6f', CAST(CAST(d / 64.0::DOUBLE AS FLOAT) AS DOUBLE)), ' ' ORDER BY j, b.name) AS line
FROM alld JOIN mem a ON a.node_id = i JOIN mem b ON b.node_id = j GROUP BY i, a.name UNION ALL SELECT -1, '', '    ' || count(*) FROM mem""",
    **{f"{m}_leaves": f"WITH {_nodes_sql('emb_clonal_miss')} SELECT unnest(members) AS name FROM nodes" for m in ("mstreev2", "mstree", "nj")},
    "mst_edges": _tree_sql("SELECT ord, i, j, round(cost, 6) AS cost FROM tre"),
    "linked_edges": _tree_sql("SELECT ord, src, tgt, CAST(len AS BIGINT) AS len FROM lnk"),
    "tree_parents": _tree_sql(_PARENTS),
    "estimate": f"{_ESTIMATE} SELECT method, matrix, n_proc, n_loci, n_profile, seconds, bytes FROM y",
    "check_reports": f"{_ESTIMATE} SELECT method, matrix, n_proc, n_loci, n_profile, seconds AS time, bytes AS memory, bytes < 1e9 AS affordable FROM y",
}
