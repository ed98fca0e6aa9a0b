"""From alleles to ordinal codes, and from rows to nodes of equal rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.alleles import is_missing
from ..functions.storage import stash
from ..plans.params import Missing

#: Most distinct alleles of all loci, and most cells of a table (locus, allele) of ranks, that are sent to every task.
RANKED_ALLELES = 300_000
RANKED_CELLS = 1 << 24


def allele_ranks(profile: DataFrame) -> DataFrame:
    """(locus, allele, code): the rank of an allele among the distinct alleles of its
    locus by byte order, from 1; missing tokens take a rank and then get code 0, as
    has a null allele."""
    ranked = profile.select(F.posexplode("alleles").alias("locus", "allele")).filter("allele is not null").distinct()
    ranked = ranked.withColumn("code", F.dense_rank().over(Window.partitionBy("locus").orderBy("allele")))
    return ranked.withColumn("code", F.when(is_missing(F.col("allele")), F.lit(0)).otherwise(F.col("code")))


def _coded(profile: DataFrame) -> DataFrame:
    """(row_idx, name, codes).  Alleles are replaced in their arrays where the ranks
    are few (counted); else cells are joined with their ranks."""
    ranks = stash(allele_ranks(profile), "ranks")
    alleles, n = ranks.agg(F.count_distinct("allele"), F.count("*")).first()
    width = profile.agg(F.coalesce(F.max(F.size("alleles")), F.lit(0))).first()[0]
    if n > RANKED_ALLELES or width * (alleles + 1) > RANKED_CELLS:
        cells = profile.select("row_idx", "name", F.posexplode("alleles").alias("locus", "allele")).join(ranks, ["locus", "allele"], "left")
        codes = F.transform(F.array_sort(F.collect_list(F.struct("locus", F.coalesce("code", F.lit(0)).alias("code")))), lambda c: c["code"])
        return cells.groupBy("row_idx", "name").agg(codes.alias("codes"))
    held = ranks.collect()  # RANKED_ALLELES rows at most
    known = pa.array(sorted({r["allele"] for r in held}), pa.string())
    place = {a: k for k, a in enumerate(known.to_pylist())}
    table = np.zeros((width, alleles + 1), np.int32)  # the last column is that of null
    for r in held:
        table[r["locus"], place[r["allele"]]] = r["code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            cells = rows.column(2)
            starts = cells.offsets.to_numpy()
            at = np.arange(starts[-1] - starts[0]) - np.repeat(starts[:-1] - starts[0], np.diff(starts))
            told = pc.fill_null(pc.index_in(cells.flatten(), value_set=known), alleles).to_numpy(zero_copy_only=False)
            codes = pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(table[at, told]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), codes], ["row_idx", "name", "codes"])

    kept = profile.select("row_idx", "name", "alleles").filter(F.size("alleles") > 0)
    schema = T.StructType([kept.schema["row_idx"], kept.schema["name"], T.StructField("codes", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(run, schema)


def encode_cells(profile: DataFrame) -> DataFrame:
    """(row_idx, name, locus, code) of every cell; see allele_ranks()."""
    return _coded(profile).select("row_idx", "name", F.posexplode("codes").alias("locus", "code"))


def incomplete_loci(cells: DataFrame) -> DataFrame:
    """Loci with at least one missing value, which is what complete deletion keeps."""
    return cells.groupBy("locus").agg(F.max((F.col("code") == 0).cast("int")).alias("gap")).filter("gap = 1").select("locus")


def encoded_rows(profile: DataFrame, missing: Missing = Missing.PAIR_DELETE) -> DataFrame:
    """(row_idx, name, codes) of the loci that ``missing`` keeps."""
    rows = _coded(profile)
    if missing is not Missing.COMPLETE_DELETE:
        return rows
    rows = stash(rows, "coded")
    kept = sorted(r[0] for r in incomplete_loci(rows.select(F.posexplode("codes").alias("locus", "code"))).collect())  # a number a locus
    chosen = F.transform(F.lit(kept).cast("array<int>"), lambda k: F.get("codes", k))
    return rows.withColumn("codes", chosen).filter(F.size("codes") > 0)


def ordered_ids(df: DataFrame, order, id_name: str) -> DataFrame:
    """``df`` with gapless ids by ``order``: a range sort, whose partitions are
    numbered on their own and shifted by the counts before them."""
    placed = stash(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_p")).count()
    before = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))  # a row a partition
    out = placed.withColumn("_p", part).join(F.broadcast(before), "_p")
    return out.withColumn(id_name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_p", "_at", "_before")


def collapse(rows: DataFrame) -> DataFrame:
    """Nodes (node_id, name, codes, members, n_str) of equal rows.

    Rows without any allele go.  Nodes are numbered from 0 by their codes, the
    last locus first; the first member in input order gives the name.
    """
    kept = rows.filter(F.exists("codes", lambda c: c > 0))
    groups = kept.groupBy("codes").agg(F.array_sort(F.collect_list(F.struct("row_idx", "name"))).alias("m"))
    nodes = groups.select("codes", F.transform("m", lambda m: m["name"]).alias("members"))
    nodes = ordered_ids(nodes, F.reverse("codes"), "node_id")
    return nodes.select("node_id", F.element_at("members", 1).alias("name"), "codes", "members", F.size("members").alias("n_str"))


def nodes_of(profile: DataFrame, missing: Missing = Missing.PAIR_DELETE) -> DataFrame:
    """Encode, filter loci, drop empty rows, and collapse; written once, as later
    stages read it several times."""
    return stash(collapse(encoded_rows(profile, missing)), "nodes")
