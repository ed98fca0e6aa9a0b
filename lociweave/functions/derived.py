"""Profiles derived from embedding vectors, for queries over whole tables: every row
of the table, and as many of its dimensions as the rule names (64 or the first 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = "CASE WHEN (vec_id * 31 + k * 17) % 11 = 0 THEN '0' ELSE cast(cast(floor(x * 8) AS int) + 10 AS string) END"
NARROW = "cast(cast(floor(x * 4) AS int) + 10 AS string)"
CLONAL = "CASE WHEN abs(x) > 0.3125 THEN cast(6 + vec_id % 9 AS string) ELSE cast((label * 7 + k) % 5 + 1 AS string) END"
CLONAL_MISS = f"CASE WHEN (vec_id * 31 + k * 17) % 37 = 0 THEN '0' ELSE {CLONAL} END"
NARROW_MISS = f"CASE WHEN (vec_id * 31 + k * 17) % 11 = 0 THEN '0' ELSE {NARROW} END"
GAPS = f"CASE WHEN vec_id % 5 = 0 AND k % 2 = 0 THEN 'n' WHEN vec_id % 5 = 0 THEN '-' ELSE {NARROW} END"
RULES = {"emb_narrow_miss": (NARROW_MISS, 6), "emb_gaps": (GAPS, 6), "emb_wide": (WIDE, 64), "emb_narrow": (NARROW, 6), "emb_clonal": (CLONAL, 64), "emb_clonal_miss": (CLONAL_MISS, 64)}


def derived_profile(embeddings: DataFrame, rule: str) -> DataFrame:
    """(row_idx, name, alleles) of every vector: one locus a dimension."""
    expr, loci = RULES[rule]
    alleles = f"transform(slice(embedding, 1, {loci}), (x, k) -> {expr})"
    return embeddings.select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.expr(alleles).alias("alleles"))


def cells_sql(rule: str) -> str:
    """DuckDB SQL: row_idx, name, locus, allele of the same profile."""
    expr, loci = RULES[rule]
    expr = expr.replace("string", "VARCHAR").replace("AS int)", "AS INTEGER)")
    return (
        f"SELECT vec_id AS row_idx, 'v' || vec_id AS name, k AS locus, {expr} AS allele FROM (SELECT vec_id, label, unnest(embedding[1:{loci}]) AS x,"
        f" generate_subscripts(embedding[1:{loci}], 1) - 1 AS k FROM embeddings)"
    )
