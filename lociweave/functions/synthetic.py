"""Seeded synthetic profiles: clones of a few founders with mutations, gaps and
copies.  Every cell is a function of the seed and its place, so the rows don't
depend on how the work is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(*key) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def synthetic_profile(
    spark: SparkSession, samples: int, loci: int, founders: int = 3, mutation: float = 0.05, missing: float = 0.0, duplicates: float = 0.0, alleles: int = 40, letters: str | None = None, marker: str = "0", seed: int = 0
) -> DataFrame:
    """(row_idx, name, alleles) of ``samples`` rows and a share of copies of the
    first of them.  Alleles are numbers, or ``letters`` where given."""
    size = len(letters) if letters else alleles
    rows = spark.range(samples + int(samples * duplicates)).select(F.col("id").alias("row_idx"), F.pmod("id", F.lit(samples)).alias("s"))
    rows = rows.withColumn("founder", F.floor(_uniform(F.lit(seed), F.lit("founder"), "s") * founders))

    def drawn(*key) -> Column:
        k = F.floor(_uniform(F.lit(seed), *key) * size).cast("int")
        return F.substring(F.lit(letters), k + 1, F.lit(1)) if letters else (k + 1).cast("string")

    def cell(k: Column) -> Column:
        own = F.when(_uniform(F.lit(seed), F.lit("mutates"), "s", k) < mutation, drawn(F.lit("own"), "s", k)).otherwise(drawn(F.lit("base"), "founder", k))
        return F.when(_uniform(F.lit(seed), F.lit("gap"), "s", k) < missing, F.lit(marker)).otherwise(own)

    name = F.concat(F.lit("s"), F.col("row_idx"))
    return rows.select("row_idx", name.alias("name"), F.transform(F.sequence(F.lit(0), F.lit(loci - 1)), cell).alias("alleles"))
