"""Time and memory that the classic single-machine methods are expected to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed coefficients: (p squared, constant, loci x p squared / processes) of seconds, (p squared, constant) of bytes.
ASYMMETRIC = ((2.431284e-6, 33.753, 2.701426667e-9), (103.77, 516_625_000.0))
OTHERS = ((2.272428e-6, 32.625, 2.52492e-9), (66.297, 429_570_000.0))
CUBIC = (1.1042e-8, 0.058292, 1.39e6, 9.86e8)
LEAST_SECONDS, LEAST_BYTES = 5.0, 50.0 * 1024 * 1024
QUADRATIC_METHODS = ("MSTree", "RapidNJ", "ninja")


def estimate(rows: DataFrame) -> DataFrame:
    """``rows`` (method, matrix, n_proc, n_loci, n_profile) with seconds and bytes."""
    p, loci, procs = (F.col(c).cast("double") for c in ("n_profile", "n_loci", "n_proc"))

    def quadratic(k) -> tuple[Column, Column]:
        (a, b, c), (d, e) = k
        return F.lit(a) * p * p + F.lit(b) + F.lit(c) * loci * p * p / procs, F.lit(d) * p * p + F.lit(e)

    asym, others = quadratic(ASYMMETRIC), quadratic(OTHERS)
    cube = (F.lit(CUBIC[0]) * p * p * p, F.greatest(F.lit(CUBIC[1]) * p * p * p, F.lit(CUBIC[2]) * p - F.lit(CUBIC[3])))
    known = F.col("method").isin(*QUADRATIC_METHODS)

    def pick(k: int, least: float) -> Column:
        chosen = F.when(known & (F.col("matrix") == "asymmetric"), asym[k]).when(known, others[k]).when(F.col("method") == "NJ", cube[k])
        return F.greatest(F.coalesce(chosen, F.lit(least)), F.lit(least))

    return rows.withColumn("seconds", pick(0, LEAST_SECONDS)).withColumn("bytes", pick(1, LEAST_BYTES))


def check_report(rows: DataFrame, available_bytes: float, *kept: str) -> DataFrame:
    """One JSON line a row: time, memory and whether the memory is there; after the
    columns ``kept``."""
    out = estimate(rows)
    fits = F.col("bytes") < F.lit(float(available_bytes))
    return out.select(*kept, F.to_json(F.struct(F.col("seconds").alias("time"), F.col("bytes").alias("memory"), fits.alias("affordable"))).alias("report"))
