"""Profile tables and aligned FASTA as (row_idx, name, alleles).

Lines are numbered in file order.  A text file is read by Spark (``.gz`` files
are unpacked by it); a single-line header is the only thing seen on the driver.
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alleles import is_locus, safe_name

_BLANK = r"^[\s]+|[\s]+$"


def numbered_lines(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """(line_no, value) of a file or of inline text, in order.

    One text or path must be given; a path that doesn't exist is an error.  Empty
    lines are left out, whatever the line ends.
    """
    if (path is None) == (text is None):
        raise ValueError("give a path or a text")
    if text is None and path.lower().endswith(".gz") and not path.endswith(".gz"):
        raw = spark.read.format("binaryFile").load(path).select("content").first()  # an odd suffix that Spark doesn't unpack
        text = gzip.decompress(bytes(raw[0])).decode()
    if text is not None:
        lines = spark.createDataFrame([(text,)], "text string").select(F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    else:  # one file is read in order, and the numbers of later partitions are higher
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return lines.select(F.col("line_no").cast("long"), F.regexp_replace("value", "\r$", "").alias("value")).filter(F.length(F.regexp_replace("value", _BLANK, "")) > 0)


def read_header(lines: DataFrame) -> tuple[list[str], int, bool]:
    """(columns, number of the first data line, whether the file is FASTA).

    Leading lines that start with ``#`` but not ``##`` are headers and the last one
    counts; without one the first line is the header.  Only comment lines: all of
    them are data under the first.
    """
    first = lines.filter(~F.col("value").startswith("#")).orderBy("line_no").first()
    lead = lines if first is None else lines.filter(F.col("line_no") < first["line_no"])
    named = lead.filter(~F.col("value").startswith("##")).orderBy(F.desc("line_no")).first()
    if first is None:
        return (named["value"].strip().split("\t") if named else []), 0, False
    if first["value"].startswith(">"):
        return [], first["line_no"], True
    if named is None:
        return first["value"].strip().split("\t"), first["line_no"] + 1, False
    return named["value"].strip().split("\t"), first["line_no"], False


def read_profile(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """(row_idx, name, alleles) of a tab-separated profile or aligned FASTA.

    Columns that aren't loci are left out; alleles are upper case; cells missing
    at a line's end are empty strings (an allele like any other); rows without a
    name are skipped; unsafe characters of names become underscores.
    """
    lines = numbered_lines(spark, path, text)
    columns, start, fasta = read_header(lines)
    body = lines.filter(F.col("line_no") >= start)
    if fasta:
        return _fasta(body)
    kept = [i for i, c in enumerate(columns) if i and is_locus(c)]
    parts = F.split(F.regexp_replace("value", _BLANK, ""), "\t")
    alleles = F.array(*[F.upper(F.coalesce(F.get(F.col("p"), i), F.lit(""))) for i in kept]) if kept else F.array().cast("array<string>")
    rows = body.select("line_no", parts.alias("p")).filter(F.get(F.col("p"), 0) != "")
    return rows.select(F.col("line_no").alias("row_idx"), safe_name(F.get(F.col("p"), 0)).alias("name"), alleles.alias("alleles"))


def _fasta(body: DataFrame) -> DataFrame:
    """Each character of a record's joined lines is a locus."""
    # each part of a file is numbered on its own; what a part's first lines belong to is the last record before it
    part = F.shiftright("line_no", 33)
    head = F.when(F.col("value").startswith(">"), F.col("line_no"))
    lines = body.filter(~F.col("value").startswith("#")).withColumn("part", part)
    own = F.last(head, ignorenulls=True).over(Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    ends = lines.groupBy("part").agg(F.max(head).alias("end"))
    before = ends.select("part", F.max("end").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row a part
    marked = lines.withColumn("own", own).join(F.broadcast(before), "part").withColumn("rec", F.coalesce("own", "before"))
    heads = marked.filter(F.col("value").startswith(">")).select("rec", F.element_at(F.split(F.expr("ltrim(substring(value, 2))"), r"\s+"), 1).alias("name"))
    seqs = marked.filter(~F.col("value").startswith(">")).groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda s: s["value"]), "").alias("seq"))
    alleles = F.when(F.coalesce(F.col("seq"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.upper(F.regexp_replace("seq", r"\s", "")), ""))
    out = heads.join(seqs, "rec", "left").select(F.col("rec").alias("row_idx"), safe_name(F.col("name")).alias("name"), alleles.alias("alleles"))
    return out.withColumn("alleles", F.filter("alleles", lambda a: a != ""))


def check_rectangular(profile: DataFrame) -> DataFrame:
    """``profile``; rows with different numbers of alleles raise ValueError."""
    widths = [r[0] for r in profile.select(F.size("alleles").alias("n")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"rows have different numbers of loci: {sorted(widths)}")
    return profile
