"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, stash

__all__ = ["BROADCAST_ROWS", "LOWER", "SPACES", "UPPER", "BitFilter", "fresh", "looked_up", "row_key", "shared_folder", "shuffle_width", "small_batches", "stash", "table", "whole_text"]

#: Whitespace of the text contracts: space and the controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most rows that any operator here broadcasts or ships inside a plan; an element of an array counts as a row.
BROADCAST_ROWS = 300_000
#: Bytes of a batch of rows on its way to Python, and the setting that bounds them.
BATCH_BYTES = 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def whole_text(name: str = "text"):
    """A text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES or one row, unless the
    session names another size.  By Spark's own size a batch is all the texts of a
    partition, and the executor, its channel and the worker each hold copies of it."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` hasn't, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key() -> Column:
    """A hash of the text, which tells rows that share a doc_id apart."""
    return F.xxhash64(whole_text())


class BitFilter:
    """A set of 64-bit hashes as a blocked Bloom filter: three bits a hash in one of
    ``words`` longs, a table of (word, bits) that is broadcast.  It grows with the set up
    to WORDS rows (16 MB); a set beyond that is answered less sharply, but none of its
    hashes is ever missed."""

    WORDS = 1 << 20

    def __init__(self, hashes: DataFrame, name: str, count: int):
        self.words = 1 << 10
        while self.words < self.WORDS and self.words * 64 < 16 * count:
            self.words *= 2
        marks = hashes.select(self._word(F.col(name)).alias("word"), self._mask(F.col(name)).alias("mask"))
        self._table = marks.groupBy("word").agg(F.bit_or("mask").alias("bits"))

    def _word(self, h: Column) -> Column:
        return h.bitwiseAND(F.lit(self.words - 1).cast("long"))

    @staticmethod
    def _mask(h: Column) -> Column:
        one = F.lit(1).cast("long")
        bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63).cast("long")).cast("int")) for at in (58, 50, 42)]
        return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    def told(self, df: DataFrame, h: Column, name: str) -> DataFrame:
        """``df`` with a column ``name``: whether the hash ``h`` may be in the set."""
        word, bits, probe = fresh(df, "word", "bits", "probe")
        joined = df.withColumn(probe, h).join(F.broadcast(self._table.toDF(word, bits)), self._word(F.col(probe)) == F.col(word), "left")
        may = F.coalesce(F.col(bits).bitwiseAND(self._mask(F.col(probe))) == self._mask(F.col(probe)), F.lit(False))
        return joined.withColumn(name, may).drop(word, bits, probe)


def looked_up(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``side`` (doc_id, key, ... as ``left_anti``, ``left`` or ``inner``) by doc_id and
    row_key(), without a shuffle of the texts that have no partner there.

    ``side`` must be written already: its rows are counted, and a BitFilter of their
    keys says which rows of ``docs`` travel.  It grows with the table, so it is never
    broadcast itself.  The columns of ``side`` but its first two are added.
    """
    id_, key, *_ = side.columns
    own, may = fresh(docs, "own_key", "may")
    told = BitFilter(side, key, side.count()).told(docs.withColumn(own, row_key()), F.col(own), may)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key))
    drop = [own] if how == "left_anti" else [own, id_, key]
    found = told.filter(F.col(may)).drop(may).join(side.hint("merge"), same, how).drop(*drop)
    if how == "inner":
        return found
    return found.unionByName(told.filter(~F.col(may)).drop(may, own), allowMissingColumns=True)
