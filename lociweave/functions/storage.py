"""Stage results in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of one side of a join that is broadcast by a hint.
BROADCAST_BYTES = 64 << 20

_local: dict[str, str] = {}
_used: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        kept = tempfile.TemporaryDirectory(prefix="lociweave-", ignore_cleanup_errors=True)
        atexit.register(kept.cleanup)
        _local[app] = f"file://{kept.name}"
    return _local[app]


def stage_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it goes when Python ends."""
    folder = f"{shared_folder(spark)}/lociweave/{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has staged.  Frames that read it can't be used any more."""
    folder = stage_folder(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped, and can't delete any more
        try:
            clear_stages(spark)
        except Exception as e:  # the JVM may have gone first; the files are then left to whoever owns the folder
            print(f"stage files in {folder} were not deleted: {type(e).__name__}")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    gives every later reader the same rows, whichever executors are lost."""
    path = f"{stage_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
