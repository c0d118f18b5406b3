"""Shared working folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one becomes it on a single machine, and it is an error on a cluster."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmere-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the plan below is run once and lost tasks re-read files."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df; nothing may read it any more."""
    if path := getattr(df, "_scratch_path", None):
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, in whatever store it lives."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; for file scans the size of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of all files that df reads, whatever joins stand between; None where a source doesn't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return size if size < 1 << 50 else None


def parts_for(df: DataFrame, mb_each: float, least: int = 8) -> int:
    """How many partitions hold df at about mb_each MB of input files each."""
    size = input_bytes(df)
    if size > 1 << 55:  # no estimate (a local relation of unknown size)
        return least
    return max(least, int(size / (mb_each * 1e6)) + 1)
