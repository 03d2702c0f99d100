"""Reading tables and places for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a directory)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; only a local session may do without and gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "postmill-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    The files lie in the folder all executors share, so a lost executor costs no recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the shared checkpoint folder and read it back.

    Smaller than checkpoint() for wide rows, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_spilled: list[str] = []


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Let the file system delete a written table when the session's JVM ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _spilled.append(path)


def clear_spills(spark: SparkSession) -> int:
    """Delete the tables written by spill() so far, once no result that reads them is needed; returns their number."""
    jvm, n = spark.sparkContext._jvm, 0
    while _spilled:
        where = jvm.org.apache.hadoop.fs.Path(_spilled.pop())
        n += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n
