"""Cutting lineage and choosing join sides by measured size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long key that may be broadcast: 2 million, or about 32 MB of hash relation.
BROADCAST_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, which the session names. Only on one machine, as in tests, may it be unset; a local
    folder is taken there, while a cluster without the setting is refused, since each executor would write to its own disk."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "curatrix-checkpoints")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back, so that later stages survive lost executors
    without running the earlier ones again, and no stage runs twice for two consumers. A result is read from its stages
    until it is consumed, so the tables are removed when the session's file system is closed, at the end of the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/curatrix/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def temporary_path(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet in a new folder of the shared one, which is removed at the end of the application."""
    base = f"{shared_folder(spark)}/curatrix/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{base}/data"


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its counted rows are within ``limit``; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def keep_keys(df: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join against a table of distinct keys, broadcast only when the count of keys is checked to be small."""
    return df.join(small_side(keys, keys.count()), column, how)
