"""Written intermediate tables.

A result that several branches of a plan read is written once as Parquet into
the folder that ``spark.checkpoint.dir`` names (shared by all executors), so a
lost executor costs nothing and the Python work isn't repeated.  Where that
setting is absent a temporary folder is used in local mode only; on a cluster
it would be another folder on every machine, so there it is an error.

Everything written is marked for deletion when the session's JVM ends.
``release`` deletes it at once, when no result that reads it is needed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is set and the session is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='docsieve-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docsieve-{spark.sparkContext.applicationId}"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, root = _filesystem(spark, _root(spark))
    fs.deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete what this session has settled; whether there was anything."""
    fs, root = _filesystem(spark, _root(spark))
    return bool(fs.delete(root, True))
