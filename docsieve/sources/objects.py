"""Object store over a folder: keyed binary content in buckets of a table.

``put`` rewrites only the buckets that the new keys fall into; ``get`` and
``stat`` read only theirs.

Defined results: of equal keys in one call the largest content by order wins;
absent keys give no row; removing what isn't there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
SCHEMA = "key string, content binary, media_type string, size bigint, sha256 string, bucket int"


def _bucket():
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SCHEMA).parquet(root) if there else spark.createDataFrame([], SCHEMA)


def _write(rows: DataFrame, root: str) -> None:
    from docsieve.sources.settle import settle

    ready = settle(rows, "objects")  # what is read from the buckets must be written before they are replaced
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)


def put(rows: DataFrame, root: str) -> None:
    """Store (key, content, media_type); existing keys are overwritten."""
    new = rows.groupBy("key").agg(F.max_by(F.struct("content", "media_type"), F.struct("content", "media_type")).alias("v")).select("key", "v.content", "v.media_type", F.length("v.content").cast("bigint").alias("size"), F.sha2("v.content", 256).alias("sha256")).withColumn("bucket", _bucket())
    touched = new.select("bucket").distinct()
    old = _stored(rows.sparkSession, root).join(F.broadcast(touched), "bucket", "left_semi").join(new.select("key"), "key", "left_anti")  # at most BUCKETS rows are sent
    _write(old.unionByName(new), root)


def get(keys: DataFrame, root: str) -> DataFrame:
    """(key, content, media_type, size, sha256) of the keys that are there."""
    wanted = keys.select("key").distinct().withColumn("bucket", _bucket())
    return _stored(keys.sparkSession, root).join(wanted, ["bucket", "key"], "left_semi").drop("bucket")


def stat(keys: DataFrame, root: str) -> DataFrame:
    """(key, media_type, size, sha256) without reading any content."""
    return get(keys, root).drop("content")


def remove(keys: DataFrame, root: str) -> None:
    """Delete the keys that are there."""
    gone = keys.select("key").distinct().withColumn("bucket", _bucket())
    stored = _stored(keys.sparkSession, root)
    touched = stored.join(gone, ["bucket", "key"], "left_semi").select("bucket").distinct()
    rest = stored.join(F.broadcast(touched), "bucket", "left_semi").join(gone, ["bucket", "key"], "left_anti")  # at most BUCKETS rows are sent
    empty = touched.join(rest.select("bucket").distinct(), "bucket", "left_anti").collect()  # at most BUCKETS rows
    _write(rest, root)
    spark = keys.sparkSession
    for r in empty:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/bucket={r.bucket}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
