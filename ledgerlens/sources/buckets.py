"""Tables in hash buckets of their key: an update reads and writes only the buckets that it touches.

    <path>/bucket=<k>/*.parquet    rows whose key falls into bucket k

Buckets are partitions of a plain Parquet table, so any reader sees the whole table, and a filter on ``bucket`` prunes folders.
Updates overwrite partitions dynamically: new files are staged and moved when all tasks are done.  An update sets values
rather than adding to them, so one that was cut short can run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, dynamic: bool) -> None:
    # a rebalance deals buckets into files of the advisory size, large ones into several
    out = rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket")
    out.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table anew.  A column ``bucket`` of its own is not allowed."""
    if "bucket" in (c.lower() for c in rows.columns):
        raise ValueError("the table has a column named bucket")
    _write(rows.withColumn("bucket", bucket_of(key, buckets)), path, dynamic=False)


def read_buckets(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame:
    """The table, or the part of it in some buckets: the filter names partitions, so no other folder is read."""
    rows = spark.read.parquet(path)
    return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).drop("bucket")


def touched_buckets(patch: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the keys of a patch: as many numbers as there are buckets at most."""
    return sorted(r["bucket"] for r in patch.select(bucket_of(key, buckets).alias("bucket")).distinct().collect())


def update_buckets(
    spark: SparkSession, path: str, key: str, patch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS
) -> list[int]:
    """Replace the rows of the touched buckets by ``change(rows, patch)`` and tell which these were.

    ``change`` keeps columns and keys, as ``apply_patch`` and ``update_from`` do.  An empty patch writes nothing.
    """
    touched = touched_buckets(patch, key, buckets)
    if touched:
        rows = read_buckets(spark, path, touched)
        changed = change(rows, patch).select(rows.columns)
        _write(changed.withColumn("bucket", bucket_of(key, buckets)), path, dynamic=True)
    return touched
