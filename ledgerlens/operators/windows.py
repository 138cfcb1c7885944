"""Skew-proof building blocks: numbering inside a key, latest per key, joins back to a summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[Column], out: str
) -> DataFrame:
    """``row_number`` per key that does not put a whole key into one task.

    ``buckets`` must be a coarse, monotone prefix of ``order`` (the day of a timestamp, say).  Rows are
    numbered inside (key, bucket); the counts of the earlier buckets of the key, summed over the small
    pre-aggregated table, are added.  A key with a third of all rows is thus spread over its buckets.
    A NULL bucket comes last; ``order`` must say the same (``asc_nulls_last``).  NULL keys are one key.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    fine = [*keys, *names]
    before = Window.partitionBy(*keys).orderBy(*[F.col(n).asc_nulls_last() for n in names]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*fine)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*fine, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = tagged.withColumn("_local", F.row_number().over(Window.partitionBy(*fine).orderBy(*order)))
    offsets = offsets.select(*[F.col(c).alias("_k" + c) for c in fine], "_before")
    same = [local[c].eqNullSafe(offsets["_k" + c]) for c in fine]
    joined = local.join(offsets, same, "left")
    return joined.select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(out)
    )


def number_rows(df: DataFrame, key: str, start, out: str) -> DataFrame:
    """Dense numbers ``start + 1 ..`` over the whole frame, whose ``key`` is unique, ordered by
    (three hex digits of md5(key), key).

    The 4096 md5 buckets are numbered in parallel; only their counts, 4096 rows at most, meet in one task.
    """
    tagged = df.withColumn("_b", F.substring(F.md5(F.col(key)), 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = tagged.withColumn("_local", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return local.join(F.broadcast(offsets), "_b").select(
        *df.columns, (F.col("_local") + F.col("_before") + start).cast("bigint").alias(out)
    )


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Newest non-NULL ``value`` of the key strictly before each row, without one task per key.

    Inside a bucket (a monotone coarse prefix of ``order``) a window looks back; what earlier buckets leave
    behind is their newest value, aggregated map-side and carried forward over the small bucket table.
    """
    fine = [*keys, "_b"]
    tagged = df.withColumn("_b", bucket)
    newest = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value)))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tagged.groupBy(*fine).agg(newest.alias("_m")).select(
        *fine, F.last(F.col(f"_m.{value}"), ignorenulls=True).over(earlier).alias("_carried")
    )
    inside = Window.partitionBy(*fine).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
    return local.join(carried, fine, "left").select(*df.columns, F.coalesce("_seen", "_carried").alias(out))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``.

    Planned as a rank limit: every map task keeps one row per key before the shuffle, so a hot key
    arrives as one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key, with their position; limited before the shuffle as in ``first_per``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("pos", rank).filter(F.col("pos") <= n)


def join_summary(df: DataFrame, summary: DataFrame, key: str, rows: str, share: int = 1000) -> DataFrame:
    """Join rows back to a per-key summary that carries the row count ``rows`` of each key.

    Keys holding more than 1/``share`` of all rows number fewer than ``share`` by arithmetic, so that
    part of the summary may be broadcast; the other keys take an ordinary shuffled join.
    """
    total = summary.agg(F.sum(rows)).scalar()
    marked = summary.withColumn("_hot", F.col(rows) * share > total)
    hot = marked.filter("_hot").drop("_hot")
    cold = marked.filter("not _hot").drop("_hot")
    # a key is either hot or cold: inner joins on both sides cover each row once
    return df.join(F.broadcast(hot), key).unionByName(df.join(cold, key))
