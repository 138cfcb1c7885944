"""Stuck-job detection over job events that arrive in any order.

A job starts with an ``EN_PROCESO`` event.  If no other event of its invoice follows within the limit it is stuck: recovered
(back to pending), or given up each time the recoveries since the last end reach their maximum.  The events are kept as
mergeable deltas, so an event that comes late simply takes its place; what it changes is told by the next reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .deltas import MERGE_EVERY, DeltaStore, drain_into

TERMINAL = ("COMPLETADO", "ERROR")
#: Milliseconds of a bucket: windows look inside (invoice, bucket), and one row a bucket is carried on.
DAY = 86_400_000


def _carry(events: DataFrame, name: str, within: list[Column], over: list[Column]) -> DataFrame:
    """Events with columns carried from the other buckets of their invoice: ``within`` aggregates each bucket, ``over`` looks
    along the buckets of an invoice.  An invoice with very many events is thus never one window."""
    buckets = events.groupBy("factura_id", "day").agg(*within).select("factura_id", "day", *over)
    keys = {c: F.col(c).alias(f"_{name}_{c}") for c in ("factura_id", "day")}
    buckets = buckets.select(*keys.values(), *[c for c in buckets.columns if c not in keys])
    same = [events[c].eqNullSafe(buckets[f"_{name}_{c}"]) for c in keys]
    return events.join(buckets, same, "left").drop(*[f"_{name}_{c}" for c in keys])


def job_results(events: DataFrame, now_ms: int | None, stale_minutes: int = K.STALE_MINUTES, max_recoveries: int = K.MAX_RECOVERIES) -> DataFrame:
    """Finished and recovered jobs from events ``(factura_id, estado, ms)``: ``factura_id``, ``estado``, ``ms``, ``recovered``.

    ``now_ms`` judges jobs that nothing follows.  Events of one invoice at the same time go by their state.
    """
    stale = stale_minutes * 60_000
    rows = events.select("factura_id", "estado", "ms", F.floor(F.col("ms") / DAY).alias("day"))
    inside = Window.partitionBy("factura_id", "day").orderBy("ms", "estado")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("factura_id").orderBy("day")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)

    rows = rows.withColumn("_next", F.lead("ms").over(inside))
    rows = _carry(rows, "n", [F.min("ms").alias("_least")], [F.lead("_least").over(along).alias("_following")])
    follows = F.coalesce("_next", "_following")
    stuck = (F.col("estado") == "EN_PROCESO") & F.coalesce(follows > F.col("ms") + stale, F.col("ms") + stale <= F.lit(now_ms).cast("long"))
    rows = rows.withColumn("_stuck", F.coalesce(stuck, F.lit(False))).withColumn("_count", F.count_if("_stuck").over(so_far))
    # recoveries since the last end: all so far less those there were at it
    rows = rows.withColumn("_at_end", F.max(F.when(F.col("estado").isin(*TERMINAL), F.col("_count"))).over(so_far))
    rows = _carry(
        rows, "c", [F.count_if("_stuck").alias("_all"), F.max("_at_end").alias("_ended")],
        [F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"), "_ended"],
    )
    # a bucket's own last end, counted from the first bucket on, is what later buckets go back to
    ends = rows.groupBy("factura_id", "day").agg((F.max("_before") + F.max("_at_end")).alias("_end"))
    ends = ends.select(F.col("factura_id").alias("_f"), F.col("day").alias("_d"), F.max("_end").over(Window.partitionBy("factura_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("_last_end"))
    rows = rows.join(ends, rows["factura_id"].eqNullSafe(ends["_f"]) & rows["day"].eqNullSafe(ends["_d"]), "left")
    since = F.coalesce(F.col("_before") + F.col("_at_end"), "_last_end", F.lit(0))
    nth = F.col("_before") + F.col("_count") - since
    told = rows.select("factura_id", "estado", "ms", "_stuck", F.when(nth % max_recoveries == 0, "ERROR").otherwise("PENDIENTE").alias("_as"))
    finished = F.when(F.col("estado").isin(*TERMINAL), F.struct("estado", "ms", F.lit(False).alias("recovered")))
    recovered = F.when(F.col("_stuck"), F.struct(F.col("_as").alias("estado"), (F.col("ms") + stale).alias("ms"), F.lit(True).alias("recovered")))
    return told.select("factura_id", F.explode(F.filter(F.array(finished, recovered), lambda x: x.isNotNull())).alias("r")).select("factura_id", "r.*")


def track_jobs(
    events: DataFrame, stale_minutes: int = K.STALE_MINUTES, max_recoveries: int = K.MAX_RECOVERIES, late_minutes: int = 10, merge_every: int = MERGE_EVERY
) -> DataFrame:
    """Finished and recovered jobs of a stream of job events ``(factura_id, estado, ms)``, read from its merged deltas.

    A last job counts as stuck once the newest event is ``late_minutes`` beyond its limit.
    """

    def shape(rows: DataFrame) -> DataFrame:
        day = F.coalesce(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd"), F.lit("none"))
        return rows.groupBy("factura_id", "ms", "estado").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", day)

    store = drain_into(DeltaStore(events, "jobs", shape, {"n": "sum"}, merge_every), events)
    newest = store.table().agg(F.max("ms")).first()[0]
    repeated = store.table().select("factura_id", "estado", "ms", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k"))
    return job_results(repeated.drop("_k"), None if newest is None else newest - late_minutes * 60_000, stale_minutes, max_recoveries)
