"""Live views over uploads, jobs and the audit log.  Inputs are streaming frames with event time ``ts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .core import ROCKSDB, shared_folder
from .deltas import MERGE_EVERY, DeltaStore, drain_into, remove

LATE = "rows long, late long, newest long, batch long"


def _day(c: str) -> Column:
    """Day of a time as text, the bucket that a merge rewrites."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("none"))


def dedup_uploads(uploads: DataFrame, recent: str = "1 hour", merge_every: int = MERGE_EVERY, digits: int = 2) -> DeltaStore:
    """Each content once, with the time it was first met (``hash_archivo``, ``ts``), however far apart its copies are.

    Two tiers: the state of the stream holds the hashes of the last while by arrival, so repeated uploads go early and
    nothing is late; what it lets pass meets the store of all hashes, of which only the parts with its prefixes are read.
    """

    def shape(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hash_archivo").agg(F.min("ts").alias("ts")).withColumn("bucket", F.left("hash_archivo", F.lit(digits)))

    store = DeltaStore(uploads, "dedup", shape, {"ts": "min"}, merge_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        # what has come is written once: each reading of the batch itself would run the state again
        arrived = f"{store.folder}/arrived/batch={batch_id}"
        shape(batch).write.mode("overwrite").parquet(arrived)
        new = store.spark.read.schema("hash_archivo string, ts timestamp, bucket string").parquet(arrived)
        if batch_id > 0:
            prefixes = [r[0] for r in new.select("bucket").distinct().collect()]  # 16 ** digits at most
            new = new.join(store.rows(prefixes, before=batch_id).select("hash_archivo"), "hash_archivo", "left_anti")
            remove(f"{store.folder}/arrived/batch={batch_id - 1}")
        store.append(new.select("hash_archivo", "ts", "bucket"), batch_id)

    uploads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seen = uploads.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", recent)
    return drain_into(store, seen.dropDuplicatesWithinWatermark(["hash_archivo"]).drop("_seen"), write)


def last_states(audit: DataFrame) -> DataFrame:
    """Newest state-changing action per invoice, as an update stream."""
    mapping = F.create_map(*[F.lit(x) for pair in K.ACTION_STATE.items() for x in pair])
    moves = audit.withColumn("estado", mapping[F.col("accion")]).filter(F.col("estado").isNotNull())
    return moves.groupBy("factura_id").agg(F.max(F.struct("ts", "id", "estado")).alias("m"))


def live_counts(sink: DataFrame) -> DataFrame:
    """Invoices per state from the deltas that ``last_states`` wrote."""
    now = sink.groupBy("factura_id").agg(F.max("m").alias("m"))
    return now.groupBy(F.col("m.estado").alias("estado")).agg(F.count(F.lit(1)).alias("count"))


def newest_rows(batch: DataFrame, n: int) -> DataFrame:
    """What one micro-batch can contribute to a feed of the ``n`` newest rows."""
    return batch.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def throughput(stream: DataFrame, limit: int = K.SCALE_OUT_PER_MINUTE, merge_every: int = MERGE_EVERY) -> DataFrame:
    """Arrivals per minute, and whether they exceed what one worker takes.  Rows may come in any order."""

    def shape(rows: DataFrame) -> DataFrame:
        minute = F.date_trunc("minute", "ts").alias("minute")
        return rows.groupBy(minute).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _day("minute"))

    store = drain_into(DeltaStore(stream, "throughput", shape, {"n": "sum"}, merge_every), stream)
    return store.table().select("minute", "n", (F.col("n") > limit).alias("over_limit"))


def rate_limits(stream: DataFrame, n: int, width: int, slide: int, merge_every: int = MERGE_EVERY) -> DataFrame:
    """Sliding windows of ``width`` minutes, one every ``slide``, in which a user goes beyond ``n`` actions.

    The deltas count panes of ``slide`` minutes; a window is the sum of the panes it spans.  Rows may come in any order.
    """
    if width % slide:
        raise ValueError("width must be a multiple of slide")

    def shape(rows: DataFrame) -> DataFrame:
        pane = F.window("ts", f"{slide} minutes")["start"].alias("pane")
        return rows.groupBy("user_id", pane).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _day("pane"))

    panes = drain_into(DeltaStore(stream, "limits", shape, {"n": "sum"}, merge_every), stream).table()
    if width > slide:
        back = F.explode(F.sequence(F.lit(0), F.lit(width // slide - 1))).alias("back")
        starts = panes.select("user_id", "pane", "n", back)
        start = F.timestamp_micros(F.unix_micros("pane") - F.col("back").cast("long") * slide * 60_000_000)
        panes = starts.groupBy("user_id", start.alias("pane")).agg(F.sum("n").alias("n"))
    return panes.where(F.col("n") > n).select("user_id", F.col("pane").alias("start"), "n")


def late_rows(stream: DataFrame, minutes: int = 10) -> DataFrame:
    """One row per micro-batch: ``batch``, ``rows``, ``late``, ``newest`` (event time so far).

    A row is late if its minute ended before the watermark, the newest event time of the batches before less ``minutes``.
    That time is the one row which the batch before wrote, so a batch that runs twice counts the same.
    """
    spark, sink = stream.sparkSession, f"{shared_folder(stream.sparkSession, 'late')}/table"
    ends = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(60_000_000)) + 60_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema(LATE).parquet(f"{sink}/batch={batch_id - 1}").first()["newest"] if batch_id > 0 else None
        mark = None if seen is None else seen - minutes * 60_000_000
        late = F.lit(0).cast("long") if mark is None else F.count_if(ends <= mark)
        newest = F.greatest(F.max(F.unix_micros("ts")), F.lit(seen).cast("long"))
        counted = batch.agg(F.count(F.lit(1)).alias("rows"), late.alias("late"), newest.alias("newest"))
        counted.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = stream.writeStream.option("checkpointLocation", f"{sink}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(LATE).parquet(sink)
