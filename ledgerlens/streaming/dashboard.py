"""Dashboards kept by signed deltas of state changes, so that a refresh reads what has come and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .deltas import MERGE_EVERY, DeltaStore, drain_into, remove

#: Parts of the table of newest moves; a micro-batch reads those of its invoices.
PARTS = 256
CHANGES = "asesoria_id long, estado string, since_day string, n long, bucket string"


def state_rollup(audit: DataFrame, firms: DataFrame, merge_every: int = MERGE_EVERY, parts: int = PARTS) -> DeltaStore:
    """Invoices per firm, state and day since which they are in it: ``asesoria_id``, ``estado``, ``since_day``, ``n``.

    ``audit``: stream of factura_id, id, accion, ts.  ``firms``: factura_id, asesoria_id; invoices that it lacks count nowhere.
    The newest move of an invoice decides.  A micro-batch that brings a newer one adds -1 where the invoice was counted and +1
    where it is now; an older one that comes late changes nothing.  So any order of arrival gives the same table.
    """
    mapping = F.create_map(*[F.lit(x) for pair in K.ACTION_STATE.items() for x in pair])
    part = F.pmod(F.xxhash64("factura_id"), F.lit(parts)).cast("string")

    def shape(rows: DataFrame) -> DataFrame:
        moves = rows.withColumn("estado", mapping[F.col("accion")]).where(F.col("estado").isNotNull())
        return moves.groupBy("factura_id").agg(F.max(F.struct("ts", "id", "estado")).alias("m")).withColumn("bucket", part)

    states = DeltaStore(audit, "moves", shape, {"m": "max"}, merge_every)
    spark = states.spark
    counts = DeltaStore(spark.createDataFrame([], CHANGES), "rollup", lambda rows: rows, {"n": "sum"}, merge_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = f"{states.folder}/arrived/batch={batch_id}"
        shape(batch).write.mode("overwrite").parquet(arrived)
        new = spark.read.schema("factura_id long, m struct<ts:timestamp,id:long,estado:string>, bucket string").parquet(arrived)
        moved = new.withColumn("was", F.lit(None).cast(new.schema["m"].dataType))
        if batch_id > 0:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``parts`` at most
            known = states.rows(touched, before=batch_id).select("factura_id", F.col("m").alias("was"))
            moved = new.join(known, "factura_id", "left").where(F.col("was").isNull() | (F.col("m") > F.col("was")))
            remove(f"{states.folder}/arrived/batch={batch_id - 1}")
        sides = F.inline(F.array(F.struct("m", F.lit(1).cast("long").alias("n")), F.struct(F.col("was").alias("m"), F.lit(-1).cast("long").alias("n"))))
        changes = moved.join(firms, "factura_id").select("asesoria_id", sides).where("m is not null")
        day = F.date_format("m.ts", "yyyy-MM-dd").alias("since_day")
        summed = changes.groupBy("asesoria_id", F.col("m.estado").alias("estado"), day).agg(F.sum("n").alias("n")).where("n <> 0")
        # counts first: until the moves are stored a batch that runs again finds the same changes
        counts.append(summed.withColumn("bucket", F.left("since_day", F.lit(7))), batch_id)
        states.append(new, batch_id)

    drained = drain_into(states, audit, write)
    counts.progress = drained.progress
    if not any(p["numInputRows"] for p in drained.progress):
        counts.append(spark.createDataFrame([], CHANGES), 0)
    return counts


def rollup_rows(counts: DeltaStore) -> DataFrame:
    """Where invoices are now."""
    return counts.table().where("n <> 0").select("asesoria_id", "estado", "since_day", "n")


def rollup_by_state(counts: DeltaStore) -> DataFrame:
    """Invoices per firm and state, the input of the dashboard arithmetic."""
    return rollup_rows(counts).groupBy("asesoria_id", "estado").agg(F.sum("n").alias("count"))
