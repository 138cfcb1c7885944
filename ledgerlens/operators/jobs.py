"""Processing jobs: queue, recovery of stuck jobs, state replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .windows import last_before


def pending_queue(jobs: DataFrame, k: int) -> DataFrame:
    """The ``k`` oldest pending jobs."""
    return jobs.filter(F.col("estado") == "PENDIENTE").orderBy("created_at", "id").limit(k)


def recover(jobs: DataFrame, now: Column, cutoff: Column, max_recoveries: int, factura_id: int | None) -> DataFrame:
    """Jobs after recovery, with ``recovered`` marking those that were stuck."""
    stuck = (F.col("estado") == "EN_PROCESO") & F.col("started_at").isNotNull() & (F.col("started_at") < cutoff)
    if factura_id is not None:
        stuck = stuck & (F.col("factura_id") == factura_id)
    stuck = F.coalesce(stuck, F.lit(False))
    give_up = F.col("retry_count") + 1 >= max_recoveries
    note = F.when(give_up, K.GIVE_UP_MESSAGE).otherwise(K.REQUEUE_MESSAGE)
    changes = {
        "estado": F.when(give_up, "ERROR").otherwise("PENDIENTE"),
        "started_at": F.when(give_up, F.col("started_at")),
        "finished_at": F.when(give_up, now),
        "retry_count": F.col("retry_count") + 1,
        "error_message": F.concat_ws(" | ", F.nullif(F.col("error_message"), F.lit("")), note),
    }
    if "worker_id" in jobs.columns:
        changes["worker_id"] = F.when(give_up, F.col("worker_id"))
    return jobs.select(
        *[F.when(stuck, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns],
        stuck.alias("recovered"),
    )


def requeue_stale(
    jobs: DataFrame,
    invoices: DataFrame,
    now: Column,
    cutoff: Column,
    max_recoveries: int = K.MAX_RECOVERIES,
    factura_id: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Recover stuck jobs and carry the outcome to invoices that are still in process."""
    after = recover(jobs, now, cutoff, max_recoveries, factura_id)
    outcome = (
        after.filter("recovered")
        .groupBy("factura_id")
        .agg(F.max(F.col("estado") == "ERROR").alias("_failed"), F.max(F.col("estado") == "PENDIENTE").alias("_queued"))
        .withColumnRenamed("factura_id", "id")
    )
    running = F.col("estado") == "EN_PROCESO"
    # requeueing comes first: it takes the invoice out of EN_PROCESO before failures are applied
    state = (
        F.when(running & F.col("_queued"), "SUBIDA")
        .when(running & F.col("_failed"), "ERROR_PROCESAMIENTO")
        .otherwise(F.col("estado"))
    )
    updated = invoices.join(outcome, "id", "left").select(
        *[state.alias(c) if c == "estado" else F.col(c) for c in invoices.columns]
    )
    return after, updated


def replay_states(audit: DataFrame) -> DataFrame:
    """State of each invoice from its audit log: the newest state-changing action decides."""
    mapping = F.create_map(*[F.lit(x) for pair in K.ACTION_STATE.items() for x in pair])
    moves = audit.withColumn("estado", mapping[F.col("accion")]).filter(F.col("estado").isNotNull())
    newest = moves.groupBy("factura_id").agg(F.max(F.struct("created_at", "id", "estado")).alias("m"))
    return newest.select("factura_id", F.col("m.estado").alias("estado"), F.col("m.created_at").alias("since"))


def illegal_reviews(audit: DataFrame) -> DataFrame:
    """Validations and rejections of invoices whose state at that time did not allow a review.

    The state before each action is the newest earlier state-changing action; days split busy invoices.
    """
    mapping = F.create_map(*[F.lit(x) for pair in K.ACTION_STATE.items() for x in pair])
    seen = last_before(
        audit.withColumn("_to", mapping[F.col("accion")]),
        ["factura_id"], ["created_at", "id"], F.to_date("created_at"), "_to", "estado_previo",
    )
    review = F.col("accion").isin("VALIDADA", "RECHAZADA")
    fine = F.coalesce(F.col("estado_previo").isin(*K.ACTIONABLE_STATES), F.lit(False))
    return seen.filter(review & ~fine).select("id", "factura_id", "accion", "estado_previo")
