"""Counts and dashboard arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.money import next_milestone


def owned_invoices(invoices: DataFrame, clients: DataFrame, asesoria_id=None, company=None) -> DataFrame:
    """Invoices with an existing client; orphans drop out."""
    firm = clients.select(F.col("id").alias("cliente_id"), "asesoria_id")
    if asesoria_id is not None:
        firm = firm.filter(F.col("asesoria_id") == asesoria_id)
    own = invoices if company is None else invoices.filter(F.col("cliente_id") == company)
    return own.join(firm, "cliente_id")


def count_by_state(invoices: DataFrame, clients: DataFrame, asesoria_id=None, company=None) -> DataFrame:
    """Count per firm and state.  Counted per client first, so that the join moves one row per client and
    state instead of every invoice and no client is hot."""
    own = invoices if company is None else invoices.filter(F.col("cliente_id") == company)
    per_client = own.groupBy("cliente_id", "estado").agg(F.count(F.lit(1)).alias("n"))
    firm = clients.select(F.col("id").alias("cliente_id"), "asesoria_id")
    if asesoria_id is not None:
        firm = firm.filter(F.col("asesoria_id") == asesoria_id)
    return per_client.join(firm, "cliente_id").groupBy("asesoria_id", "estado").agg(F.sum("n").alias("count"))


def dashboard(invoices: DataFrame, clients: DataFrame) -> DataFrame:
    """One row per firm; the legacy state counts as pending review."""
    counts = count_by_state(invoices, clients)

    def of(*states: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("estado").isin(*states), F.col("count"))), F.lit(0))

    return counts.groupBy("asesoria_id").agg(
        F.sum("count").alias("total"),
        of("PROCESADA_IA").alias("procesadas_ia"),
        of("PENDIENTE_REVISION", "PROCESADA_IA").alias("pendientes_revision"),
        of("VALIDADA").alias("validadas"),
        of("ERROR_PROCESAMIENTO").alias("errores"),
    )


def milestone_progress(board: DataFrame, milestones=K.BILLING_MILESTONES) -> DataFrame:
    done = F.col("pendientes_revision") + F.col("validadas") + F.col("errores")
    with_next = board.withColumn("processed", done).withColumn("next_milestone", next_milestone(F.col("processed"), milestones))
    pct = F.least(F.lit(100), F.floor(F.col("processed") * 100 / F.col("next_milestone") + 0.5)).cast("bigint")
    return with_next.withColumn("pct", pct)


def state_share(counts: DataFrame, group: str = "asesoria_id") -> DataFrame:
    """Share of the largest state, per group, for bars; a group has at most one row per state."""
    w = Window.partitionBy(group)
    positive = counts.filter(F.col("count") > 0)
    return positive.select(
        group, "estado", "count",
        F.sum("count").over(w).alias("total"),
        F.floor(F.col("count") * 100 / F.max("count").over(w) + 0.5).cast("bigint").alias("pct_of_max"),
    )


def job_latency(jobs: DataFrame, exact: bool = False) -> DataFrame:
    """Seconds from start to end of finished jobs: count, mean, 95th percentile.

    The percentile is a mergeable sketch by default.  ``exact`` counts per whole second first, so the exact
    percentile works on one row per distinct latency.
    """
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    finished = jobs.filter(F.col("finished_at").isNotNull() & F.col("started_at").isNotNull()).select(
        F.round(seconds / 1000000).cast("bigint").alias("s")
    )
    if not exact:
        return finished.agg(
            F.count(F.lit(1)).alias("n"), F.avg("s").alias("avg_s"), F.percentile_approx("s", 0.95, 10000).alias("p95_s")
        )
    per_second = finished.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    return per_second.agg(
        F.sum("k").alias("n"),
        F.round(F.sum(F.col("s") * F.col("k")) / F.sum("k"), 6).alias("avg_s"),
        F.round(F.percentile("s", 0.95, F.col("k")), 6).alias("p95_s"),
    )


def extraction_report(runs: DataFrame) -> DataFrame:
    """One row about a batch of extractions."""
    ok = F.col("ok")
    return runs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & F.col("ai_used")).alias("ai_used"),
        F.round(F.avg(F.when(ok, F.col("confianza"))), 2).alias("avg_conf"),
        F.count_if(ok & (F.col("side") == "compra")).alias("compra"),
        F.count_if(ok & (F.col("side") == "venta")).alias("venta"),
        F.count_if(ok & ~F.coalesce(F.col("side"), F.lit("")).isin("compra", "venta")).alias("unknown"),
        F.round(F.sum("seconds"), 1).alias("seconds"),
        F.round(F.avg("seconds"), 1).alias("avg_seconds"),
    )


def compare_engines(old: DataFrame, new: DataFrame, band: float = 0.01) -> DataFrame:
    """Old against new confidence of the same documents; differences within the band count as same."""
    delta = F.round(F.col("new_conf") - F.col("old_conf"), 6)
    both = old.select("id", F.col("confianza").alias("old_conf")).join(
        new.select("id", F.col("confianza").alias("new_conf")), "id"
    )
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("old_conf"), 4).alias("avg_old"),
        F.round(F.avg("new_conf"), 4).alias("avg_new"),
        F.count_if(delta > band).alias("improved"),
        F.count_if(F.abs(delta) <= band).alias("same"),
        F.count_if(delta < -band).alias("worse"),
    )


def token_cost(attempts: DataFrame, usd_in: str = K.USD_PER_MILLION_IN, usd_out: str = K.USD_PER_MILLION_OUT) -> DataFrame:
    """Tokens of all attempts of a document and their price."""
    cost = (
        F.sum("prompt_tokens") * F.lit(usd_in).cast("decimal(9,4)")
        + F.sum("completion_tokens") * F.lit(usd_out).cast("decimal(9,4)")
    ) / 1000000
    return attempts.groupBy("doc_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(cost, 6).cast("double").alias("cost"),
    )
