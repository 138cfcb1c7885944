"""Gap-free numbers per client and their counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import number_within


def backfill_correlative(invoices: DataFrame) -> DataFrame:
    """Number the invoices of each client that have no number yet by (created_at, id); days split the large clients.

    All rows come back: those with a number keep it, those without a client get none.  Undated invoices come last.
    """
    if "numero_correlativo" not in invoices.columns:
        invoices = invoices.withColumn("numero_correlativo", F.lit(None).cast("bigint"))
    open_ = F.col("numero_correlativo").isNull() & F.col("cliente_id").isNotNull()
    order = [F.col("created_at").asc_nulls_last(), F.col("id")]
    numbered = number_within(
        invoices.filter(open_).drop("numero_correlativo"), ["cliente_id"], order, [F.to_date("created_at")], "numero_correlativo"
    )
    rest = invoices.filter(~open_).withColumn("numero_correlativo", F.col("numero_correlativo").cast("bigint"))
    return numbered.unionByName(rest)


def max_numbers(invoices: DataFrame) -> DataFrame:
    return (
        invoices.filter(F.col("cliente_id").isNotNull() & F.col("numero_correlativo").isNotNull())
        .groupBy("cliente_id")
        .agg(F.max("numero_correlativo").alias("computed"))
    )


def seed_counters(invoices: DataFrame, counters: DataFrame) -> DataFrame:
    """Counter per client: the greater of the stored one and the largest number in use."""
    both = counters.join(max_numbers(invoices), "cliente_id", "full")
    return both.select("cliente_id", F.greatest("ultimo_correlativo", "computed").alias("ultimo_correlativo"))


def bump_counters(counters: DataFrame, new_counts: DataFrame) -> DataFrame:
    """Upsert: clients new to the table start at their count, the others move on by it."""
    both = counters.join(new_counts.select("cliente_id", "n"), "cliente_id", "full")
    moved = F.coalesce("ultimo_correlativo", F.lit(0)) + F.coalesce("n", F.lit(0))
    return both.select("cliente_id", moved.cast("bigint").alias("ultimo_correlativo"))


def assign_correlative(new_invoices: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers for a batch of new invoices that continue each client's counter, and the new counters."""
    fresh = new_invoices.drop("numero_correlativo")
    local = backfill_correlative(fresh).withColumnRenamed("numero_correlativo", "_local")
    numbered = local.join(counters.select("cliente_id", "ultimo_correlativo"), "cliente_id", "left").select(
        *fresh.columns,
        (F.col("_local") + F.coalesce("ultimo_correlativo", F.lit(0))).cast("bigint").alias("numero_correlativo"),
    )
    counts = new_invoices.filter(F.col("cliente_id").isNotNull()).groupBy("cliente_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return numbered, bump_counters(counters, counts)


def numbering_gaps(numbered: DataFrame) -> DataFrame:
    """Clients whose numbers are not exactly 1..n."""
    per = numbered.groupBy("cliente_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("numero_correlativo").alias("low"),
        F.max("numero_correlativo").alias("high"),
        F.sum("numero_correlativo").alias("s"),
    )
    return per.filter(
        (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("s") * 2 != F.col("n") * (F.col("n") + 1))
    )
