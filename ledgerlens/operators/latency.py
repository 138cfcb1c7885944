"""Latency quantiles of any firm and span of days from one stored sketch a firm and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: rank errors stay well below one percent, some kilobytes each.
SKETCH = 800


def seconds_taken() -> Column:
    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return F.round(micros / 1000000).cast("bigint")


def finished_per_firm(jobs: DataFrame, firms: DataFrame) -> DataFrame:
    """``asesoria_id``, ``day`` (of the end), ``s`` (whole seconds) of every finished job of an invoice with a firm."""
    done = jobs.where("finished_at is not null and started_at is not null")
    timed = done.select("factura_id", F.to_date("finished_at").alias("day"), seconds_taken().alias("s"))
    return timed.join(firms, "factura_id").select("asesoria_id", "day", "s")


def latency_sketches(finished: DataFrame, size: int = SKETCH) -> DataFrame:
    """One mergeable sketch a firm and day.  Partial sketches are built before the shuffle, so no firm is hot."""
    return finished.groupBy("asesoria_id", "day").agg(F.kll_sketch_agg_bigint("s", F.lit(size)).alias("sketch"))


def latency_of_span(sketches: DataFrame, share: float = 0.95, first=None, last=None) -> DataFrame:
    """``asesoria_id``, ``n``, ``quantile`` of each firm over the days ``first`` to ``last`` (both included, None: open).

    Reads sketches and no job.  A firm without a job in the span has no row.
    """
    if first is not None:
        sketches = sketches.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        sketches = sketches.where(F.col("day") <= F.lit(last).cast("date"))
    merged = sketches.groupBy("asesoria_id").agg(F.kll_merge_agg_bigint("sketch").alias("m"))
    return merged.select("asesoria_id", F.kll_sketch_get_n_bigint("m").alias("n"), F.kll_sketch_get_quantile_bigint("m", F.lit(share)).alias("quantile"))
