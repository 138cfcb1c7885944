"""Registered queries: a Spark plan over the domain and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from ..sources.domain import Domain

_PLANS: dict[str, Callable[[Domain], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan: Callable[[Domain], DataFrame]):
        _PLANS[name] = plan
        if oracle is not None:
            _ORACLES[name] = oracle
        return plan

    return register


def ts(c: str | Column) -> Column:
    """Timestamp as text with microseconds, the form results are compared in."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def duck_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import business, extraction, lists, quality, rules, scalars, streams, tables  # noqa: F401

    def bind(plan):
        return lambda spark, sf_dir: plan(Domain(tune(spark), sf_dir))

    return {name: bind(plan) for name, plan in _PLANS.items()}


def oracles() -> dict[str, str]:
    plans()
    return dict(_ORACLES)
