"""Table-level checks: uniqueness, domains, references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def uniqueness_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; keys with a NULL do not count."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-NULL key has no parent row."""
    return df.filter(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias(key)), key, "left_anti"
    )


def schema_report(invoices, clients, users, documents, jobs, audit) -> DataFrame:
    """Number of rows that break each rule: ``tabla``, ``regla``, ``n_bad``.

    Each table is scanned once.  A row says what it is, what it refers to and which domains it breaks; all that is counted
    per referred key before the one shuffle, so a key held by many rows moves once a task.  Keys that nobody is, but
    somebody refers to, are the broken references.
    """
    broken = lambda c: F.coalesce(c, F.lit(True))
    outside = lambda name, allowed: broken(~F.col(name).isin(*allowed))
    tables = [
        (invoices, "facturas", {"estado": outside("estado", K.INVOICE_STATES)}, {"fk_cliente": ("cliente_id", "clientes")}),
        (clients, "clientes", {"estado": outside("estado", ("ACTIVA", "INACTIVA"))}, {}),
        (users, "usuarios", {"empresa_cliente": broken((F.col("tipo_usuario") == "EMPRESA") & F.col("cliente_id").isNull()), "rol": outside("rol", K.USER_ROLES)},
         {"fk_cliente": ("cliente_id", "clientes")}),
        (documents, "documentos_subidos", {"canal": outside("canal_entrada", K.CHANNELS)}, {"fk_factura": ("factura_id", "facturas")}),
        (jobs, "processing_jobs", {"estado": outside("estado", K.JOB_STATES)}, {"fk_factura": ("factura_id", "facturas")}),
        (audit, "auditoria", {}, {"fk_usuario": ("usuario_id", "usuarios")}),
    ]
    referred = {ref for *_, keys in tables for _, ref in keys.values()}
    rules: list[tuple[str, str]] = []

    def entry(ref, key, rule, when=None):
        one = F.struct(F.lit(ref).alias("ref"), key.cast("string").alias("key"), F.lit(rule).cast("int").alias("rule"))
        return one if when is None else F.when(when, one)

    told = []
    for df, name, domains, keys in tables:
        said = [entry(name, F.col("id"), None, F.col("id").isNotNull())] if name in referred else []
        for rule, bad in domains.items():
            said.append(entry("", F.lit(""), len(rules), bad))
            rules.append((name, rule))
        for rule, (key, ref) in keys.items():
            said.append(entry(ref, F.col(key), len(rules), F.col(key).isNotNull()))
            rules.append((name, rule))
        told.append(df.select(F.inline(F.filter(F.array(*said), lambda x: x.isNotNull()))))
    counts = [F.count_if(F.col("rule") == k).alias(f"r{k}") for k in range(len(rules))]
    per_key = reduce(lambda a, b: a.union(b), told).groupBy("ref", "key").agg(F.count_if(F.col("rule").isNull()).alias("there"), *counts)
    missing = per_key.filter("there = 0").agg(*[F.coalesce(F.sum(f"r{k}"), F.lit(0)).alias(f"r{k}") for k in range(len(rules))])
    rows = F.array(*[F.struct(F.lit(t).alias("tabla"), F.lit(r).alias("regla"), F.col(f"r{k}").alias("n_bad")) for k, (t, r) in enumerate(rules)])
    return missing.select(F.inline(rows))
