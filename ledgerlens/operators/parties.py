"""Entity resolution of clients and suppliers, company matching, own tax ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxid import clean_tax_id
from ..functions.text import normalize_name
from ..session import cut_lineage
from .windows import number_rows


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _distinct_parties(parties: DataFrame, scope: list[str]) -> DataFrame:
    """Each (name, cif) of a scope once, with its first and last position.  Collapsing first means that a
    party named in a third of all documents is one row from here on."""
    return parties.groupBy(*scope, "nombre", _blank_to_null(F.col("cif")).alias("cif")).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    ).withColumn("norm", normalize_name(F.col("nombre")))


def _key_of_new(unmatched: DataFrame, scope: list[str]) -> DataFrame:
    """Group key of parties nobody knows yet: rows with one cif share the smallest of their names, and
    parties with one name are one party; without a name the cif is the key."""
    named = unmatched.filter("cif is not null").groupBy(*scope, "cif").agg(F.min("norm").alias("_cif_name"))
    # parties without a cif would all share one join key: they pass beside the join
    without = unmatched.filter("cif is null").withColumn("_cif_name", F.lit(None).cast("string"))
    keyed = unmatched.filter("cif is not null").join(named, [*scope, "cif"], "left").unionByName(without)
    own = F.coalesce("_cif_name", "norm", F.concat(F.lit("cif:"), F.col("cif")), F.lit("?"))
    return keyed.withColumn("_key", F.concat_ws("|", *[F.col(c).cast("string") for c in scope], own)).drop("_cif_name")


def _match(parties: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """Known id by cif, else by normalised name; equal keys go to the smallest id."""
    by_cif = known.filter("cif is not null").groupBy(*scope, "cif").agg(F.min("id").alias("_by_cif"))
    by_name = known.withColumn("norm", normalize_name(F.col("nombre"))).filter("norm is not null").groupBy(
        *scope, "norm"
    ).agg(F.min("id").alias("_by_name"))
    without = parties.filter("cif is null").withColumn("_by_cif", F.lit(None).cast("bigint"))
    matched = parties.filter("cif is not null").join(by_cif, [*scope, "cif"], "left").unionByName(without)
    return matched.join(by_name, [*scope, "norm"], "left")


def _with_new_ids(matched: DataFrame, known: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    found = F.coalesce("_by_cif", "_by_name")
    unmatched = _key_of_new(matched.filter(found.isNull()), scope)
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    keys = unmatched.select("_key").distinct()
    created = number_rows(keys, "_key", top, "_new_id")
    fresh = unmatched.join(created, "_key")
    old = matched.filter(found.isNotNull()).withColumn("_id", found)
    return old, fresh


def resolve_clients(parties: DataFrame, clients: DataFrame) -> DataFrame:
    """Client id for each distinct party ``(asesoria_id, nombre, cif)``; ``is_new`` marks those to insert.

    Two equi-joins against known clients; unknown parties are grouped so that one new party is made once."""
    scope = ["asesoria_id"]
    known = clients.select(*scope, "id", "nombre", "cif")
    # read four times below; distinct parties are few next to the documents they come from
    matched = cut_lineage(_match(_distinct_parties(parties, scope), known, scope))
    old, fresh = _with_new_ids(matched, clients, scope)
    cols = [*scope, "nombre", "cif"]
    return old.select(*cols, F.col("_id").alias("cliente_id"), F.lit(False).alias("is_new")).unionByName(
        fresh.select(*cols, F.col("_new_id").alias("cliente_id"), F.lit(True).alias("is_new"))
    )


def resolve_suppliers(parties: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supplier id per distinct party, and the suppliers after the batch.

    A match by cif takes over a changed name (the last party of the batch wins), a match by name fills a
    missing cif (the first party wins), the rest are new suppliers."""
    known = suppliers.select("id", "nombre", "cif")
    matched = cut_lineage(_match(_distinct_parties(parties, []), known, []))
    old, fresh = _with_new_ids(matched, known, [])
    mapping = old.select("nombre", "cif", F.col("_id").alias("proveedor_id"), F.lit(False).alias("is_new")).unionByName(
        fresh.select("nombre", "cif", F.col("_new_id").alias("proveedor_id"), F.lit(True).alias("is_new"))
    )
    renames = old.filter(F.col("_by_cif").isNotNull() & F.col("norm").isNotNull()).groupBy(
        F.col("_by_cif").alias("id")
    ).agg(F.max_by(F.struct("nombre", "norm"), "last_seq").alias("_to"))
    fills = old.filter(F.col("_by_cif").isNull() & F.col("cif").isNotNull()).groupBy(
        F.col("_by_name").alias("id")
    ).agg(F.min_by("cif", "first_seq").alias("_cif"))
    changed = ~normalize_name(F.col("nombre")).eqNullSafe(F.col("_to.norm"))
    updated = known.join(renames, "id", "left").join(fills, "id", "left").select(
        "id",
        F.when(F.col("_to").isNotNull() & changed, F.col("_to.nombre")).otherwise(F.col("nombre")).alias("nombre"),
        F.coalesce("cif", "_cif").alias("cif"),
    )
    created = fresh.groupBy(F.col("_new_id").alias("id")).agg(
        F.min_by("nombre", "first_seq").alias("nombre"),
        F.min_by("cif", F.when(F.col("cif").isNotNull(), F.col("first_seq"))).alias("cif"),
    )
    return mapping, updated.unionByName(created)


def same_party(name: Column, tax_id: Column, company_name: Column, company_id: Column) -> Column:
    """Equal tax ids after cleaning, or equal normalised names."""
    ids = (clean_tax_id(tax_id) != "") & (clean_tax_id(tax_id) == clean_tax_id(company_id))
    names = F.coalesce(normalize_name(name) == normalize_name(company_name), F.lit(False))
    return ids | names


def match_company(parties: DataFrame, linked: DataFrame) -> DataFrame:
    """Whether each detected party ``(doc_id, role, name, tax_id)`` is the company its document belongs to."""
    return parties.join(linked.select("doc_id", "cliente_nombre", "cliente_cif"), "doc_id").select(
        "doc_id", "role",
        same_party(F.col("name"), F.col("tax_id"), F.col("cliente_nombre"), F.col("cliente_cif")).alias("matched"),
    )


def own_tax_ids(clients: DataFrame, extra: list[str]) -> DataFrame:
    """Tax ids that count as the company itself: its own and the configured extra ones, distinct."""
    more = F.array(*[F.lit(x) for x in extra]).cast("array<string>")
    own = F.filter(F.array("cif"), lambda x: x.isNotNull() & (x != ""))
    return clients.select(F.col("id").alias("cliente_id"), F.array_union(own, more).alias("tax_ids"))
