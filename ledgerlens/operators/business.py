"""Side of an operation, counterparty, and the adapter that fits engine results to the client they belong to.

Frames carry the flat result columns, ``normalized_document`` and the linked client's ``cliente_nombre_vinculado``
and ``cliente_cif_vinculado``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.money import withholdings
from ..functions.taxid import clean_tax_id
from ..functions.text import normalize_for_side, normalize_name
from .normalize import invoice_side
from .extraction.common import pin
from .parties import same_party

LINKED_NAME, LINKED_ID = "cliente_nombre_vinculado", "cliente_cif_vinculado"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(*cs: Column) -> Column:
    """First value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def side_by_ids_and_names(issuer_id, recipient_id, issuer_name, recipient_name, company_id, company_name) -> Column:
    """Side from the tax ids; where the company's name stands with the other party the ids were swapped."""
    own = clean_tax_id(company_id)
    issues = (own != "") & (clean_tax_id(issuer_id) == own)
    receives = (own != "") & (clean_tax_id(recipient_id) == own)
    company = normalize_for_side(company_name)

    def named(party: Column) -> Column:
        other = normalize_for_side(party)
        return (company != "") & (other != "") & (other.contains(company) | company.contains(other))

    in_issuer, in_recipient = named(issuer_name), named(recipient_name)
    return (
        F.when(own == "", "unknown")
        .when(issues & in_recipient & ~in_issuer, "compra")
        .when(receives & in_issuer & ~in_recipient, "venta")
        .when(issues, "venta")
        .when(receives, "compra")
        .otherwise("unknown")
    )


def _party(role: str) -> tuple[Column, Column]:
    flat = {"issuer": ("proveedor", "cif_proveedor"), "recipient": ("cliente", "cif_cliente")}[role]
    nested = F.col("normalized_document")[role]
    return _or(nested["name"], F.col(flat[0])), _or(nested["tax_id"], F.col(flat[1]))


def _is_company(name: Column, tax_id: Column) -> Column:
    return same_party(name, tax_id, F.col(LINKED_NAME), F.col(LINKED_ID))


def _settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column that later steps read often; its value is computed once per row."""
    kept = [c for c in df.columns if c != name]
    return pin(df, _value=value).select(*kept, F.col("_value").alias(name))


def align_parties(df: DataFrame) -> DataFrame:
    """A party that is the linked client and lacks name or tax id takes both from the client."""
    out = F.col("normalized_document")
    for role in ("issuer", "recipient"):
        name, tax_id = _party(role)
        nested = F.col("normalized_document")[role]
        fill = _is_company(name, tax_id) & ((_text(nested["name"]) == "") | (_text(nested["tax_id"]) == ""))
        filled = nested.withField("name", _or(F.col(LINKED_NAME), name)).withField(
            "legal_name", _or(F.col(LINKED_NAME), name)
        ).withField("tax_id", _or(F.col(LINKED_ID), tax_id))
        out = out.withField(role, F.when(fill, filled).otherwise(nested))
    return _settle(df, "normalized_document", out)


def infer_side(df: DataFrame) -> Column:
    """Purchase or sale: stated side, document kind, document side, matched role, the linked client among the
    parties, the result's own type, else purchase."""
    doc = F.col("normalized_document.classification")
    optional = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    known = lambda c: F.when(c.isin("venta", "compra"), c)
    issuer, recipient = _is_company(*_party("issuer")), _is_company(*_party("recipient"))
    return F.coalesce(
        known(F.col("operation_side")),
        known(doc["operation_kind"]),
        F.when(doc["invoice_side"] == "emitida", "venta").when(doc["invoice_side"] == "recibida", "compra"),
        F.when(optional("matched_role") == "issuer", "venta").when(optional("matched_role") == "recipient", "compra"),
        F.when(issuer & ~recipient, "venta").when(recipient & ~issuer, "compra"),
        known(_or(optional("tipo_factura"), optional("tipo"))),
        F.lit("compra"),
    )


def counterparty(side: Column) -> Column:
    """The party that is not the linked client, NULL when there is none.

    The document's party comes first, then the flat fields; where neither serves, an issuer whose name is not
    the client's is taken by name only (its tax id may be the client's, misplaced)."""
    issuer, recipient = _party("issuer"), _party("recipient")
    pair = lambda name, tax_id: F.struct(_text(name).alias("name"), _text(tax_id).alias("tax_id"))

    def usable(name: Column, tax_id: Column) -> Column:
        return ~_is_company(name, tax_id) & ((_text(name) != "") | (_text(tax_id) != ""))

    by_name = (issuer[0] != "") & ~_is_company(issuer[0], F.lit(""))

    def choose(nested, flat):
        return (
            F.when(usable(*nested), pair(*nested))
            .when(usable(*flat), pair(*flat))
            .when(by_name, pair(issuer[0], F.lit("")))
        )

    return F.when(side == "venta", choose(recipient, (F.col("cliente"), F.col("cif_cliente")))).when(
        side == "compra", choose(issuer, (F.col("proveedor"), F.col("cif_proveedor")))
    )


def synchronize(df: DataFrame) -> DataFrame:
    """Flat fields and document agree with the side in ``tipo_factura`` and with ``counterparty``.

    Engine documents that name both parties are only completed; others are overwritten."""
    sale = F.col("tipo_factura") == "venta"
    other_name, other_id = F.col("counterparty.name"), F.col("counterparty.tax_id")
    ours_name, ours_id = F.col(LINKED_NAME), F.col(LINKED_ID)
    flat = {
        "proveedor": F.when(sale, _or(ours_name, F.col("proveedor"))).otherwise(_or(other_name, F.col("proveedor"))),
        "cif_proveedor": F.when(sale, _or(ours_id, F.col("cif_proveedor"))).otherwise(_or(other_id, F.col("cif_proveedor"))),
        "cliente": F.when(sale, _or(other_name, F.col("cliente"))).otherwise(_or(ours_name, F.col("cliente"))),
        "cif_cliente": F.when(sale, _or(other_id, F.col("cif_cliente"))).otherwise(_or(ours_id, F.col("cif_cliente"))),
    }
    df = df.select(*[flat[c].alias(c) if c in flat else F.col(c) for c in df.columns])
    doc = F.col("normalized_document")
    ours = (_text(F.col(LINKED_NAME)), _text(F.col(LINKED_ID)))
    issuer_now = tuple(F.when(sale, a).otherwise(F.col(b)) for a, b in zip(ours, ("proveedor", "cif_proveedor")))
    recipient_now = tuple(F.when(sale, F.col(b)).otherwise(a) for a, b in zip(ours, ("cliente", "cif_cliente")))
    present = lambda p: (_text(p["name"]) != "") | (_text(p["tax_id"]) != "")
    complete = doc["from_engine"] & present(doc["issuer"]) & present(doc["recipient"])

    def fitted(nested: Column, now) -> Column:
        patch = lambda f, v: F.when(complete, _or(nested[f], v)).otherwise(_text(v))
        return nested.withField("name", patch("name", now[0])).withField("legal_name", patch("legal_name", now[0])).withField(
            "tax_id", patch("tax_id", now[1])
        )

    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    withheld = F.greatest(F.lit(0.0), num("retencion"))
    identity = doc["identity"]
    totals = F.struct(
        num("base_imponible").alias("subtotal"), num("iva").alias("tax_total"), withheld.alias("withholding_total"),
        num("total").alias("total"), num("total").alias("amount_due"),
    )
    out = (
        doc.withField("issuer", fitted(doc["issuer"], issuer_now))
        .withField("recipient", fitted(doc["recipient"], recipient_now))
        .withField("identity", identity.withField("invoice_number", _or(F.col("numero_factura"), identity["invoice_number"]))
                   .withField("issue_date", _or(F.col("fecha"), identity["issue_date"]))
                   .withField("rectified_invoice_number", _or(F.col("rectified_invoice_number"), identity["rectified_invoice_number"])))
        .withField("classification", doc["classification"].withField("invoice_side", F.when(sale, "emitida").otherwise("recibida"))
                   .withField("operation_kind", F.when(sale, "venta").otherwise("compra")))
        .withField("totals", totals)
        .withField("withholdings", withholdings(F.col("retencion_porcentaje"), F.col("base_imponible"), withheld))
    )
    return df.withColumn("normalized_document", out)


def adapt(results: DataFrame) -> DataFrame:
    """Align parties, decide the side, find the counterparty, synchronise.

    Each decision is settled once per row before the next one reads it."""
    aligned = align_parties(results)
    sided = _settle(aligned, "tipo_factura", infer_side(aligned))
    return synchronize(_settle(sided, "counterparty", counterparty(F.col("tipo_factura"))))


def needs_refresh(stored_name, stored_id, new_name, new_id, company_name, company_id) -> Column:
    """Whether a stored counterparty should take the newly read name: the stored one is really the client, or
    is nameless or generic."""
    old, new = normalize_name(stored_name), normalize_name(new_name)
    changed = new.isNotNull() & ~old.eqNullSafe(new)
    was_company = same_party(stored_name, stored_id, company_name, company_id)
    is_company = same_party(new_name, new_id, company_name, company_id)
    generic = old.isNull() | old.isin(*K.GENERIC_PARTY_NAMES)
    return changed & ((was_company & ~is_company) | generic)


__all__ = [
    "adapt", "align_parties", "counterparty", "infer_side", "invoice_side", "needs_refresh",
    "side_by_ids_and_names", "synchronize",
]
