"""Sides, counterparties and the stored document, over engine results derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import business as B
from ..operators import normalize as NZ
from ..operators.extraction.assemble import side_by_ids
from ..sources.engine import engine
from .quality import CENTS, ENG, SIDE, _OURS, _THEIRS
from .prelude import with_views
from .registry import query

_PARTS = ("emisor_nif", "receptor_nif", "emisor_nombre", "receptor_nombre", "company_tax_id", "company_name")


def _sql(sql: str, **extra: str) -> str:
    return with_views(sql, cents=CENTS, eng=ENG, **extra)


def _sided(d, *carried):
    side = B.side_by_ids_and_names(*[F.col(c) for c in _PARTS])
    return NZ.normalize_vision(engine(d), side, *carried)


@query("operation_side_ids", _sql(
    f"""SELECT k AS doc_id, CASE WHEN k%41=0 THEN '' WHEN emisor_nif={_OURS} THEN 'venta' WHEN receptor_nif={_OURS} THEN 'compra' WHEN emisor_nif<>'' THEN 'compra' ELSE '' END AS side FROM eng"""))
def operation_side_ids(d):
    own = F.when(F.col("doc_id") % 41 != 0, F.array(F.lower("company_tax_id"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return engine(d).select("doc_id", side_by_ids(F.col("emisor_nif"), F.col("receptor_nif"), own).alias("side"))


@query("operation_side_names", _sql(f"SELECT k AS doc_id, {SIDE} AS side FROM eng"))
def operation_side_names(d):
    return engine(d).select("doc_id", B.side_by_ids_and_names(*[F.col(c) for c in _PARTS]).alias("side"))


@query("normalized_document", _sql(
    f"""SELECT k AS doc_id, CASE side WHEN 'venta' THEN 'emitida' WHEN 'compra' THEN 'recibida' ELSE 'desconocida' END AS invoice_side, tipo='factura_rectificativa' AS is_rectificative, tipo='ticket' AS is_simplified,
    numero AS invoice_number, emisor AS issuer_name, emisor_nif AS issuer_id, receptor AS recipient_name, (CASE WHEN tranches>1 THEN base ELSE coalesce(b,0) END)/100 AS subtotal, tax/100 AS tax_total, ret/100 AS withholding_total,
    tranches AS n_tranches, n_lines, (ret>0)::INT AS n_withholdings, 'EUR' AS moneda FROM (SELECT *, {SIDE} AS side FROM eng)"""))
def normalized_document(d):
    n = lambda p: F.col(f"normalized_document.{p}")
    return _sided(d).select(
        "doc_id", n("classification.invoice_side"), n("classification.is_rectificative"), n("classification.is_simplified"), n("identity.invoice_number"),
        n("issuer.name").alias("issuer_name"), n("issuer.tax_id").alias("issuer_id"), n("recipient.name").alias("recipient_name"),
        F.round(n("totals.subtotal"), 2).alias("subtotal"), F.round(n("totals.tax_total"), 2).alias("tax_total"), n("totals.withholding_total"),
        F.size(n("tax_breakdown")).alias("n_tranches"), F.size(n("line_items")).alias("n_lines"), F.size(n("withholdings")).alias("n_withholdings"), n("payment_info.moneda"))


@query("flat_document", _sql(
    f"""SELECT k AS doc_id, CASE side WHEN 'venta' THEN 'emitida' WHEN 'compra' THEN 'recibida' ELSE 'desconocida' END AS invoice_side, side AS operation_kind, CASE WHEN k%2=0 THEN 'IVA' ELSE 'IGIC' END AS regime,
    CASE WHEN tranches>1 THEN 0 WHEN k%4<>0 THEN 21 ELSE 0 END::DOUBLE AS rate, total/100 AS amount_due, (ret>0)::INT AS n_withholdings FROM (SELECT *, {SIDE} AS side FROM eng)"""))
def flat_document(d):
    flat = NZ.normalize_flat(_sided(d).withColumn("document_type", F.lit(None).cast("string")))
    n = lambda p: F.col(f"normalized_document.{p}")
    t = F.get(n("tax_breakdown"), F.lit(0))
    return flat.select("doc_id", n("classification.invoice_side"), n("classification.operation_kind"), t["tax_regime"].alias("regime"), t["rate"].alias("rate"),
                       n("totals.amount_due"), F.size(n("withholdings")).alias("n_withholdings"))


@query("persistence_rows", _sql(
    """SELECT k AS doc_id, nullif(numero,'') AS numero_factura, tipo, nullif(fecha,'') AS fecha, CASE WHEN k%53=0 THEN NULL ELSE (CASE WHEN tranches>1 THEN base ELSE coalesce(b,0) END)/100 END AS base_imponible,
    total/100 AS total, 'PENDIENTE_REVISION' AS estado FROM eng"""))
def persistence_rows(d):
    huge = F.when(F.col("doc_id") % 53 == 0, 1e12).otherwise(F.col("base_imponible"))
    rows = NZ.persistence_row(_sided(d).withColumn("base_imponible", huge))
    return rows.select("doc_id", "numero_factura", "tipo", "fecha", F.round("base_imponible", 2).alias("base_imponible"), "total", "estado")


@query("audit_details", _sql(f"SELECT k AS doc_id, 18 AS n_keys, side AS operation_side, tipo AS tipo_factura, '[]' AS decision_flags FROM (SELECT *, {SIDE} AS side FROM eng)"))
def audit_details(d):
    a = NZ.audit_detail(_sided(d))
    j = lambda p: F.get_json_object("detalle_json", p)
    return a.select("doc_id", F.size(F.json_object_keys("detalle_json")).alias("n_keys"), j("$.operation_side").alias("operation_side"),
                    j("$.tipo_factura").alias("tipo_factura"), j("$.decision_flags").alias("decision_flags"))


@query("json_documents", _sql(
    """SELECT k AS doc_id, k%9=4 AS corrupt, CASE WHEN k%9=4 THEN '' ELSE numero END AS numero_factura, CASE WHEN k%9<>4 THEN b/100 END AS base_imponible, CASE WHEN k%9=4 THEN 0 ELSE n_lines END AS n_lines, 'EUR' AS moneda,
    CASE WHEN k%9<>4 AND n_lines>0 THEN l1/100 END AS first_amount FROM eng"""))
def json_documents(d):
    """Replies written as fenced JSON with old field names, read back with defaults; broken ones quarantined."""
    e = engine(d)
    lines = F.transform("lineas", lambda x: F.struct(x["descripcion"], x["cantidad"], x["importe_total"].alias("importe")))
    body = F.to_json(F.struct("numero_factura", "base_imponible", lines.alias("lineas"), F.lit("pienso").alias("_razonamiento")))
    raw = F.when(F.col("doc_id") % 9 == 4, F.substring(body, 1, 15)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    p = NZ.parse_document(e.select("doc_id", raw.alias("raw")))
    return p.select("doc_id", F.col("corrupt").isNotNull().alias("corrupt"), "numero_factura", "base_imponible", F.size("lineas").alias("n_lines"), "moneda",
                    F.get("lineas", F.lit(0))["importe_total"].alias("first_amount"))


def _linked(d):
    """Engine results with the linked client; sides left open for half of them."""
    sided = _sided(d, "company_name", "company_tax_id").withColumn("cliente_id", F.col("doc_id"))
    open_side = F.col("doc_id") % 2 == 0
    doc = F.col("normalized_document")
    blank = doc["classification"].withField("operation_kind", F.lit("desconocida")).withField("invoice_side", F.lit("desconocida"))
    return sided.withColumn("operation_side", F.when(open_side, "unknown").otherwise(F.col("operation_side"))).withColumn(
        "normalized_document", doc.withField("classification", F.when(open_side, blank).otherwise(doc["classification"]))
    ).withColumn(B.LINKED_NAME, F.col("company_name")).withColumn(B.LINKED_ID, F.col("company_tax_id"))


# does a party pass as the linked client: by id or by name
_LINK = f"""SELECT *, {SIDE} AS stated, (emisor_nif={_OURS} OR k%3=0) AS iss, (receptor_nif={_OURS} OR k%3<>0) AS rcv FROM eng"""
_TYPE = """SELECT *, CASE WHEN k%2<>0 AND stated IN ('venta','compra') THEN stated WHEN iss AND NOT rcv THEN 'venta' WHEN rcv AND NOT iss THEN 'compra' ELSE 'compra' END AS side FROM link"""
_CP = f"""SELECT *, CASE WHEN side='venta' AND NOT rcv AND (receptor<>'' OR receptor_nif<>'') THEN receptor WHEN side='venta' AND emisor<>'' AND k%3<>0 THEN emisor
    WHEN side='compra' AND NOT iss AND (emisor<>'' OR emisor_nif<>'') THEN emisor WHEN side='compra' AND emisor<>'' AND k%3<>0 THEN emisor END AS cp_name,
    CASE WHEN side='venta' AND NOT rcv AND (receptor<>'' OR receptor_nif<>'') THEN receptor_nif WHEN side='venta' AND emisor<>'' AND k%3<>0 THEN ''
    WHEN side='compra' AND NOT iss AND (emisor<>'' OR emisor_nif<>'') THEN emisor_nif WHEN side='compra' AND emisor<>'' AND k%3<>0 THEN '' END AS cp_id FROM typ"""


@query("infer_side", _sql("SELECT k AS doc_id, side FROM typ", link=_LINK, typ=_TYPE))
def infer_side(d):
    """The flat ``tipo_factura`` of an engine result names the document kind, never a side."""
    linked = _linked(d)
    return linked.select("doc_id", B.infer_side(linked).alias("side"))


@query("counterparty", _sql("SELECT k AS doc_id, cp_name AS name, cp_id AS tax_id FROM cp", link=_LINK, typ=_TYPE, cp=_CP))
def counterparty(d):
    linked = _linked(d)
    typed = linked.withColumn("_side", B.infer_side(linked))
    return typed.select("doc_id", B.counterparty(F.col("_side")).alias("c")).select("doc_id", "c.name", "c.tax_id")


@query("adapted_results", _sql(
    f"""SELECT k AS doc_id, side AS tipo_factura, CASE WHEN side='venta' THEN 'Comercial '||cust||', S.A.' ELSE coalesce(nullif(cp_name,''),emisor) END AS proveedor,
    CASE WHEN side='venta' THEN {_OURS} ELSE coalesce(nullif(cp_id,''),emisor_nif) END AS cif_proveedor,
    CASE WHEN side='venta' THEN coalesce(nullif(cp_name,''),receptor) ELSE 'Comercial '||cust||', S.A.' END AS cliente,
    CASE WHEN side='venta' THEN 'emitida' ELSE 'recibida' END AS invoice_side, greatest(0,ret)/100 AS withheld, total/100 AS amount_due FROM cp""", link=_LINK, typ=_TYPE, cp=_CP))
def adapted_results(d):
    """Engine result to stored result for every invoice."""
    a = B.adapt(_linked(d))
    return a.select("doc_id", "tipo_factura", "proveedor", "cif_proveedor", "cliente", F.col("normalized_document.classification.invoice_side").alias("invoice_side"),
                    F.col("normalized_document.totals.withholding_total").alias("withheld"), F.col("normalized_document.totals.amount_due").alias("amount_due"))


@query("counterparty_refresh", _sql(
    """SELECT k AS doc_id, CASE k%4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS refresh FROM eng"""))
def counterparty_refresh(d):
    """Stored name is the client's own, generic, another company's, or the same as the new one."""
    k = F.col("doc_id") % 4
    stored = F.when(k == 0, F.col("company_name")).when(k == 1, "Proveedor").when(k == 2, "Otra Casa").otherwise("nuevo proveedor, s.l.")
    e = engine(d)
    none = F.lit(None).cast("string")
    return e.select("doc_id", B.needs_refresh(stored, none, F.lit("Nuevo Proveedor S.L."), none, F.col("company_name"), F.col("company_tax_id")).alias("refresh"))


@query("tax_labels", _sql("SELECT k AS doc_id, CASE WHEN k%3=0 THEN CASE WHEN k%2=0 THEN 'IVA' ELSE 'IGIC' END ELSE 'Impuesto' END AS label FROM eng"))
def tax_labels(d):
    regime = F.when(F.col("doc_id") % 3 == 0, F.lower("regimen_fiscal")).otherwise("")
    first = F.when(F.col("doc_id") % 3 == 1, F.lit("exento"))
    return engine(d).select("doc_id", NZ.tax_label(regime, first, F.lit(None).cast("string")).alias("label"))


@query("review_drafts", _sql(
    """SELECT k AS doc_id, CASE WHEN k%2=0 THEN CASE WHEN numero='' THEN NULL ELSE numero END ELSE numero END AS numero_factura, CASE WHEN k%2=0 THEN (CASE WHEN tranches>1 THEN base ELSE coalesce(b,0) END+100)/100 ELSE (CASE WHEN tranches>1 THEN base ELSE coalesce(b,0) END)/100 END AS base_imponible,
    CASE WHEN k%2=0 THEN NULL ELSE total/100 END AS total, CASE WHEN k%2=0 THEN 1 ELSE n_lines END AS n_lines FROM eng"""))
def review_drafts(d):
    """Drafts for every other invoice: comma decimals, a blank total, one kept and one empty line."""
    from ..operators.patch import apply_draft

    docs = _sided(d).withColumnRenamed("doc_id", "id")
    comma = F.replace(((F.round(F.col("base_imponible") * 100).cast("bigint") + 100) / 100).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    line = lambda name, q, s: F.struct(F.lit(name).alias("descripcion"), F.lit(q).alias("cantidad"), F.lit(" ").alias("precio_unitario"), F.lit(s).alias("subtotal"))
    drafts = docs.filter("id % 2 = 0").select(
        "id", F.concat(F.lit(" "), "numero_factura").alias("numero_factura"), F.lit("").alias("tipo"), "fecha", F.col("proveedor").alias("proveedor_nombre"),
        F.col("cif_proveedor").alias("proveedor_cif"), comma.alias("base_imponible"), F.lit("21").alias("iva_porcentaje"), F.lit("x").alias("iva_importe"), F.lit(" ").alias("total"),
        F.array(line("Servicio", "1,5", "2"), line("  ", "", "")).alias("lineas"))
    out = apply_draft(docs, drafts)
    return out.select(F.col("id").alias("doc_id"), "numero_factura", F.round("base_imponible", 2).alias("base_imponible"), "total", F.size("lineas").alias("n_lines"))
