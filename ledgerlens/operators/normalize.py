"""Engine results to the stored document: flat fields and the nested normalised document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import field_confidence, flag_warnings, inferred_fields, missing_fields, overall_absent_skipped
from ..functions.money import clamp, map_lines, withholdings
from ..functions.text import unfence_json
from .quality import lines_sum

# schema of the raw engine reply; absent text is '', absent numbers stay NULL
ENGINE_TEXT = (
    "numero_factura", "numero_factura_rectificada", "serie", "tipo_factura", "fecha_emision", "hora_emision",
    "fecha_vencimiento", "fecha_operacion", "emisor_nombre", "emisor_nif", "emisor_direccion", "emisor_cp",
    "emisor_ciudad", "emisor_pais", "receptor_nombre", "receptor_nif", "receptor_direccion", "receptor_cp",
    "receptor_ciudad", "receptor_pais", "moneda", "condiciones_pago", "forma_pago", "cuenta_bancaria",
    "regimen_fiscal", "observaciones",
)
ENGINE_NUMBERS = (
    "base_imponible", "descuento_global", "iva_porcentaje", "iva_cuota", "retencion_porcentaje",
    "retencion_importe", "recargo_porcentaje", "recargo_importe", "total_factura",
)
LINE_SCHEMA = (
    "numero string, referencia string, descripcion string, unidad_medida string, cantidad double, "
    "precio_unitario double, descuento_porcentaje double, descuento_importe double, importe_total double, importe double"
)
ENGINE_SCHEMA = ", ".join(
    [f"{c} string" for c in ENGINE_TEXT] + [f"{c} double" for c in ENGINE_NUMBERS]
    + ["desglose_impuestos array<struct<base_imponible:double,tipo_porcentaje:double,cuota:double>>",
       "lineas array<struct<" + LINE_SCHEMA.replace(" string", ":string").replace(" double", ":double").replace(" ", "") + ">>",
       "_corrupt string"]
)
TRANCHES = "array<struct<base_imponible:double,tipo_porcentaje:double,cuota:double>>"


def parse_document(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Model replies to typed columns with defaults; unreadable replies go to ``corrupt``."""
    parsed = df.withColumn(
        "_d", F.from_json(unfence_json(F.col(raw)), ENGINE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    d = lambda c: F.col(f"_d.{c}")
    line = lambda x: x.withField("importe_total", F.coalesce(x["importe_total"], x["importe"])).dropFields("importe")
    return parsed.select(
        *df.columns,
        *[F.coalesce(d(c), F.lit("EUR" if c == "moneda" else "")).alias(c) for c in ENGINE_TEXT],
        *[d(c).alias(c) for c in ENGINE_NUMBERS],
        F.coalesce(d("desglose_impuestos"), F.array().cast(TRANCHES)).alias("desglose_impuestos"),
        F.transform(F.coalesce(d("lineas"), F.array()), line).alias("lineas"),
        F.when(F.col("_d").isNull() | d("_corrupt").isNotNull(), F.col(raw)).alias("corrupt"),
    )


def _num(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def breakdown_totals(df: DataFrame) -> DataFrame:
    """Base, tax and rate of a document: several tranches are summed and have no single rate, otherwise the
    document's own fields count."""
    several = F.coalesce(F.size("desglose_impuestos"), F.lit(0)) > 1
    total = lambda f: F.round(F.aggregate("desglose_impuestos", F.lit(0.0), lambda s, t: s + _num(t[f])), 6)
    return df.select(
        "*",
        F.when(several, total("base_imponible")).otherwise(_num(F.col("base_imponible"))).alias("base_total"),
        F.when(several, total("cuota")).otherwise(_num(F.col("iva_cuota"))).alias("tax_total"),
        F.when(~several, _num(F.col("iva_porcentaje"))).alias("rate"),
    )


def _party(prefix: str) -> Column:
    c = lambda f: _text(F.col(f"{prefix}_{f}"))
    return F.struct(
        c("nombre").alias("name"), c("nombre").alias("legal_name"), c("nif").alias("tax_id"), c("direccion").alias("address"),
        c("cp").alias("postal_code"), c("ciudad").alias("city"), c("pais").alias("country"),
    )


def invoice_side(side: Column) -> Column:
    return F.when(side == "venta", "emitida").when(side == "compra", "recibida").otherwise("desconocida")


def normalize_vision(df: DataFrame, side: Column, *carried: str) -> DataFrame:
    """Engine columns to flat fields plus ``normalized_document``; ``side`` is the operation side.

    ``carried`` columns of the engine rows go along.
    """
    d = {c: F.col(c) for c in (*ENGINE_TEXT, *ENGINE_NUMBERS)}
    n_lines = F.greatest(F.coalesce(F.size("lineas"), F.lit(0)), F.lit(0))
    conf = field_confidence(d, n_lines, lines_sum(F.col("lineas")), F.coalesce("prompt_tokens", F.lit(0)))
    staged = breakdown_totals(df).withColumn("operation_side", side).withColumn("field_confidence", conf)
    staged = staged.withColumn("confianza", overall_absent_skipped(F.col("field_confidence")))
    regime, kind = _text(F.col("regimen_fiscal")), F.col("tipo_factura")
    tranches = F.transform(
        "desglose_impuestos",
        lambda t: F.struct(
            regime.alias("tax_regime"), _num(t["tipo_porcentaje"]).alias("rate"), _num(t["base_imponible"]).alias("taxable_base"), _num(t["cuota"]).alias("tax_amount")
        ),
    )
    withheld = _num(F.col("retencion_importe"))
    total = _num(F.col("total_factura"))
    document = F.struct(
        F.struct(F.col("confianza").alias("extraction_confidence"), F.lit("vision").alias("extraction_method"), flag_warnings(F.col("field_confidence")).alias("warnings")).alias("document_meta"),
        F.struct(
            kind.alias("document_type"), invoice_side(F.col("operation_side")).alias("invoice_side"),
            F.when(F.col("operation_side") != "unknown", F.col("operation_side")).otherwise("desconocida").alias("operation_kind"),
            F.lower(kind).contains("rectificativ").alias("is_rectificative"),
            (F.lower(kind).contains("simplificad") | F.lower(kind).contains("ticket")).alias("is_simplified"),
        ).alias("classification"),
        F.struct(
            _text(F.col("numero_factura")).alias("invoice_number"), _text(F.col("fecha_emision")).alias("issue_date"),
            _text(F.col("numero_factura_rectificada")).alias("rectified_invoice_number"), _text(F.col("serie")).alias("serie"),
        ).alias("identity"),
        _party("emisor").alias("issuer"),
        _party("receptor").alias("recipient"),
        F.struct(
            F.col("base_total").alias("subtotal"), F.col("tax_total").alias("tax_total"), withheld.alias("withholding_total"),
            total.alias("total"), total.alias("amount_due"),
        ).alias("totals"),
        tranches.alias("tax_breakdown"),
        withholdings(F.col("retencion_porcentaje"), F.col("base_imponible"), F.col("retencion_importe")).alias("withholdings"),
        map_lines(F.col("lineas")).alias("line_items"),
        F.struct(
            *[_text(F.col(c)).alias(c) for c in ("forma_pago", "condiciones_pago", "cuenta_bancaria")],
            F.coalesce(F.nullif(F.col("moneda"), F.lit("")), F.lit("EUR")).alias("moneda"), _text(F.col("fecha_vencimiento")).alias("fecha_vencimiento"),
        ).alias("payment_info"),
        _text(F.col("observaciones")).alias("observaciones"),
        F.lit(True).alias("from_engine"),
    )
    return staged.select(
        "doc_id",
        _text(F.col("numero_factura")).alias("numero_factura"),
        _text(F.col("numero_factura_rectificada")).alias("rectified_invoice_number"),
        _text(F.col("fecha_emision")).alias("fecha"),
        kind.alias("tipo_factura"),
        _text(F.col("emisor_nombre")).alias("proveedor"), _text(F.col("emisor_nif")).alias("cif_proveedor"),
        _text(F.col("receptor_nombre")).alias("cliente"), _text(F.col("receptor_nif")).alias("cif_cliente"),
        F.col("base_total").alias("base_imponible"), F.col("rate").alias("iva_porcentaje"), F.col("tax_total").alias("iva"),
        _num(F.col("retencion_porcentaje")).alias("retencion_porcentaje"), withheld.alias("retencion"), total.alias("total"),
        regime.alias("tax_regime"), "operation_side", "confianza", map_lines(F.col("lineas")).alias("lineas"), "field_confidence",
        missing_fields(F.col("field_confidence")).alias("missing_fields"), inferred_fields(F.col("field_confidence")).alias("inferred_fields"),
        document.alias("normalized_document"),
        *carried,
    )


def flat_document() -> Column:
    """``normalized_document`` built from flat columns alone (fewer details than the engine's own)."""
    col = F.col
    side = _text(col("operation_side"))
    kind = F.coalesce(F.nullif(col("document_type"), F.lit("")), F.nullif(col("tipo_factura"), F.lit("")), F.lit("desconocido"))
    base, tax, total = (_num(col(c)) for c in ("base_imponible", "iva", "total"))
    withheld = F.greatest(F.lit(0.0), _num(col("retencion")))
    tranche = F.struct(
        F.coalesce(F.nullif(col("tax_regime"), F.lit("")), F.lit("UNKNOWN")).alias("tax_regime"),
        _num(col("iva_porcentaje")).alias("rate"), base.alias("taxable_base"), tax.alias("tax_amount"),
    )
    some = (base != 0) | (tax != 0) | (total != 0)
    kinds = "array<struct<tax_regime:string,rate:double,taxable_base:double,tax_amount:double>>"
    party = lambda name, tax_id: F.struct(_text(col(name)).alias("name"), _text(col(name)).alias("legal_name"), _text(col(tax_id)).alias("tax_id"))
    return F.struct(
        F.struct(F.coalesce("confianza", F.lit(0.0)).alias("extraction_confidence")).alias("document_meta"),
        F.struct(
            kind.alias("document_type"), invoice_side(side).alias("invoice_side"),
            F.coalesce(F.nullif(side, F.lit("")), F.lit("desconocida")).alias("operation_kind"),
            kind.contains("rectificativ").alias("is_rectificative"), (kind.contains("simplificad") | kind.contains("ticket")).alias("is_simplified"),
        ).alias("classification"),
        F.struct(
            _text(col("numero_factura")).alias("invoice_number"), _text(col("fecha")).alias("issue_date"),
            _text(col("rectified_invoice_number")).alias("rectified_invoice_number"),
        ).alias("identity"),
        party("proveedor", "cif_proveedor").alias("issuer"),
        party("cliente", "cif_cliente").alias("recipient"),
        F.struct(base.alias("subtotal"), tax.alias("tax_total"), withheld.alias("withholding_total"), total.alias("total"), total.alias("amount_due")).alias("totals"),
        F.when(some, F.array(tranche)).otherwise(F.array()).cast(kinds).alias("tax_breakdown"),
        withholdings(col("retencion_porcentaje"), base, withheld).alias("withholdings"),
        F.lit(False).alias("from_engine"),
    )


def normalize_flat(df: DataFrame) -> DataFrame:
    return df.withColumn("normalized_document", flat_document())


def persistence_row(df: DataFrame) -> DataFrame:
    """Columns for the relational store; magnitudes it cannot hold become NULL."""
    big, small = 9999999999, 999
    return df.select(
        "doc_id",
        F.nullif(F.col("numero_factura"), F.lit("")).alias("numero_factura"),
        F.coalesce(F.nullif(F.col("tipo_factura"), F.lit("")), F.lit("compra")).alias("tipo"),
        F.nullif(F.col("fecha"), F.lit("")).alias("fecha"),
        clamp(F.col("base_imponible"), big).alias("base_imponible"),
        clamp(F.col("iva_porcentaje"), small).alias("iva_porcentaje"),
        clamp(F.col("iva"), big).alias("iva_importe"),
        clamp(F.col("total"), big).alias("total"),
        F.col("confianza").alias("confianza_ia"),
        F.lit("PENDIENTE_REVISION").alias("estado"),
    )


# fixed values: keys of the audit detail and what stands in for an absent one
AUDIT_DETAIL_KEYS = {
    "job_id": None, "provider": None, "method": None, "tipo_factura": None, "confianza": None, "warnings": "[]",
    "document_input": None, "coverage": None, "field_confidence": "{}", "normalized_document": None, "evidence": "{}",
    "decision_flags": "[]", "company_match": None, "processing_trace": "[]", "contract": None, "engine_request": None,
    "operation_side": None, "tax_regime": None,
}


def audit_detail(df: DataFrame) -> DataFrame:
    """``detalle_json`` with all keys present, NULL or empty where the result has nothing."""
    defaults = {"[]": F.array().cast("array<string>"), "{}": F.create_map().cast("map<string,double>")}
    parts = []
    for key, default in AUDIT_DETAIL_KEYS.items():
        if key in df.columns:
            value = F.col(key) if default is None else F.coalesce(F.col(key), defaults[default])
        else:
            value = F.lit(None).cast("string") if default is None else defaults[default]
        parts.append(value.alias(key))
    return df.withColumn("detalle_json", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def tax_label(regime: Column, first_tranche: Column, classified: Column) -> Column:
    """Name of the tax on screen: the document's regime, else that of its first tranche, else of its
    classification."""
    name = F.upper(F.coalesce(*[F.nullif(c, F.lit("")) for c in (regime, first_tranche, classified)]))
    return F.when(name.isin("IGIC", "IVA"), name).otherwise("Impuesto")
