"""Confidence values: weighted means, tiers, flags over field -> confidence maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _millionths(c: Column) -> Column:
    return F.floor(F.coalesce(c, F.lit(0.0)) * 1000000 + 0.5).cast("bigint")


def overall_absent_zero(conf: Column) -> Column:
    """Weighted mean where an absent field counts as 0; two decimals."""
    # millionths times hundredths: whole numbers, so that halves round alike everywhere
    total = F.lit(0).cast("bigint")
    for f, w in K.WEIGHTS_ABSENT_ZERO.items():
        total = total + _millionths(conf[f]) * F.lit(round(float(w) * 100))
    return F.floor((total + 500000) / 1000000) / 100


def overall_absent_skipped(conf: Column) -> Column:
    """Weighted mean over the fields that are present, critical fields always counted; capped, four decimals."""
    # millionths times tenths
    weighted, weights = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for f, w in K.WEIGHTS_ABSENT_SKIPPED.items():
        value = _millionths(conf[f])
        weight = F.lit(round(float(w) * 10))
        counts = F.lit(True) if f in K.CRITICAL_FIELDS else value > 0
        weighted = weighted + F.when(counts, value * weight).otherwise(0)
        weights = weights + F.when(counts, weight).otherwise(0)
    mean = F.floor((weighted * 2 + weights * 100) / (weights * 200))
    return F.least(mean / 10000, F.lit(float(K.CONFIDENCE_CAP)))


def merge_maps(*maps: Column) -> Column:
    """Later maps win, NULL values are dropped; works under either map key policy."""
    entries = F.concat(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:double>>")) for m in maps])
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda e: e["key"]))
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.element_at(F.filter(kept, lambda e: e["key"] == k), -1)["value"])
    )


def missing_fields(conf: Column) -> Column:
    return F.map_keys(F.map_filter(conf, lambda _, v: v == 0))


def inferred_fields(conf: Column) -> Column:
    return F.map_keys(F.map_filter(conf, lambda _, v: (v != 0) & (v < 0.80)))


def flag_warnings(conf: Column) -> Column:
    return F.concat(
        F.transform(missing_fields(conf), lambda f: F.concat(F.lit("missing:"), f)),
        F.transform(inferred_fields(conf), lambda f: F.concat(F.lit("inferred:"), f)),
    )


def weak_fields(conf: Column, threshold: float = 0.5) -> Column:
    fillable = F.array(*[F.lit(f) for f in K.FILLABLE_FIELDS])
    return F.map_keys(F.map_filter(conf, lambda k, v: (v < threshold) & F.array_contains(fillable, k)))


def weakest_fields(conf: Column, document_type: Column, n: int = 5) -> Column:
    """First ``n`` fields under 0.70; tickets may lack the optional ones."""
    optional = F.array(*[F.lit(f) for f in K.TICKET_OPTIONAL_FIELDS])
    low = F.map_filter(
        conf,
        lambda k, v: (v < 0.70) & ~(document_type.isin(*K.TICKET_TYPES) & F.array_contains(optional, k)),
    )
    return F.transform(F.slice(F.map_keys(low), 1, n), lambda f: F.replace(f, F.lit("_"), F.lit(" ")))


def confidence_tier(c: Column) -> Column:
    percent = F.when(c <= 1, c * 100).otherwise(c)
    return F.when(percent >= 90, "high").when(percent >= 70, "medium").when(percent.isNotNull(), "low")


def suspicious(c: Column) -> Column:
    return F.coalesce(c < 0.85, F.lit(False))


def id_confidence(c: Column) -> Column:
    """0 when absent, .94 in a usual format, .70 otherwise."""
    v = F.upper(F.regexp_replace(c, r"(?U)[\s\-]", ""))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0.0)
        .when(v.rlike(K.LOOSE_ID_FORMAT) | v.rlike(K.NIF_FORMAT), 0.94)
        .otherwise(0.70)
    )


def _has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def field_confidence(d: dict[str, Column], line_count: Column, line_sum: Column, prompt_tokens: Column) -> Column:
    """Field -> confidence of an engine document: presence, format, coherence of totals and lines, and a
    small discount when the extraction needed retries."""
    number = {k: F.coalesce(d[k].cast("double"), F.lit(0.0)) for k in (
        "base_imponible", "iva_cuota", "total_factura", "retencion_importe", "recargo_importe")}
    total = number["total_factura"]
    diff = F.round(
        F.abs(number["base_imponible"] + number["iva_cuota"] + number["recargo_importe"]
              - number["retencion_importe"] - total), 6)
    penalty = F.least(F.lit(0.30), F.try_divide(diff, total))
    off = (total > 0) & (diff > 0.10)
    lines_off = (
        (line_count > 0) & (number["base_imponible"] > 0)
        & (F.round(F.abs(line_sum - number["base_imponible"]), 6) > F.greatest(number["base_imponible"] * 0.05, F.lit(2.0)))
    )

    def present(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(0.0)

    def lowered(v: Column, share: float) -> Column:
        return F.when(off, F.greatest(F.lit(0.50), v - penalty * share)).otherwise(v)

    fields = {
        "numero_factura": present(_has_text(d["numero_factura"]), 0.92),
        "fecha": present(_has_text(d["fecha_emision"]), 0.92),
        "proveedor": present(_has_text(d["emisor_nombre"]), 0.92),
        "cif_proveedor": id_confidence(d["emisor_nif"]),
        "cliente": present(_has_text(d["receptor_nombre"]), 0.92),
        "cif_cliente": id_confidence(d["receptor_nif"]),
        "base_imponible": lowered(present(d["base_imponible"].isNotNull(), 0.92), 0.7),
        "iva_porcentaje": present(d["iva_porcentaje"].isNotNull(), 0.90),
        "iva": lowered(present(d["iva_cuota"].isNotNull(), 0.92), 0.7),
        "total": lowered(present(d["total_factura"].isNotNull(), 0.92), 1.0),
        "lineas": F.when(lines_off, F.greatest(F.lit(0.55), present(line_count > 0, 0.90) - 0.20)).otherwise(
            present(line_count > 0, 0.90)),
    }
    entries = []
    for name, value in fields.items():
        retried = F.when((prompt_tokens > 8000) & (value > 0), F.greatest(F.lit(0.50), value - 0.05)).otherwise(value)
        entries += [F.lit(name), F.round(retried, 6)]
    return F.create_map(*entries)
