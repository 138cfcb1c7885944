"""Updates as table transforms: patches, update-from, result sink, JSON migration, review drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_draft_number


def apply_patch(target: DataFrame, patch: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Partial update.  A patch row sets column ``c`` when its flag ``set_c`` is true, also to NULL; columns
    outside ``allowed`` never change."""
    cols = [c for c in allowed if c in target.columns and c in patch.columns]
    side = patch.select(
        key,
        *[F.col(c).alias(f"_new_{c}") for c in cols],
        *[F.coalesce(F.col(f"set_{c}"), F.lit(False)).alias(f"_set_{c}") for c in cols],
    )
    return target.join(side, key, "left").select(
        *[
            F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in target.columns
        ]
    )


def update_from(target: DataFrame, patch: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Take ``cols`` from ``patch`` where the key occurs there."""
    side = patch.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    return target.join(side, key, "left").select(
        *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
          for c in target.columns]
    )


def stamp_updated(df: DataFrame, changed: Column, now: Column) -> DataFrame:
    old = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.withColumn("updated_at", F.when(changed, now).otherwise(old))


def apply_results(invoices: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Store extraction results: document, confidence (two decimals), processed time, pending review."""
    side = results.select(
        "id", F.col("documento_json").alias("_doc"), F.round("confianza", 2).alias("_conf"), F.lit(True).alias("_hit")
    )
    joined = invoices.join(side, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    changes = {
        "estado": F.when(hit, "PENDIENTE_REVISION").otherwise(F.col("estado")),
        "confianza_ia": F.when(hit, F.col("_conf")).otherwise(F.col("confianza_ia")),
    }
    kept = [changes.get(c, F.col(c)).alias(c) for c in invoices.columns if c not in ("documento_json", "fecha_procesado")]
    return joined.select(
        *kept, F.col("_doc").alias("documento_json"), F.when(hit, now).alias("fecha_procesado")
    )


def to_documents(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Columns and line rows to one JSON document per invoice, lines in order, whatever their number."""
    item = F.struct("orden", "producto_id", "cantidad", "precio_unitario", "importe")
    gathered = lines.groupBy(F.col("factura_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("lineas"))
    joined = invoices.join(gathered, "id", "left")
    empty = F.array().cast(gathered.schema["lineas"].dataType)
    blob = F.to_json(
        F.struct("numero_factura", "fecha", F.col("proveedor_nombre").alias("proveedor"), "total",
                 F.coalesce("lineas", empty).alias("lineas"))
    )
    return joined.select("id", "cliente_id", "estado", "created_at", blob.alias("documento_json"))


DOCUMENT_LINES = (
    "numero_factura string, fecha string, proveedor string, total double, "
    "lineas array<struct<orden:bigint,producto_id:bigint,cantidad:double,precio_unitario:double,importe:double>>"
)


def from_documents(documents: DataFrame) -> DataFrame:
    """The line rows back out of the JSON documents."""
    parsed = documents.select("id", F.from_json("documento_json", DOCUMENT_LINES).alias("d"))
    return parsed.select(F.col("id").alias("factura_id"), F.inline("d.lineas"))


def apply_draft(docs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Reviewer drafts (all text) over stored documents: comma decimals are read, blanks become NULL, lines
    without content disappear, invoices without a draft stay as they are."""
    line = lambda ln: F.struct(
        F.trim(F.coalesce(ln["descripcion"], F.lit(""))).alias("descripcion"),
        parse_draft_number(ln["cantidad"]).alias("cantidad"),
        parse_draft_number(ln["precio_unitario"]).alias("precio_unitario"),
        parse_draft_number(ln["subtotal"]).alias("importe"),
    )
    has = lambda ln: (
        (ln["descripcion"] != "") | ln["cantidad"].isNotNull()
        | ln["precio_unitario"].isNotNull() | ln["importe"].isNotNull()
    )
    d = drafts.select(
        "id",
        F.lit(True).alias("_hit"),
        F.nullif(F.trim("numero_factura"), F.lit("")).alias("_numero_factura"),
        F.coalesce(F.nullif(F.col("tipo"), F.lit("")), F.lit("compra")).alias("_operation_side"),
        F.nullif(F.col("fecha"), F.lit("")).alias("_fecha"),
        F.trim("proveedor_nombre").alias("_proveedor"),
        F.trim("proveedor_cif").alias("_cif_proveedor"),
        *[parse_draft_number(F.col(s)).alias("_" + t) for s, t in (
            ("base_imponible", "base_imponible"), ("iva_porcentaje", "iva_porcentaje"),
            ("iva_importe", "iva"), ("total", "total"))],
        F.filter(F.transform("lineas", line), has).alias("_lineas"),
    )
    touched = [c[1:] for c in d.columns if c.startswith("_") and c != "_hit"]
    return docs.join(d, "id", "left").select(
        *[F.when(F.col("_hit"), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in touched else F.col(c)
          for c in docs.columns]
    )
