"""Coherence of engine results, choice between attempts, review warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.taxid import tax_id_valid
from ..functions.text import warning_groups


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def totals_gap(base, tax, total, withheld, surcharge) -> Column:
    return F.round(F.abs(_num(base) + _num(tax) + _num(surcharge) - _num(withheld) - _num(total)), 6)


def lines_sum(lines: Column, field: str = "importe_total") -> Column:
    return F.round(F.aggregate(F.coalesce(lines, F.array()), F.lit(0.0), lambda s, x: s + _num(x[field])), 6)


def check_totals(df: DataFrame, tol: float = 0.10) -> DataFrame:
    """``diff``, whether totals agree, and whether tax was read without its breakdown.  A total of 0 is not
    checked."""
    gap = totals_gap(*[F.col(c) for c in ("base_imponible", "iva_cuota", "total_factura", "retencion_importe", "recargo_importe")])
    unchecked = _num(F.col("total_factura")) == 0
    missing = (_num(F.col("iva_cuota")) > 0) & (F.coalesce(F.size("desglose_impuestos"), F.lit(0)) <= 0)
    return df.select("*", gap.alias("diff")).select(
        "*", (unchecked | (F.col("diff") < tol)).alias("totals_ok"), (~unchecked & missing).alias("missing_breakdown")
    )


def check_lines(df: DataFrame) -> DataFrame:
    """``line_diff`` and whether lines add up to the base, within 5 % or 2.00."""
    base = _num(F.col("base_imponible"))
    gap = F.round(F.abs(lines_sum(F.col("lineas")) - base), 6)
    unchecked = (F.coalesce(F.size("lineas"), F.lit(0)) <= 0) | (base == 0)
    return df.select("*", gap.alias("line_diff")).withColumn(
        "lines_ok", unchecked | (F.col("line_diff") <= F.greatest(base * 0.05, F.lit(2.0)))
    )


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """One extraction per document out of its first attempt and its retries about totals and about lines.

    The retry about totals replaces the first when its totals are closer or when it brings a breakdown that
    was missing; then the retry about lines when its lines are closer or more.  Each kind is reduced to its
    first attempt map-side, as a handful of numbers; the winner's row is joined back.
    """
    scored = attempts.select(
        "doc_id", "attempt", "kind",
        totals_gap(*[F.col(c) for c in ("base_imponible", "iva_cuota", "total_factura", "retencion_importe", "recargo_importe")]).alias("gap"),
        (_num(F.col("iva_cuota")) > 0).alias("taxed"),
        F.greatest(F.coalesce(F.size("desglose_impuestos"), F.lit(0)), F.lit(0)).alias("tranches"),
        F.greatest(F.coalesce(F.size("lineas"), F.lit(0)), F.lit(0)).alias("n_lines"),
        F.round(F.abs(lines_sum(F.col("lineas")) - _num(F.col("base_imponible"))), 6).alias("line_gap"),
    )
    facts = F.struct("attempt", "gap", "taxed", "tranches", "n_lines", "line_gap")
    per = scored.groupBy("doc_id").agg(
        *[F.min(F.when(F.col("kind") == k, facts)).alias(k) for k in ("first", "totals", "lines")]
    )
    first, totals, lines = F.col("first"), F.col("totals"), F.col("lines")
    fills = first["taxed"] & (first["tranches"] == 0) & (totals["tranches"] > 0)
    staged = per.withColumn("best", F.when((totals["gap"] < first["gap"]) | fills, totals).otherwise(first))
    best = F.col("best")
    by_lines = (lines["line_gap"] < best["line_gap"]) | (lines["n_lines"] > best["n_lines"])
    winner = F.when(by_lines, lines["attempt"]).otherwise(best["attempt"])
    return attempts.join(staged.select("doc_id", winner.alias("attempt")), ["doc_id", "attempt"])


def suspicious_flags(df: DataFrame) -> Column:
    """What makes an extraction suspicious in a batch report."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    flags = F.array(
        F.when(blank("numero_factura"), "sin_numero"),
        F.when(blank("fecha"), "sin_fecha"),
        F.when(_num(F.col("total")) == 0, "total_cero"),
        F.when(empty("tax_breakdown"), "sin_desglose"),
        F.when(empty("lineas"), "sin_lineas"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def _money(c: Column) -> Column:
    # exact decimals print alike everywhere
    return F.round(c.cast("decimal(20,6)"), 2).cast("decimal(18,2)").cast("string")


def review_warnings(df: DataFrame) -> Column:
    """Warnings ``(tone, text, rule)`` that a reviewer sees, in rule order; equal tone and text come once.

    Expects flat invoice columns: numero_factura, fecha, proveedor, issuer_name, cif_proveedor, base_imponible,
    iva, total, tax_regime, document_type, warnings, decision_flags, job_error, lineas(importe).
    """
    col = F.col
    text = lambda c: F.trim(F.coalesce(col(c), F.lit("")))
    base, tax, total = (col(c).cast("double") for c in ("base_imponible", "iva", "total"))
    groups = warning_groups(col("warnings"))
    in_group = lambda *names: F.arrays_overlap(groups, F.array(*[F.lit(n) for n in names]))
    has_lines = F.coalesce(F.size("lineas"), F.lit(0)) > 0
    line_sum = lines_sum(col("lineas"), "importe")
    delta = F.round(F.abs(base + tax - total), 6)
    line_delta = F.round(F.abs(line_sum - base), 6)
    ticket = F.coalesce(col("document_type").isin(*K.TICKET_TYPES), F.lit(False))
    label = F.upper(F.coalesce(F.nullif(col("tax_regime"), F.lit("")), F.lit("IVA")))

    def warn(rule: str, tone: str, condition: Column, message) -> Column:
        body = F.lit(message) if isinstance(message, str) else message
        return F.when(condition, F.struct(F.lit(tone).alias("tone"), body.alias("text"), F.lit(rule).alias("rule")))

    flagged = F.transform(
        F.filter(F.coalesce("decision_flags", F.array()), lambda f: F.coalesce(f["message"], F.lit("")) != ""),
        lambda f: F.struct(
            F.when(f["severity"] == "error", "error").when(f["requires_review"], "warning").otherwise("info").alias("tone"),
            f["message"].alias("text"),
            F.lit("decision_flag").alias("rule"),
        ),
    )
    rules = F.array(
        warn("job_error", "error", F.coalesce(col("job_error"), F.lit("")) != "", F.concat(F.lit(K.MSG_JOB_ERROR), col("job_error"))),
        warn("fallback", "warning", in_group("doc_ai_fallback"), K.MSG_FALLBACK),
        warn("fallback_error", "warning", in_group("doc_ai_fallback_error"), K.MSG_FALLBACK_ERROR),
        warn("no_number", "warning", F.coalesce(col("numero_factura"), F.lit("")) == "", K.MSG_NO_NUMBER),
        warn("no_date", "warning", F.coalesce(col("fecha"), F.lit("")) == "", K.MSG_NO_DATE),
        warn("no_party", "warning", (F.coalesce(col("proveedor"), F.lit("")) == "") & (F.coalesce(col("issuer_name"), F.lit("")) == ""), K.MSG_NO_PARTY),
        warn("no_tax_id", "info", text("cif_proveedor") == "", K.MSG_NO_TAX_ID),
        warn("bad_tax_id", "warning", (text("cif_proveedor") != "") & ~tax_id_valid(text("cif_proveedor")), F.format_string(K.MSG_BAD_TAX_ID, col("cif_proveedor"))),
        warn("totals", "warning", delta > 0.02, F.format_string(K.MSG_TOTALS, _money(base), label, _money(tax), _money(total))),
        warn("lines", "warning", ~ticket & has_lines & (line_delta > 0.02), F.format_string(K.MSG_LINES, _money(line_sum), _money(base))),
        warn("no_lines", "info", ~has_lines, K.MSG_NO_LINES),
        warn("reconciled", "info", (delta <= 0.02) & in_group("source_discrepancy"), K.MSG_RECONCILED),
        warn("adjusted", "info", has_lines & (line_delta <= 0.02) & in_group(*K.ADJUSTMENT_GROUPS), K.MSG_ADJUSTED),
        warn("ticket", "info", ticket, K.MSG_TICKET),
    )
    none = F.array().cast("array<struct<tone:string,text:string,rule:string>>")
    same = lambda v, w: (v["tone"] == w["tone"]) & (v["text"] == w["text"])
    return F.aggregate(
        F.filter(F.concat(flagged, rules), lambda w: w.isNotNull()).cast("array<struct<tone:string,text:string,rule:string>>"), none,
        lambda kept, w: F.when(F.exists(kept, lambda v: same(v, w)), kept).otherwise(F.array_append(kept, w)),
    )


def panel_tone(warnings: Column) -> Column:
    has = lambda tone: F.exists(warnings, lambda w: w["tone"] == tone)
    return F.when(has("error"), "error").when(has("warning"), "warning").when(F.size(warnings) > 0, "info").otherwise("success")
