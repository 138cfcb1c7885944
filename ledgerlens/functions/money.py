"""Amounts: parsing, rounding, tax arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def round2(c: Column) -> Column:
    """Cents, half away from zero."""
    return F.round(c.cast("double"), 2).try_cast(CENTS)


def truthy(c: Column) -> Column:
    """NULL for zero and NULL, the value otherwise."""
    return F.nullif(c, F.lit(0).cast("double"))


def parse_amount(c: Column) -> Column:
    """Amount text to double.  The last of comma and dot is the decimal mark; a lone comma is one only
    before two digits; what cannot be read is 0."""
    raw, number, value = AMOUNT_STEPS
    return value(number(raw(c)))


def _amount_text(c: Column) -> Column:
    given = F.coalesce(c, F.lit(""))
    return F.when(given.rlike("^[0-9.,]+$"), given).otherwise(
        F.translate(F.regexp_replace(given, r"(?U)\s|€|\$|EUR", ""), "−–—", "---")
    )


def _amount_number(raw: Column) -> Column:
    last_comma = F.length(raw) - F.locate(",", F.reverse(raw))
    last_dot = F.length(raw) - F.locate(".", F.reverse(raw))
    no_dots = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    no_commas = F.replace(raw, F.lit(","), F.lit(""))
    return (
        F.when(raw.contains(",") & raw.contains("."), F.when(last_comma > last_dot, no_dots).otherwise(no_commas))
        .when(raw.rlike(r",[^,]{2}$"), F.replace(raw, F.lit(","), F.lit(".")))
        .otherwise(no_commas)
    )


def _amount_value(number: Column) -> Column:
    readable = number.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.coalesce(F.when(readable, F.round(number.try_cast("double"), 2)), F.lit(0.0))


# ``parse_amount`` in steps: inside a lambda what a later step names twice would be computed twice
AMOUNT_STEPS = (_amount_text, _amount_number, _amount_value)


def parse_draft_number(c: Column) -> Column:
    """Number typed by a reviewer: comma decimals, blank or unreadable is NULL."""
    return F.nullif(F.trim(F.replace(c, F.lit(","), F.lit("."))), F.lit("")).try_cast("double")


# binary noise of cent amounts lies far below this
EPSILON = 1e-9


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("bigint")


def approx_eq(a: Column, b: Column, tol: float = 0.05) -> Column:
    return F.abs(a - b) <= tol + EPSILON


def _zero(c: Column | None) -> Column:
    return F.lit(0.0) if c is None else F.coalesce(c.cast("double"), F.lit(0.0))


def _near(expected: Column, seen: Column, scale: Column) -> Column:
    return F.abs(expected - seen) <= F.greatest(F.lit(0.10), F.abs(scale) * 0.02) + EPSILON


def _share(amount: Column, percent: Column) -> Column:
    """``percent`` (two decimals) of an amount in whole cents, halves away from zero."""
    size = F.floor((cents(F.abs(amount)) * cents(percent) + 5000) / 10000) / 100
    return F.when(amount < 0, -size).otherwise(size)


def tax_score(base, rate, tax, total, withholding=None) -> Column:
    """How well (base, rate, tax, total) agree: 0 to 1."""
    b, r, t, tot, w = (_zero(x) for x in (base, rate, tax, total, withholding))
    expected_tax = F.when(r != 0, _share(F.abs(b), r)).otherwise(0.0)
    expected_total = F.abs(b) + F.abs(t) - F.abs(w)
    tax_part = F.when(
        (t != 0) & (expected_tax != 0) & _near(expected_tax, F.abs(t), expected_tax), 0.5
    ).when((t == 0) & (expected_tax == 0), 0.3)
    total_part = F.when((tot != 0) & _near(expected_total, F.abs(tot), tot), 0.5).when(tot == 0, 0.1)
    score = F.coalesce(tax_part, F.lit(0.0)) + F.coalesce(total_part, F.lit(0.0))
    return F.when((b <= 0) & (tot <= 0), 0.0).otherwise(score)


def infer_missing(base, rate, tax, total, withholding=None) -> Column:
    """Fill what is missing from what is known; each rule sees the tax filled before it but the
    original base and total."""
    b, r, t, tot, w = (_zero(x) for x in (base, rate, tax, total, withholding))
    tax2 = F.when((t == 0) & (b != 0) & (r != 0), _share(b, r)).otherwise(t)
    total2 = F.when((tot == 0) & ((b != 0) | (tax2 != 0)), F.round(b + tax2 - w, 2)).otherwise(tot)
    base2 = F.when((b == 0) & (tot != 0) & (tax2 != 0), F.round(tot - tax2 + w, 2)).otherwise(b)
    rate2 = F.when(
        (r == 0) & (tax2 != 0) & (F.abs(b) > 0.01), F.round(F.try_divide(F.abs(tax2), F.abs(b)) * 100, 2)
    ).otherwise(r)
    return F.struct(
        base2.alias("base"), rate2.alias("rate"), tax2.alias("tax"), total2.alias("total"), w.alias("withholding")
    )


def clamp(x: Column, limit: float) -> Column:
    """NULL where the magnitude exceeds what the store can hold."""
    v = x.try_cast("double")
    return F.when(F.abs(v) <= limit, v)


def as_percent(c: Column) -> Column:
    """Whole percent; values up to 1 are ratios."""
    return F.floor(F.when(c <= 1, c * 100).otherwise(c) + 0.5).cast("bigint")


def next_milestone(processed: Column, milestones) -> Column:
    steps = sorted(int(m) for m in milestones)
    above = F.array_min(F.filter(F.array(*[F.lit(m) for m in steps]).cast("array<bigint>"), lambda m: m > processed))
    thousand = (F.floor(processed / 1000) + 1) * 1000
    return F.coalesce(above, F.greatest(F.lit(steps[-1]).cast("bigint"), thousand.cast("bigint")))


def withholdings(rate: Column, base: Column, amount: Column) -> Column:
    """One IRPF element when something was withheld, otherwise an empty array."""
    one = F.struct(
        F.lit("IRPF").alias("withholding_type"),
        _zero(rate).alias("rate"),
        _zero(base).alias("taxable_base"),
        _zero(amount).alias("amount"),
    )
    kind = "array<struct<withholding_type:string,rate:double,taxable_base:double,amount:double>>"
    return F.when(_zero(amount) > 0, F.array(one)).otherwise(F.array()).cast(kind)


def repair_lines(lines: Column) -> Column:
    """Fill a missing amount from quantity and price; where they disagree trust the amount and correct
    the quantity if a whole one fits."""
    def fix(ln: Column) -> Column:
        qty, price, amount = (_zero(ln[f]) for f in ("cantidad", "precio_unitario", "importe_total"))
        product = F.round(qty * price, 2)
        whole = F.bround(F.try_divide(amount, price))
        fill = (amount == 0) & (qty > 0) & (price > 0)
        fits = (
            (qty > 0) & (price > 0) & (amount > 0)
            & (F.round(F.abs(product - amount), 6) > 0.02)
            & (whole >= 1)
            & (F.round(F.abs(whole * price - amount), 6) < 0.02)
        )
        return F.struct(
            ln["descripcion"].alias("descripcion"),
            F.when(fits, whole).otherwise(ln["cantidad"]).alias("cantidad"),
            ln["precio_unitario"].alias("precio_unitario"),
            F.when(fill, product).otherwise(ln["importe_total"]).alias("importe_total"),
        )

    return F.transform(lines, fix)


def map_lines(lines: Column) -> Column:
    """Engine lines to stored lines: absent numbers are 0, absent text is ''."""
    return F.transform(
        lines,
        lambda ln: F.struct(
            F.coalesce(ln["descripcion"], F.lit("")).alias("descripcion"),
            _zero(ln["cantidad"]).alias("cantidad"),
            _zero(ln["precio_unitario"]).alias("precio_unitario"),
            _zero(ln["importe_total"]).alias("importe"),
        ),
    )


def drop_empty_lines(lines: Column) -> Column:
    """Lines without any content disappear."""
    return F.filter(
        lines,
        lambda ln: (F.trim(F.coalesce(ln["descripcion"], F.lit(""))) != "")
        | ln["cantidad"].isNotNull()
        | ln["precio_unitario"].isNotNull()
        | ln["importe"].isNotNull(),
    )
