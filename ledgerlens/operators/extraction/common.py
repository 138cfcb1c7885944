"""Helpers shared by the extraction steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# whitespace that ends a line or pads it
BLANKS = " \t\r\n\f\u000b\u0085  "


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A projection may be merged into the lambdas that read it and then run once per array element; a
    generator over a one-element array is never merged.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def pin_fields(df: DataFrame, prefix: str, value: Column, names: Sequence[str]) -> DataFrame:
    """The fields of a struct expression as pinned columns ``prefix + name``."""
    return df.select("*", F.inline(F.array(value)).alias(*[prefix + n for n in names]))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def non_null(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())
