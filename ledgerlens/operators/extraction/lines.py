"""Corpus to line arrays and line rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import nfkc
from .common import BLANKS, pin

# blanks that are no line breaks, as a class of a pattern
_BLANK = "".join(f"\\x{{{ord(c):X}}}" for c in BLANKS if c != "\n")


def scan_lines(corpus: DataFrame, *carried: str) -> DataFrame:
    """``text`` normalised, ``lines`` without blank ones, ``raw_lines`` the same lines with their inner
    spacing kept; ``carried`` columns of the corpus stay with their document."""
    df = pin(corpus.select("doc_id", *carried, "text"), _folded=nfkc(F.coalesce("text", F.lit("")))).drop("text")
    df = pin(df, _raw=_stripped_lines(F.col("_folded"))).drop("_folded")
    # no pattern tells one line break from several, so blank lines can stay out of the text
    wide = F.col("_raw").contains("  ") | F.col("_raw").contains("\t")
    df = pin(df, text=F.when(wide, F.regexp_replace("_raw", "[ \t]+", " ")).otherwise(F.col("_raw")))
    return pin(df, raw_lines=_lines("_raw"), lines=_lines("text")).drop("_raw")


def _stripped_lines(text: Column) -> Column:
    """The text with its lines stripped at both ends and blank ones left out, in one pass over the whole text.

    Only a run's first blank can start a match, so time grows with the text however long a run is.
    """
    some, breaks = f"[{_BLANK}]", f"[{_BLANK}]*+\\n[{_BLANK}\\n]*+"
    ragged = text.contains("\n\n") | text.rlike(f"{some}\\n|\\n{some}")
    joined = F.when(ragged, F.regexp_replace(text, f"(?<!{some}){breaks}", "\n")).otherwise(text)
    return F.btrim(joined, F.lit(BLANKS + "\n"))


def _lines(c: str) -> Column:
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))


def line_rows(scanned: DataFrame) -> DataFrame:
    """One row per line: ``doc_id, line_index, line, raw_line``."""
    both = F.arrays_zip(F.col("lines").alias("line"), F.col("raw_lines").alias("raw_line"))
    return scanned.select("doc_id", F.posexplode(both).alias("line_index", "l")).select(
        "doc_id", "line_index", F.col("l.line").alias("line"), F.col("l.raw_line").alias("raw_line")
    )
