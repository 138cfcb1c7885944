"""Text normalisation as native Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .forms import nfkc

# Latin letters, spaces, super/subscripts, letter-like signs and full-width ASCII.
_RANGES = ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2000, 0x209F), (0x2100, 0x214F), (0x3000, 0x3000), (0xFF01, 0xFF5E))
_MARKS = "".join(chr(c) for c in range(0x300, 0x370))


@lru_cache(maxsize=None)
def _fold_table(form: str, strip_marks: bool) -> tuple[str, str]:
    """Characters whose ``form`` is one other character, as a pair of ``translate`` arguments."""
    source, target = [], []
    for low, high in _RANGES:
        for code in range(low, high + 1):
            folded = unicodedata.normalize(form, chr(code))
            if strip_marks:
                folded = "".join(c for c in folded if not unicodedata.combining(c))
            if len(folded) == 1 and folded != chr(code):
                source.append(chr(code))
                target.append(folded)
    # translate() deletes the characters of `source` that have no partner in `target`
    return "".join(source) + (_MARKS if strip_marks else ""), "".join(target)


def _unless_ascii(c: Column, folded: Column) -> Column:
    """Most text has no character to fold; counting bytes tells faster than looking each one up."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)


def like(c: Column, pattern: str) -> Column:
    """``rlike`` for a pattern with Unicode classes.  Text of ASCII only is matched with the plain classes,
    which mean the same there and run faster."""
    plain = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    return F.when(F.octet_length(c) == F.length(c), c.rlike(plain)).otherwise(c.rlike(pattern))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_accents(c: Column) -> Column:
    """Drop accents and other marks; only canonical decompositions (``º`` stays)."""
    return _unless_ascii(c, F.translate(c, *_fold_table("NFD", True)))


def fold_compat(c: Column) -> Column:
    """Drop accents and fold compatibility characters (``º`` becomes ``o``)."""
    return _unless_ascii(c, F.translate(c, *_fold_table("NFKD", True)))


def normalize_text(c: Column) -> Column:
    text = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def normalize_keyword(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(fold_compat(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", " "))


def normalize_name(c: Column) -> Column:
    """Company name for matching: no accents, suffixes or punctuation; empty becomes NULL."""
    bare = F.regexp_replace(F.upper(fold_accents(c)), K.COMPANY_SUFFIXES, "")
    return F.nullif(squeeze(F.regexp_replace(bare, "[.,;:'\"]", "")), F.lit(""))


def normalize_for_side(c: Column) -> Column:
    """Company name for containment tests: punctuation separates words; never NULL."""
    bare = F.regexp_replace(F.upper(fold_accents(F.coalesce(c, F.lit("")))), K.COMPANY_SUFFIXES, "")
    return squeeze(F.regexp_replace(bare, "[.,;:'\"()\\-]", " "))


def clean_invoice_number(c: Column) -> Column:
    head = F.regexp_replace(squeeze(c), r"\.+$", "")
    return F.trim(F.regexp_replace(squeeze(head), K.NUMBER_NOISE_TAIL, ""))


def invoice_number_valid(c: Column) -> Column:
    compact = F.regexp_replace(F.trim(c), r"(?U)[\s.\-]", "")
    return (
        F.length(c).between(2, 30)
        & c.rlike(r"(?U)\d")
        & ~F.upper(compact).rlike(K.CIF_FORMAT)
        & ~compact.rlike(K.NIF_FORMAT)
        & ~F.upper(compact).rlike(K.NIE_FORMAT)
        & ~F.trim(c).rlike(K.NUMBER_BLACKLIST)
        & ~c.rlike(K.PAGE_REFERENCE)
    )


def _contains_any(c: Column, *parts: str) -> Column:
    hit = c.contains(parts[0])
    for p in parts[1:]:
        hit = hit | c.contains(p)
    return hit


def document_type(lowered: Column) -> Column:
    """Kind of a document from its lower-case text.  Plain searches decide whether a pattern can match."""
    rectifies = _contains_any(lowered, "rectificat", "abono")
    simplified = _contains_any(lowered, "ticket", "simplificada", "documento", "valido", "compra")
    return (
        F.when(rectifies & lowered.rlike(K.RECTIFYING_MARKERS), "rectificativa")
        .when(simplified & lowered.rlike(K.TICKET_MARKERS), "ticket")
        .otherwise("factura")
    )


def document_code(correlative: Column, doc_id: Column) -> Column:
    """``DOC-`` code; numbers longer than six digits keep all their digits."""
    digits = F.coalesce(correlative, doc_id).cast("string")
    padded = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.coalesce(F.concat(F.lit("DOC-"), padded), F.lit("DOC-?????"))


def warning_group(code: Column) -> Column:
    """Group of one extraction warning; codes without a rule are their own group, blanks are ''."""
    v = F.trim(F.coalesce(code, F.lit("")))
    rule = F.when(v.rlike(K.NUMBERED_LINE_CODE), "line_item_adjustment").when(
        v == K.REGION_RESCUE_CODE, "region_rescue"
    )
    for prefix, group in K.WARNING_PREFIX_GROUPS:
        rule = rule.when(v.startswith(prefix), group)
    rule = rule.when(
        v.startswith("cif_"),
        F.when(v.endswith("_no_valido"), "tax_id_validation").otherwise("party_adjustment"),
    )
    return rule.otherwise(v)


def warning_groups(codes: Column) -> Column:
    """Distinct groups of an array of codes, first-seen order."""
    groups = F.transform(F.coalesce(codes, F.array().cast("array<string>")), warning_group)
    return F.filter(F.array_distinct(groups), lambda g: g != "")


def clean_markdown(c: Column) -> Column:
    """Strip heading, emphasis, link, image and rule marks that recognisers put into page text."""
    out = c
    for pattern, repl in K.MARKDOWN_MARKS:
        out = F.regexp_replace(out, pattern, repl)
    lines = F.filter(F.split(out, "\n"), lambda x: ~x.rlike(K.MARKDOWN_RULE))
    return F.array_join(lines, "\n")


def table_cells(c: Column) -> Column:
    """A piped table as one cell per line, without its separator rows."""
    rows = F.filter(
        F.transform(F.split(c, r"\r?\n"), lambda r: F.trim(r)),
        lambda r: (r != "") & ~r.rlike(K.TABLE_RULE),
    )
    cells = F.transform(
        rows,
        lambda r: F.when(
            r.contains("|"),
            F.filter(
                F.transform(F.split(r, r"\|"), lambda x: F.trim(x)), lambda x: (x != "") & (x != K.EMPTY_CELL)
            ),
        ).otherwise(F.array(r)),
    )
    return F.array_join(F.flatten(cells), "\n")


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def page_with_margins(header: Column, body: Column, footer: Column) -> Column:
    """Add header and footer around a page unless the page already contains them."""
    h, f = F.trim(F.coalesce(header, F.lit(""))), F.trim(F.coalesce(footer, F.lit("")))
    top = F.when((h != "") & ~F.contains(letters_only(body), letters_only(h)), h)
    above = F.concat_ws("\n", top, F.nullif(body, F.lit("")))
    bottom = F.when((f != "") & ~F.contains(letters_only(above), letters_only(f)), f)
    return F.concat_ws("\n", F.nullif(above, F.lit("")), bottom)


def unfence_json(c: Column) -> Column:
    """The JSON object inside a model reply: code fences dropped, else the first flat object."""
    s = F.btrim(c, F.lit(" \t\r\n"))
    fenced = F.btrim(F.regexp_extract(s, r"(?s)```(?:json)?\s*\n?(.*?)```", 1), F.lit(" \t\r\n"))
    body = F.when(s.contains("```") & (fenced != ""), fenced).otherwise(s)
    flat = F.regexp_extract(body, r"(?s)\{[^{}]*\}", 0)
    return F.when(body.startswith("{") | (flat == ""), body).otherwise(flat)


def id_list(c: Column) -> Column:
    """Tax-id list given as a JSON array or as comma-separated text."""
    from_json = F.from_json(c, "array<string>")
    parts = F.when(F.trim(c).startswith("["), from_json).otherwise(F.split(c, ","))
    clean = F.transform(F.coalesce(parts, F.split(c, ",")), lambda x: F.trim(x))
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast("array<string>"))
