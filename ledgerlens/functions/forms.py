"""Unicode normal forms as native Column expressions, for every script.

Text that holds only characters no form changes is told by one small pattern and returned as it is.  Other text is folded
character by character with ``translate``; only runs of a letter and its marks are taken apart, put in canonical order and
joined again.  All tables come from the Unicode data that Python carries.  Characters look up numbers: ``translate`` gives a
code from plane 16, private use, whose offset is the place in an array.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that every form leaves alone and that join with none: most texts of Western languages hold nothing else.
SETTLED = r"\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\xFF\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2030}\x{20AC}"
#: Latin characters that NFKC turns into one letter, digit or blank, and what they become.  None of them joins with its neighbours.
SIMPLE = {c: unicodedata.normalize("NFKC", c) for c in "\xA0ª²³µ¹º"}
#: Codes that stand for numbers.  Where a text holds such a code itself, no form changes it, so the text is taken in pieces.
CODE, CODES = 0x100000, r"\x{100000}-\x{100FFF}"
#: Marks, the Korean vowels and finals, which join with what stands before them, and marks that older JVMs do not know (fixed values).
JOINING = (
    r"\p{M}\x{1160}-\x{11FF}\x{898}-\x{89F}\x{8CA}-\x{8D2}\x{C3C}\x{1715}\x{1AC1}-\x{1ACE}\x{1DFA}"
    r"\x{10EFD}-\x{10EFF}\x{10F82}-\x{10F85}\x{11070}\x{11F41}\x{11F42}\x{1E08F}\x{1E2AE}\x{1E4EC}-\x{1E4EF}"
)
PIECES = f"(?s)[^{JOINING}]?[{JOINING}]+|[^{JOINING}]+(?![{JOINING}])"
#: A letter and its marks.  The large class is asked for characters beyond ASCII only.
MARKED = f"(?s).?(?![\\x00-\\x7F])[{JOINING}]+"
#: Stand around what is looked up.  Texts with more different pieces than ``KINDS`` are changed piece by piece.
OPEN, SHUT, KINDS = chr(CODE + 0xFFE), chr(CODE + 0xFFF), 256
#: Arithmetic of Korean syllables.
L0, V0, T0, S0, VS, TS, LS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28, 19


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(c: Column, known: str) -> Column:
    """Place of a character in ``known``; negative if it is not there."""
    codes = "".join(chr(CODE + k) for k in range(len(known)))
    return let(F.translate(c, known, codes), lambda t: F.when(t == c, F.lit(-1)).otherwise(F.ascii(t) - CODE))


def _char(code: Column) -> Column:
    """Character of a code below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _all():
    return (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


@lru_cache(maxsize=None)
def _folds(form: str) -> tuple[str, str, tuple[str, ...]]:
    """Arguments of ``translate`` for characters that ``form`` alone changes, and the texts that its number codes stand for."""
    source, target, texts = [], [], []
    for c in _all():
        if 0xAC00 <= ord(c) < 0xD7A4:
            continue
        folded = unicodedata.normalize(form, c)
        if folded == c:
            continue
        source.append(c)
        if len(folded) == 1:
            target.append(folded)
        else:
            target.append(chr(CODE + len(texts)))
            texts.append(folded)
    return "".join(source), "".join(target), tuple(texts)


@lru_cache(maxsize=None)
def _pairs() -> tuple[str, str, str]:
    """Characters that are one letter with one mark: they, the letters, the marks."""
    found = []
    for c in _all():
        parts = unicodedata.decomposition(c).split(" ")
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
            found.append((c, *(chr(int(p, 16)) for p in parts)))
    return tuple("".join(x) for x in zip(*found))


@lru_cache(maxsize=None)
def _grid() -> tuple[str, str, tuple[str, ...]]:
    """Letters, marks, and for each letter a row with what it joins to with each mark (a blank: nothing)."""
    joined, letters, marks = _pairs()
    bases, seconds = "".join(dict.fromkeys(letters)), "".join(dict.fromkeys(marks))
    rows = [[" "] * len(seconds) for _ in bases]
    for c, a, m in zip(joined, letters, marks):
        rows[bases.index(a)][seconds.index(m)] = c
    return bases, seconds, tuple("".join(r) for r in rows)


@lru_cache(maxsize=None)
def _classes() -> tuple[str, str]:
    """Marks with a combining class, and the code of that class for each."""
    marks = [c for c in _all() if unicodedata.combining(c)]
    return "".join(marks), "".join(chr(CODE + unicodedata.combining(c)) for c in marks)


def _each(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, ""), change), "")


def _folded(text: Column, form: str) -> Column:
    source, target, texts = _folds(form)
    table = F.split(F.lit("\n".join(texts)), "\n")
    last = chr(CODE + len(texts) - 1)

    def unfold(t: Column) -> Column:
        one = lambda ch: F.when((ch >= chr(CODE)) & (ch <= last), F.element_at(table, F.ascii(ch) - CODE + 1)).otherwise(ch)
        codes = f"\\x{{{CODE:X}}}-\\x{{{ord(last):X}}}"
        kinds = F.array_distinct(F.regexp_extract_all(t, F.lit(f"[{codes}]"), F.lit(0)))
        pieces = F.regexp_extract_all(t, F.lit(f"[{codes}]|[^{codes}]+"), F.lit(0))
        few = lambda found: F.aggregate(found, t, lambda out, ch: F.replace(out, ch, one(ch)))
        one_by_one = F.array_join(F.transform(pieces, one), "")
        return F.when(t.rlike(f"[{codes}]"), let(kinds, lambda found: F.when(F.size(found) <= KINDS, few(found)).otherwise(one_by_one))).otherwise(t)

    return let(F.translate(text, source, target), unfold)


def _apart(text: Column) -> Column:
    """Letters and marks of joined characters, Korean ones left alone."""
    return _folded(text, "NFD")


def _class_of(ch: Column) -> Column:
    marks, codes = _classes()
    return let(F.translate(ch, marks, codes), lambda t: F.when(t == ch, F.lit(0)).otherwise(F.ascii(t) - CODE))


def _in_order(text: Column) -> Column:
    """Characters (``k`` combining class, ``ch``) with marks in canonical order: by class behind each letter, else as they stand."""
    told = F.transform(F.split(text, ""), lambda ch, i: F.struct(F.lit(0).alias("seg"), _class_of(ch).alias("k"), i.alias("i"), ch.alias("ch")))
    empty = F.struct(F.lit(0).alias("seg"), F.filter(told, lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        seg = acc["seg"] + F.when(x["k"] == 0, 1).otherwise(0)
        one = F.struct(seg.alias("seg"), x["k"].alias("k"), x["i"].alias("i"), x["ch"].alias("ch"))
        return F.struct(seg.alias("seg"), F.concat(acc["out"], F.array(one)).alias("out"))

    sorted_ = F.array_sort(F.aggregate(told, empty, step)["out"])
    return F.when(F.size(told) > 1, sorted_).otherwise(told)


def _by_table(a: Column, ch: Column) -> Column:
    """The one character for a letter that is not Korean and a mark; NULL if there is none."""
    bases, seconds, rows = _grid()
    table = F.split(F.lit("\n".join(rows)), "\n")
    return let(
        F.struct(_number(a, bases).alias("r"), _number(ch, seconds).alias("c")),
        lambda p: F.when((p["r"] >= 0) & (p["c"] >= 0), F.nullif(F.substring(F.element_at(table, p["r"] + 1), p["c"] + 1, F.lit(1)), F.lit(" "))),
    )


def _joined(a: Column, ch: Column) -> Column:
    """The one character for a letter and what follows it; NULL if there is none."""
    one, two = F.ascii(a), F.ascii(ch)
    syllable = _char((one - L0) * (VS * TS) + (two - V0) * TS + S0)
    final = _char(one + two - T0)
    return (
        F.when(one.between(L0, L0 + LS - 1) & two.between(V0, V0 + VS - 1), syllable)
        .when(one.between(S0, S0 + LS * VS * TS - 1) & ((one - S0) % TS == 0) & two.between(T0 + 1, T0 + TS - 1), final)
        .otherwise(_by_table(a, ch))
    )


def _together(text: Column) -> Column:
    """A letter with its marks, joined as far as one character exists and no mark of the same or a higher class stands between."""
    state = lambda out, base, marks, last: F.struct(out.alias("out"), base.alias("base"), marks.alias("marks"), last.alias("last"))

    def step(acc: Column, x: Column) -> Column:
        free = (acc["base"] != "") & ((acc["marks"] == "") | (acc["last"] < x["k"]))
        return let(
            F.when(free, _joined(acc["base"], x["ch"])),
            lambda j: F.when(j.isNotNull(), state(acc["out"], j, acc["marks"], acc["last"]))
            .when(x["k"] == 0, state(F.concat(acc["out"], acc["base"], acc["marks"]), x["ch"], F.lit(""), F.lit(0)))
            .otherwise(state(acc["out"], acc["base"], F.concat(acc["marks"], x["ch"]), x["k"])),
        )

    done = F.aggregate(_in_order(_apart(text)), state(F.lit(""), F.lit(""), F.lit(""), F.lit(0)), step)
    whole = let(done, lambda s: F.concat(s["out"], s["base"], s["marks"]))
    # a plain letter with one mark, the most frequent piece, is one character or stays
    one = F.coalesce(_by_table(F.substring(text, 1, 1), F.substring(text, 2, 1)), text)
    return F.when(text.rlike(r"^[A-Za-z][\x{300}-\x{36F}]$"), one).otherwise(whole)


def _by_kind(text: Column, pattern: str, change, one_by_one: Column) -> Column:
    """``change`` on each match of a pattern, computed once for all that are alike.  The text holds no code.

    Marks on both sides make a match that is looked up a whole one, also beside others or what became of them.
    """
    cut = F.regexp_replace(text, pattern, f"{OPEN}$0{SHUT}")
    put = lambda t, p: F.replace(t, F.concat(F.lit(OPEN), p, F.lit(SHUT)), change(p))
    return let(
        F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        lambda kinds: F.when(F.size(kinds) == 0, text).when(F.size(kinds) <= KINDS, F.aggregate(kinds, cut, put)).otherwise(one_by_one),
    )


def _with_marks(text: Column, change) -> Column:
    """``change`` on each run of a letter and its marks."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.when(p.rlike(f"[{JOINING}]"), change(p)).otherwise(p))
    return _by_kind(text, MARKED, change, F.array_join(pieces, ""))


def _where(text: Column, chars: str, change, inside: bool) -> Column:
    """``change`` on the runs of some characters, or on all others."""
    pieces = F.when(text.rlike(f"[{chars}]"), F.regexp_extract_all(text, F.lit(f"[{chars}]+|[^{chars}]+"), F.lit(0))).when(text.isNotNull(), F.array(text))
    hit = lambda p: p.rlike(f"^[{chars}]") if inside else p.rlike(f"^[^{chars}]")
    return F.array_join(F.transform(pieces, lambda p: F.when(hit(p), change(p)).otherwise(p)), "")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _only(c: Column, chars: str) -> Column:
    """Does text hold nothing but ASCII and some characters?  ASCII is told first, since a class of many ranges is slow."""
    return ~c.rlike(f"(?![\\x00-\\x7F])[^{chars}]")


def composed(c: Column, form: str) -> Column:
    """NFC or NFKC.  Time grows with the square of the longest run of marks on one letter, else with the text."""
    slow = _where(c, CODES, lambda p: let(_folded(p, form), lambda t: _with_marks(t, _together)), False)
    if form != "NFKC":
        return F.when(_ascii(c) | _only(c, SETTLED), c).otherwise(slow)
    simple = c
    for source, target in SIMPLE.items():
        simple = F.replace(simple, F.lit(source), F.lit(target))
    return F.when(_ascii(c), c).when(_only(c, SETTLED + "".join(SIMPLE)), simple).otherwise(slow)


def nfkc(c: Column) -> Column:
    return composed(c, "NFKC")


def nfc(c: Column) -> Column:
    return composed(c, "NFC")


def nfd(c: Column) -> Column:
    """Canonical decomposition: letters and marks apart, in canonical order."""

    def korean(ch: Column) -> Column:
        s = F.ascii(ch) - S0
        parts = F.concat(_char(L0 + F.floor(s / (VS * TS))), _char(V0 + F.floor(s % (VS * TS) / TS)), F.when(s % TS > 0, _char(T0 + s % TS)).otherwise(""))
        return F.when((ch >= chr(S0)) & (ch <= chr(S0 + LS * VS * TS - 1)), parts).otherwise(ch)

    ordered = lambda p: F.array_join(F.transform(_in_order(p), lambda x: x["ch"]), "")
    several = f"(?![\\x00-\\x7F])[{JOINING}]{{2}}"
    in_order = lambda u: F.when(u.rlike(several), _with_marks(u, ordered)).otherwise(u)
    parts = lambda t: F.when(t.rlike(f"[\\x{{{S0:X}}}-\\x{{{S0 + LS * VS * TS - 1:X}}}]"), _each(t, korean)).otherwise(t)
    taken = lambda p: let(_apart(p), lambda t: let(parts(t), in_order))
    beyond = r"\x00-\x7F" + CODES
    apart = _where(c, beyond, taken, False)
    return F.when(_ascii(c), c).when(c.rlike(f"[{CODES}]"), apart).otherwise(_by_kind(c, f"[^{beyond}]+", taken, apart))
