"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair encoding, a sequence of tokens is the encoding of its text exactly when each neighbouring pair is the
encoding of its own text.  So the encoding of a prefix is the encoding of a shorter prefix plus one token: the only token
that ends there and forms a valid pair with the last token of the shorter prefix.  One pass over a word finds the last
token and the count of each of its prefixes.

A text is cut into units, white space and what follows it up to the next white space.  The tokenizer's own pattern never
joins two units, so the count of a prefix is the count of the whole units before it plus that of a part of one unit.  Per
text the store is one signed byte a character, the change of the count; sums of it answer budgets and truncations.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Recent, kept, slices, texts_of

LIMIT = 1024
#: Units and words whose answer a worker remembers, twice.
REMEMBERED = 150_000
#: Unicode white space, and the pattern byte-level BPE splits texts by.
WHITE = "\t-\r \x85\xa0  -     　"
WHITES = frozenset(filter(re.compile(f"[{WHITE}]").match, map(chr, range(0x3001))))
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
COUNTS = "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary"


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: itself, or the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts tokens at every character of a text, for a byte-level BPE tokenizer file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.texts = {i: t for t, i in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.remembered = remembered
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): r for r, (a, b) in enumerate(merges)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.newest: tuple[bytes, list[int], list[int]] = (b"", [-1], [0])
        self.units: dict[str, bytes] = Recent(remembered)
        # the tokens at the left and right edge of a token while it grows, each with the rank at which it is merged away
        never = len(merges)
        self.left = {i: [(i, never)] for t, i in self.ids.items() if len(t) == 1}
        self.right = {i: [(i, never)] for i in self.left}
        self.usable = {t: i for t, i in self.ids.items() if len(t) == 1}
        for (a, b), r in self.rank.items():
            whole = self.of_two(a, b)
            i = self.ids[whole]
            if i not in self.left and a in self.left and b in self.left and not self.crossed(self.right[a], self.left[b], r):
                self.left[i] = [(i, never), (a, r), *self.left[a][1:]]
                self.right[i] = [(i, never), (b, r), *self.right[b][1:]]
                self.usable[whole] = i  # others are no text's encoding, so they cannot be the last token of anything
        # lengths of the tokens that end in given three bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for t in self.usable:
            if len(t) > 2:
                lengths.setdefault(t[-3:], {1, 2}).add(len(t))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in lengths.items()}

    def of_two(self, a: int, b: int) -> bytes:
        return self.texts[a] + self.texts[b]

    def crossed(self, right: list[tuple[int, int]], left: list[tuple[int, int]], until: int) -> bool:
        """Does a merge join the two sides before rank ``until``?  Of equal pairs the left one goes first."""
        rank = self.rank
        for x, x_ends in right:
            for y, y_ends in left:
                if (r := rank.get((x, y))) is not None and r < x_ends and r <= y_ends and r < until:
                    return True
        return False

    def valid(self, a: int, b: int) -> bool:
        """Do tokens a, b stay as they are when their text is encoded?"""
        if len(self.pairs) >= 4 * self.remembered:
            self.pairs.clear()
        found = self.pairs[a, b] = not self.crossed(self.right[a], self.left[b], len(self.rank))
        return found

    def word(self, word: str) -> list[int]:
        """Token counts at the end of each character of a word that the pattern does not split."""
        if (found := self.words.get(word)) is not None:
            return found
        data = word.encode()
        known, last, count = self.newest  # prefixes shared with the word before need no second pass: callers sort words
        shared = 0
        for a, b in zip(data, known):
            if a != b:
                break
            shared += 1
        last = last[: shared + 1] + [-1] * (len(data) - shared)
        count = count[: shared + 1] + [0] * (len(data) - shared)
        usable, pairs, tails = self.usable, self.pairs, self.tails
        for end in range(shared + 1, len(data) + 1):
            for n in tails.get(data[max(0, end - 3) : end], (2, 1)):
                if n <= end and (token := usable.get(data[end - n : end])) is not None:
                    before = last[end - n]
                    if before >= 0 and (ok := pairs.get((before, token))) is None:
                        ok = self.valid(before, token)
                    if before < 0 or ok:
                        last[end], count[end] = token, count[end - n] + 1
                        break
        self.newest = data, last, count
        if len(data) == len(word):
            found = count[1:]
        else:
            found = [count[k + 1] for k in range(len(data)) if k + 1 == len(data) or data[k + 1] & 0xC0 != 0x80]
        if len(self.words) >= self.remembered:
            self.words.clear()
        self.words[word] = found
        return found

    def counts(self, unit: str) -> list[int]:
        """Counts at the end of each character of a unit: exactly those of the unit's prefixes, cut by the pattern."""
        out: list[int] = []
        before = 0
        for m in WORD.finditer(unit):
            word = m.group()
            here = self.word(word)
            if word in ("'re", "'ve", "'ll"):  # cut after two characters they are two words
                here = [here[0], self.word("'")[-1] + self.word(word[1])[-1], here[2]]
            if before == 0 and m.end() < len(unit) and word[-1] in WHITES:
                # the pattern leaves the last white space to the word behind it; a prefix that ends there has all in one
                out = [*here, self.word(unit[: m.end() + 1])[-1]]
                before = here[-1]
                continue
            out += [before + n for n in here[len(out) - m.start() :]]
            before += here[-1]
        return out

    def unit(self, unit: str) -> bytes:
        """Changes of the count over a unit, a signed byte a character."""
        counts = self.counts(unit)
        found = self.units[unit] = array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()
        return found

    def stores(self, texts: list[str]) -> list[bytes]:
        """``deltas`` of many texts.  New units are counted in their order: neighbours share most of their prefixes."""
        special = self.special_at.search if self.special_at else lambda text: None
        cut = [None if special(t) else UNIT.findall(t) for t in texts]
        for unit in sorted(self.units.missing(set().union(*filter(None, cut)))):
            self.unit(unit)
        at = self.units.__getitem__
        return [self.deltas(t) if units is None else b"".join(map(at, units)) for t, units in zip(texts, cut)]

    def plain(self, text: str) -> bytes:
        units = self.units
        return b"".join([units.get(u) or self.unit(u) for u in UNIT.findall(text)])

    def deltas(self, text: str) -> bytes:
        """Changes of the count over a whole text.  Strings of special tokens in it are one token each."""
        if self.special_at is None or not self.special_at.search(text):
            return self.plain(text)
        parts, at = [], 0
        for m in self.special_at.finditer(text):
            before = text[at : m.start()]
            ordinary = [self.count(before + m.group()[:k]) for k in range(len(m.group()))]  # cut short, it is plain text
            parts += [self.plain(before), np.diff([*ordinary, ordinary[0] + 1]).astype(np.int8).tobytes()]
            at = m.end()
        return b"".join([*parts, self.plain(text[at:])])

    def count(self, text: str) -> int:
        return int(np.frombuffer(self.plain(text), np.int8).sum(dtype=np.int64))


def counts_at(deltas: bytes) -> np.ndarray:
    """Token counts after each character, from the store of a text."""
    return np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix whose encoding has at most ``budget`` tokens.  Counts may fall as a text grows."""
    fits = np.flatnonzero(counts_at(deltas) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_prefixes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``prefix_deltas`` (the store of all prefixes).

    A null text counts as empty: no bytes, no tokens, an empty store.  Repeated rows give repeated answers.  ``tokenizer``
    is the path of a byte-level BPE file, found on every machine.  A task holds one slice of texts and its unit cache.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("prefix counter", tokenizer), lambda: PrefixCounter(tokenizer))
        for batch in slices(batches):
            texts = texts_of(batch)
            stores = counter.stores(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in stores], pa.int64()),
                    pa.array(stores, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(count, COUNTS)
