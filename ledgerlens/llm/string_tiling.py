"""Benchmark decontamination by greedy string tiling.

A document and a test item are compared only where they share seeds, runs of five words.  For each such pair, running
Karp-Rabin matching finds the longest common runs of unmarked words, marks them as tiles and goes on with shorter runs down
to five words.  Tiles never overlap and need not keep their order, so passages that were cut up and reordered are caught.
A document is contaminated by an item if its tiles cover at least half of the item's words.

Documents do not move: each task holds the items and tiles its own texts.  Items are few; their size is checked, and beyond
``BLOCK_BYTES`` they are dealt into blocks below it that pass over the documents one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts_of

LEAST = 5
COVERAGE = 0.5
BLOCK_BYTES = 32 << 20
WORD = re.compile(r"\w+")
#: Odd multiplier of the rolling hashes, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
TILED = "doc_id long, item_id long, item_words int, covered int, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>"


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = (ids + 1).astype(np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + x[k : k + len(h)]
    return h


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (text position, item position, words), longest first.  Negative ids in ``text`` match nothing."""
    free_item, free_text = np.ones(len(item), bool), text >= 0
    tiles = []
    length = max(least, min(len(item), 32))
    while True:
        starts: dict[int, list[int]] = {}
        open_item = np.convolve(free_item, np.ones(length, int), "valid") == length if len(item) >= length else np.zeros(0, bool)
        for p, h in zip(np.flatnonzero(open_item).tolist(), rolling(item, length)[open_item].tolist()):
            starts.setdefault(h, []).append(p)
        open_text = np.convolve(free_text, np.ones(length, int), "valid") == length if len(text) >= length else np.zeros(0, bool)
        at_text = np.flatnonzero(open_text)
        hashes = rolling(text, length)[open_text]
        if starts and len(hashes):
            wanted = np.isin(hashes, np.fromiter(starts, np.uint64, len(starts)))
            at_text, hashes = at_text[wanted], hashes[wanted]
        else:
            at_text = at_text[:0]
        matches = []
        covered: dict[int, int] = {}  # diagonal: end of its last match, so that a run is found once, from its start
        for t, h in zip(at_text.tolist(), hashes.tolist()):
            for p in starts[h]:
                if covered.get(t - p, -1) > t:
                    continue
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and free_item[p + k] and free_text[t + k]:
                    k += 1
                if k >= length:
                    matches.append((-k, t, p))
                    covered[t - p] = t + k
        longer = max((-m[0] for m in matches), default=0)
        if longer > 2 * length:
            length = longer  # rare: a match much longer than looked for goes first
            continue
        for k, t, p in sorted(matches):
            # what longer tiles left of the match, if it is still one run of this length
            free = np.flatnonzero(free_item[p : p - k] & free_text[t : t - k])
            if len(free) >= length and free[-1] - free[0] + 1 == len(free):
                t, p, n = t + int(free[0]), p + int(free[0]), len(free)
                free_item[p : p + n] = free_text[t : t + n] = False
                tiles.append((t, p, n))
        if length == least:
            return tiles
        length = max(least, length // 2)


class Items:
    """Test items as word ids, with the seeds of all of them sorted for lookup."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.items = []
        seeds, owners = [], []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall((text or "").lower())], np.int64)
            h = rolling(ids, least)
            seeds.append(h), owners.append(np.full(len(h), len(self.items)))
            self.items.append((item_id, ids))
        seeds, owners = np.concatenate([*seeds, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], owners[order]

    def matches(self, text: str) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Item id, words and tiles of every item that shares a seed with a text."""
        words = WORD.findall(text.lower())
        if len(words) < self.least or not len(self.seeds):
            return
        ids = np.array([*map(self.vocabulary.get, words, [-1] * len(words))], np.int64)
        known = np.convolve(ids >= 0, np.ones(self.least, int), "valid") == self.least
        if not known.any():
            return
        at = np.flatnonzero(known)
        hashes = rolling(ids, self.least)[at]
        low = np.searchsorted(self.seeds, hashes, "left")
        hit = self.seeds[np.minimum(low, len(self.seeds) - 1)] == hashes
        at, hashes, low = at[hit], hashes[hit], low[hit]
        if not len(at):
            return
        high = np.searchsorted(self.seeds, hashes, "right")
        n = high - low
        owner = self.owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        place = np.repeat(at, n)
        for o in np.unique(owner):
            near = np.zeros(len(ids) + 1, np.int64)  # the words that seeds of this item cover
            spots = place[owner == o]
            np.add.at(near, spots, 1), np.add.at(near, spots + self.least, -1)
            inside = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            gaps = np.flatnonzero(np.diff(inside) > 1) + 1
            # runs of covered words side by side, a word that matches nothing between them
            text_ids, origin = np.insert(ids[inside], gaps, -1), np.insert(inside, gaps, -1)
            item_id, item = self.items[o]
            yield item_id, len(item), [(int(origin[t]), p, k) for t, p, k in greedy_tiles(item, text_ids, self.least)]


def _pass(docs: DataFrame, items: list[tuple[int, str]], least: int, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, least)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                for item_id, words, tiles in items.matches(text):
                    covered = sum(k for _, _, k in tiles)
                    if covered >= coverage * words:
                        spans = [{"doc_word": t, "item_word": p, "words": k} for t, p, k in sorted(tiles, key=lambda x: x[1])]
                        rows.append((doc_id, item_id, words, covered, covered / words, spans))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))]
                names = ["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return docs.mapInArrow(tile, TILED)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """Test items with a text, and their bytes."""
    items = benchmark.selectExpr(f"cast(`{item_col}` as long) item_id", f"`{item_text_col}` text").where("text is not null")
    return items, items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item with enough coverage: ``doc_id``, ``item_id``, ``item_words``, ``covered``, ``coverage``, ``tiles``.

    Null and empty texts share nothing.  An item below ``least`` words has no seed and contaminates nothing.  Repeated rows
    of either table give repeated answers.  Words are runs of word characters, lower-cased.
    """
    texts = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    items, size = _items(benchmark, item_col, item_text_col)
    if size <= block_bytes:
        return _pass(texts, [tuple(r) for r in items.collect()], least, coverage)  # at most block_bytes, just measured
    blocks = int(2 * size // block_bytes) + 1
    done = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about half of block_bytes
        found = cut(_pass(texts, [tuple(r) for r in block], least, coverage))
        done = found if done is None else done.union(found)
    return done


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the rows that an item of ``benchmark`` contaminates.  Rows with null or empty texts stay.

    Items filter texts where they lie.  With more than one block of items the rows that one leaves go on to the next.
    """
    items, size = _items(benchmark, item_col, item_text_col)
    blocks = 1 if size <= block_bytes else int(2 * size // block_bytes) + 1

    def without(rows: DataFrame, block: list[tuple]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, least)
            for batch in slices(batches):
                keep = [not any(sum(k for _, _, k in tiles) >= coverage * words for _, words, tiles in items.matches(t)) for t in texts_of(batch, text_col)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(clean, rows.schema)

    if blocks == 1:
        return without(docs, [tuple(r) for r in items.collect()])  # at most block_bytes, just measured
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about half of block_bytes
        docs = cut(without(docs, [tuple(r) for r in block]))
    return docs
