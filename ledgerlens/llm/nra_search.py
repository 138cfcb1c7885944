"""Ranked lexical search without random access: lists sorted by impact are read from the top until the answer is certain.

The score of a document for an item is a sum of impacts, one for each of the item's terms.  A term's list holds the
documents with it, largest impact first.  Reading goes level by level down all lists of an item.  What was read of a
document is a lower bound of its score; the next unread impact of each list where it was not met is the most it can still
gain.  Reading ends when no document outside the best can reach them, ties included, and the scores of the best are exact.

One pass over the texts counts the terms of the items in every document, since a document's length and a term's weight
need the whole corpus.  A document's impacts lie in one place, so documents do not move: a task sorts the lists of some
thousand documents at a time, searches them against the best it has found so far, and hands on its best of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

K = 10
#: Bytes of items held by a task at once; beyond that they come in blocks.
BLOCK_BYTES = 32 << 20
#: Postings and documents whose lists a task sorts at a time.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 16
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Each level of impacts reaches down to this part of the one before.
LEVEL = 4
#: Terms are runs of ASCII letters and digits and of everything outside ASCII: other bytes become blanks, A-Z small.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, a bounded piece at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(FOLD)
        at += PIECE
        while at < len(text) and not piece.endswith(b" "):  # a term is not cut, however long
            more = text[at : at + 64].translate(FOLD)
            stop = more.find(b" ") + 1 or len(more)
            piece, at = piece + more[:stop], at + stop
        yield piece.split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Level:
    """The lists of one item over the documents of a chunk, read from the top."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int):
        self.lists = [x for x in lists if len(x[0])]
        self.at = np.zeros(len(self.lists), np.int64)
        self.lower = np.zeros(n_docs, np.int64)
        self.seen = np.zeros((len(self.lists), n_docs), bool)
        self.next = np.array([impacts[0] for _, impacts in self.lists], np.int64)

    def read(self, least: int, only: np.ndarray | None) -> None:
        """Read every list down to impacts of ``least``; with ``only`` other documents are passed over."""
        for t in np.flatnonzero(self.next >= least):
            docs, impacts = self.lists[t]
            a = self.at[t]
            b = a + np.searchsorted(-impacts[a:], -least, "right")
            met, gain = docs[a:b], impacts[a:b]
            if only is not None:
                inside = only[met]
                met, gain = met[inside], gain[inside]
            self.lower[met] += gain
            self.seen[t, met] = True
            self.at[t], self.next[t] = b, impacts[b] if b < len(impacts) else 0

    def upper(self, docs: np.ndarray) -> np.ndarray:
        return self.lower[docs] + self.next @ ~self.seen[:, docs]


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``k`` best, with ties at the last place, and their exact scores.

    ``floor``: score that ``k`` documents elsewhere have already, 0 if there are not so many.
    """
    state, open_docs, inside = Level(lists, n_docs), None, None
    while len(state.next) and state.next.any():
        state.read(max(1, int(state.next.max()) // LEVEL), inside)
        known = state.lower if open_docs is None else state.lower[open_docs]
        least = max(floor, int(np.partition(known, -k)[-k]) if len(known) >= k else 0, 1)
        rest = int(state.next.sum())
        if open_docs is None:
            if rest >= least:
                continue  # a document not met yet may still be among the best
            open_docs, inside = np.flatnonzero(state.lower + rest >= least), np.zeros(n_docs, bool)
        upper = state.upper(open_docs)
        open_docs, gaining = open_docs[upper >= least], (upper > state.lower[open_docs])[upper >= least]
        inside[:] = False
        inside[open_docs] = True
        if not gaining.any():
            break
    if open_docs is None:
        open_docs = np.flatnonzero(state.lower >= max(floor, 1))
    return open_docs, state.lower[open_docs]


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, number of terms ``n``, and the known ``terms`` with their ``counts``, for each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value.get
        for batch in slices(batches):
            n, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                total, found = 0, Counter()
                for piece in terms_of(text or b""):
                    total += len(piece)
                    found.update(map(look, piece))
                found.pop(None, None)
                n.append(total), terms.append(list(found)), counts.append(list(found.values()))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "counts"],
            )
            yield out.filter(pa.array(np.array(n, np.int64) > 0))

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").where("text is not null")
    return rows.mapInArrow(count, COUNTED)


class Best:
    """The best documents of an item so far: score, document, and whether its id is null."""

    def __init__(self):
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, ids, nulls.astype(np.int64)], 1)])
        self.rows = rows[np.lexsort((rows[:, 1], rows[:, 2], -rows[:, 0]))[:k]]

    def floor(self, k: int) -> int:
        return int(self.rows[-1, 0]) if len(self.rows) == k else 0


def _pass(docs: DataFrame, items: dict, k: int, id_col: str, text_col: str) -> DataFrame:
    """The best documents of each of ``items`` (id: its terms) in every task: ``item``, ``doc_id``, ``score``."""
    vocabulary: dict[bytes, int] = {}
    wanted = [(item, sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms})) for item, terms in items.items()]
    found = cut(counted(docs, vocabulary, id_col, text_col))
    n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more rows than terms of these items
        weights[r["term"]] = weight(n_docs, r["count"])
    shared = docs.sparkSession.sparkContext.broadcast((wanted, weights))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held, postings, rows = [], 0, 0
        for batch in batches:
            held.append(batch)
            postings, rows = postings + len(batch.column("terms").flatten()), rows + batch.num_rows
            if postings >= POSTINGS or rows >= DOCUMENTS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, postings, rows = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        tops = [Best() for _ in wanted]
        for table in chunks(batches):
            ids = table.column("doc_id")
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            n, lists = table.column("n").to_numpy(), table.column("terms").combine_chunks()
            term, tf = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            m = 10 + (90 * n * n_docs) // length
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            order = np.lexsort((-impact, term))
            order = order[impact[order] > 0]
            term, doc, impact = term[order], doc[order], impact[order]
            starts = np.searchsorted(term, np.arange(len(weights) + 1))
            for (_, terms), top in zip(wanted, tops):
                lists = [(doc[starts[t] : starts[t + 1]], impact[starts[t] : starts[t + 1]]) for t in terms]
                near, scores = best(lists, len(n), top.floor(k), k)
                if len(near):
                    top.add(scores, ids[near], nulls[near], k)
        rows = [(i, None if null else doc, score) for i, top in enumerate(tops) for score, doc, null in top.rows.tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return found.mapInArrow(search, "item int, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Terms are runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased.  Scores are above 0; equal ones go by
    ascending id, nulls last.  Rows of ``docs`` are documents of their own, even if ids repeat; rows of ``items`` with one id
    (null included) are one item with the terms of all.  Null and empty texts have no terms, so nothing ranks them.
    """
    texts = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 if size <= block_bytes else int(2 * size // block_bytes) + 1
    done = None
    for b in range(blocks):
        held: dict = {}
        for item_id, text in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():  # at most about block_bytes, just measured
            for piece in terms_of(text.encode()):
                held.setdefault(item_id, set()).update(piece)
        names = list(held)
        found = _pass(docs, held, k, id_col, text_col)
        named = docs.sparkSession.createDataFrame(list(enumerate(names)), "item int, item_id long")
        found = found.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")  # the ids of these items
        found = found if blocks == 1 else cut(found)
        done = found if done is None else done.union(found)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return done.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
