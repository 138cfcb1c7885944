"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text: every byte shifts it by one bit and adds the byte's random number, so it
depends on the last sixteen bytes only.  Anchors are where the hash falls below a threshold; they move with the text.  A chunk
starts at every anchor and ends at the first anchor at least ``LEAST`` bytes on, so chunks overlap, each is long enough not
to recur by chance, and an insertion changes the chunks around it and no others.  Chunks are compared by digest: the document
of smallest id that holds a chunk keeps it, others lose it where such chunks make at least ``MIN_SPAN`` bytes in a row.

Two passes deal small rows by digest.  The first keeps the smallest and largest document of each, summed before the
shuffle; digests of two or more documents are written.  The second joins the chunks to them, and hot digests are split.
Repeats inside one document are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices, texts_of

#: Bytes between anchors on average, and at most; bytes of a chunk at least; bytes in a row that make a repeat.
AVERAGE = 16
LONGEST = 512
LEAST = 56
MIN_SPAN = 72
WINDOW = 16


def gear_table() -> np.ndarray:
    """A random number per byte value, by a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes((b,)), 0x67656172) for b in range(256)], np.uint32)


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sums of 2, 4, 8, 16 bytes, each from two of the half length."""
    h = table[data]
    k = 1
    while k < WINDOW:
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
        k *= 2
    return h


def anchors(data: np.ndarray, table: np.ndarray, average: int = AVERAGE, longest: int = LONGEST) -> np.ndarray:
    """Anchors in a text's UTF-8 bytes, and its end.  Characters stay whole; a stretch without an anchor gets one at ``longest``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    inside = np.r_[(data[1:] & 0xC0) == 0x80, False]
    ends = np.flatnonzero((gear(data, table) < np.uint32(2**32 // average)) & ~inside) + 1
    ends = ends if len(ends) and ends[-1] == n else np.r_[ends, n]
    gaps = np.diff(np.r_[0, ends])
    if gaps.max() <= longest:
        return ends
    out, start = [], 0
    for end in ends.tolist():
        while end - start > longest:
            start += longest
            while inside[start - 1]:
                start -= 1
            out.append(start)
        out.append(end)
        start = end
    return np.array(out)


def chunks(data: np.ndarray, table: np.ndarray, average: int = AVERAGE, longest: int = LONGEST, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a text.  A text below ``least`` bytes has none."""
    ends = anchors(data, table, average, longest)
    begin = np.r_[0, ends[:-1]] if len(ends) else ends
    at = np.searchsorted(ends, begin + least)
    whole = at < len(ends)
    return begin[whole], ends[at[whole]]


def chunk_rows(docs: DataFrame, average: int, longest: int, places: bool) -> DataFrame:
    """One row per chunk: ``digest``, ``doc``; with ``places`` also ``start`` and ``size`` in bytes."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digest = gear_table(), xxhash.xxh3_64_digest
        for batch in slices(batches, 256):
            digests, docs_of, starts, sizes = [], [], [], []
            for doc, text in zip(batch.column("doc").to_pylist(), texts_of(batch)):
                raw = text.encode()
                begin, ends = chunks(np.frombuffer(raw, np.uint8), table, average, longest)
                found = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]), np.int64)
                if not places and len(found):
                    found = np.unique(found)
                digests.append(found), docs_of.append((doc, len(found))), starts.append(begin), sizes.append(ends - begin)
            docs_col = pa.array(np.repeat(np.array([d or 0 for d, _ in docs_of], np.int64), [n for _, n in docs_of]), mask=np.repeat([d is None for d, _ in docs_of], [n for _, n in docs_of]))
            arrays, names = [pa.array(np.concatenate(digests)), docs_col], ["digest", "doc"]
            if places:
                arrays += [pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32))]
                names += ["start", "size"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(cut_up, "digest long, doc long" + ", start int, size int" * places)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE, longest: int = LONGEST, min_span: int = MIN_SPAN) -> DataFrame:
    """Spans that a document of smaller id holds too: ``doc_id``, ``start``, ``size`` (bytes), ``first_doc_ids``.

    Rows that share an id are one document.  A row without an id keeps all its text and takes none from others.  Null, empty
    and very short texts have no chunks.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc", f"`{text_col}` text").where("doc is not null")
    held = chunk_rows(rows, average, longest, False).groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = cut(held.where("first <> last").select("digest", "first"), clear=True)
    again = chunk_rows(rows, average, longest, True).join(repeated, "digest").where("doc <> first").distinct()
    by_place = Window.partitionBy("doc").orderBy("start")
    reach = F.max(F.col("start") + F.col("size")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    islands = again.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("island", F.sum("new").over(by_place))
    spans = islands.groupBy("doc", "island").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("size")) - F.min("start")).alias("size"), F.array_sort(F.collect_set("first")).alias("first_doc_ids")
    )
    return spans.where(F.col("size") >= min_span).select(F.col("doc").alias("doc_id"), "start", "size", "first_doc_ids")


def drop_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``: the text without the bytes of ``spans``."""
    per_doc = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("_spans")).withColumnRenamed("doc_id", "_doc")
    joined = docs.join(per_doc, docs[id_col].cast("long") == per_doc["_doc"], "left")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    kept = F.expr(
        f"""concat(aggregate(_spans, named_struct('at', 0, 'out', cast('' as binary)),
            (s, x) -> named_struct('at', x.start + x.size, 'out', concat(s.out, substring(cast(`{text_col}` as binary), s.at + 1, x.start - s.at)))).out,
            substring(cast(`{text_col}` as binary), element_at(_spans, -1).start + element_at(_spans, -1).size + 1))"""
    ).cast("string")
    return joined.withColumn("kept_text", F.when(F.col("_doc").isNull(), text.cast("string")).otherwise(kept)).drop("_doc", "_spans")


def substring_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE, longest: int = LONGEST, min_span: int = MIN_SPAN) -> DataFrame:
    """One row per document that loses text: ``doc_id``, ``n_spans``, ``n_bytes``, ``first_doc_ids``, ``spans``."""
    spans = repeated_spans(docs, id_col, text_col, average, longest, min_span)
    return spans.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), F.sum("size").cast("long").alias("n_bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_doc_ids")))).alias("first_doc_ids"),
        F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"),
    )
