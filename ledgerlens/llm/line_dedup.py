"""Line dedup: hashes dealt by range, sorted by document and position, streamed once; answers are bitmaps, not text.

Every line long enough becomes a row (128-bit hash of its key, document, line number).  Rows are range-partitioned and
sorted by (hash, document descending, line number): all lines with one key lie side by side, the largest document first.
Ranges split anywhere, so one key may fill many partitions; what a partition must know of its neighbours is the state of
the run it starts or ends with, two rows per partition.  A stream over each partition then tells the lines that go.

Documents get back a map {line number div 64: 64 keep bits}.  Blocks that keep all their lines have no entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut, free_name, longs_of

MIN_KEY = 20
MIN_DOCS = 3
#: Stands for a null id, which counts as one document below all others.
NULL_DOC = -(2**63)
ENDS = "part long, h1 long, h2 long, largest long, smallest long, docs int, place int"
DROPPED = "doc long, text_hash long, block int, bits long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """One row per line with a key of at least ``min_key`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_key).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_key)
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.concat(F.lit("|"), "key")).alias("h2"),
        F.coalesce("doc", F.lit(NULL_DOC)).alias("doc"), "text_hash", "pos",
    )


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Start of each run of equal hashes."""
    return np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, int)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition: key, largest and smallest document, number of documents."""
    part, runs = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = int(longs_of(batch, "part")[0])
        h1, h2, doc = (longs_of(batch, c) for c in ("h1", "h2", "doc"))
        starts = _runs(h1, h2)
        ends = np.r_[starts[1:], len(h1)]
        new_doc = np.r_[True, doc[1:] != doc[:-1]]
        new_doc[starts] = True
        for k in sorted({0, len(starts) - 1}):
            a, b = int(starts[k]), int(ends[k])
            n = int(new_doc[a:b].sum())
            if k == 0 and runs and runs[-1][:2] == [h1[a], h2[a]]:
                runs[-1][4] += n - int(runs[-1][3] == doc[a])
                runs[-1][3] = doc[b - 1]
            else:
                runs.append([h1[a], h2[a], doc[a], doc[b - 1], n])
        if len(runs) > 2:
            runs = [runs[0], runs[-1]]
    if part is not None:
        rows = [(part, *map(int, r), i) for i, r in enumerate(runs)]
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["part", "h1", "h2", "largest", "smallest", "docs", "place"])


def straddling(ends: list, min_docs: int) -> dict[tuple[int, int], tuple[int, bool]]:
    """Largest document, and whether there are enough documents, of each key that lies in more than one partition."""
    pieces: dict[tuple[int, int], list] = {}
    for r in sorted(ends, key=lambda r: (r.part, r.place)):
        pieces.setdefault((r.h1, r.h2), []).append(r)
    found = {}
    for key, rs in pieces.items():
        if len(rs) > 1:
            shared = sum(a.smallest == b.largest for a, b in zip(rs, rs[1:]))  # a document that a border cuts
            found[key] = (rs[0].largest, sum(r.docs for r in rs) - shared >= min_docs)
    return found


def _dropped(batches: Iterator[pa.RecordBatch], known: dict[tuple[int, int], tuple[int, bool]], min_docs: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None  # rows of a run that may still reach min_docs
    decided: tuple[int, int, int] | None = None  # key and largest document of a run that has

    def emit(cols, gone):
        doc, text_hash, pos = cols[2][gone], cols[3][gone], cols[4][gone]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(text_hash), pa.array((pos >> 6).astype(np.int32)), pa.array((np.uint64(1) << (pos & 63).astype(np.uint64)).view(np.int64))],
            names=["doc", "text_hash", "block", "bits"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [longs_of(batch, c) for c in ("h1", "h2", "doc", "text_hash", "pos")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        h1, h2, doc = cols[:3]
        starts = _runs(h1, h2)
        lengths = np.diff(np.r_[starts, len(h1)])
        new_doc = np.r_[True, doc[1:] != doc[:-1]]
        new_doc[starts] = True
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        first = doc[starts].copy()
        enough = docs >= min_docs
        if decided is not None and decided[:2] == (h1[0], h2[0]):
            first[0], enough[0] = decided[2], True
        for k in {0, len(starts) - 1}:
            if (key := (int(h1[starts[k]]), int(h2[starts[k]]))) in known:
                first[k], enough[k] = known[key]
        last = len(starts) - 1
        decided = (h1[-1], h2[-1], first[last]) if enough[last] else None
        gone = np.repeat(enough, lengths) & (doc != np.repeat(first, lengths))
        # a run below min_docs waits for the next batch: the lines of at most min_docs - 1 documents, or of a known key
        held = None if enough[last] else [c[starts[last]:].copy() for c in cols]
        yield emit(cols, gone)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the documents that lose lines: ``doc`` (null ids as ``NULL_DOC``), ``text_hash``, ``n_dropped``, ``keep``.

    Two rows with one id count as one document; rows with equal text get equal bitmaps.
    """
    rows = line_rows(docs, id_col, text_col, min_key)
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")))
    known = straddling(dealt.mapInArrow(_ends, ENDS).collect(), min_docs)
    gone = dealt.mapInArrow(lambda batches: _dropped(batches, known, min_docs), DROPPED)
    blocks = gone.groupBy("doc", "text_hash", "block").agg(F.bit_or("bits").alias("bits"))
    entry = F.struct("block", F.bitwise_not("bits").alias("bits"))
    return blocks.groupBy("doc", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("keep")
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; a null or empty text is one empty line.

    A line goes if its key (ends stripped, A-Z lower-cased) has ``min_key`` code points, at least ``min_docs`` documents
    hold it, and this is not the largest of them.  Other columns pass through; those named like the new ones are replaced.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc, hash_, n, bits = (free_name(docs, c) for c in ("doc", "hash", "n", "keep"))
    found = keep_bitmaps(docs, id_col, text_col, min_key, min_docs)
    found = found.select(F.col("doc").alias(doc), F.col("text_hash").alias(hash_), F.col("n_dropped").alias(n), F.col("keep").alias(bits))
    rows = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_DOC)), hash_: F.xxhash64(text)})
    joined = rows.join(found.hint("shuffle_hash"), [doc, hash_], "left")
    kept = F.filter(
        F.split(text, "\n", -1),
        lambda line, i: F.coalesce(F.getbit(F.element_at(bits, (i / 64).cast("int")), i % 64), F.lit(1)) == 1,
    )
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in new],
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(n, F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col(n).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
