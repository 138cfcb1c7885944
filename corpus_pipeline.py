"""From raw documents to token ids: five stages, each one operator of ``ledgerlens.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  Null
texts count as empty in every stage, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import quality_fm
from ledgerlens.llm.common import cut, free_name, table
from ledgerlens.llm.line_dedup import drop_lines
from ledgerlens.llm.sentencepiece_codec import encode_documents
from ledgerlens.llm.shingle_jaccard import near_copies
from ledgerlens.llm.string_tiling import drop_contaminated

TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts.  It learns from the labels outside the held-out fold."""
    model = quality_fm.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality_fm.score(docs, model, name=score).where(F.col(score) >= quality_fm.THRESHOLD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that larger ids hold too, ``n_chars`` counted anew.

    A document all of whose lines stand in larger ids stays with what is left, maybe an empty text.
    """
    aside = {c: free_name(docs, c) for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "kept_text")}
    kept = drop_lines(docs.withColumnsRenamed(aside))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new.get(c, F.col(aside.get(c, c))).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.  Rows without an id stay.

    SimHashes of five words link in tiles, as in ``op3``, and a link holds where the 5-word Jaccard similarity is 0.8 or more.
    Pairs at 0.8 differ in about ten of 64 bits, as far as tiles would have to compare everything with everything: banded
    minimum hashes propose those that the tiles do not.
    """
    told = near_copies(docs)
    gone = free_name(docs, "gone")
    copies = told.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies.hint("shuffle_hash"), F.col("doc_id") == F.col(gone), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left: ``doc_id``, ``n_pieces``, ``ids``, ``n_unknown``, ``round_trip``, ``parity``."""
    return encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learned classifier nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
