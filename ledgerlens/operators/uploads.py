"""Uploads: admission, manifest, batches, duplicates, routing of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import cut_lineage
from .windows import first_per, join_summary


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def admit_files(files: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """``accepted`` and the first ``reason`` against each file; rejected files stay in the frame."""
    reason = (
        F.when(~F.coalesce(file_extension(F.col("nombre_archivo")).isin(*K.ALLOWED_EXTENSIONS), F.lit(False)), "extension")
        .when(~F.coalesce(F.col("tipo_mime").isin(*K.ALLOWED_MIME), F.lit(False)), "mime")
        .when(F.col("tamano_bytes") > max_bytes, "size")
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def admit_requests(files: DataFrame, request: str, max_files: int = K.MAX_FILES_PER_REQUEST) -> DataFrame:
    """``request_ok`` per file: a request with more than ``max_files`` files is refused as a whole."""
    sizes = files.groupBy(request).agg(F.count(F.lit(1)).alias("n_files"))
    return join_summary(files, sizes, request, "n_files").withColumn("request_ok", F.col("n_files") <= max_files)


def engine_admits(files: DataFrame, max_bytes: int = K.MAX_ENGINE_BYTES) -> DataFrame:
    """``engine_ok`` per file: what the extraction engine takes; empty files and unknown sizes are refused."""
    size = F.col("tamano_bytes")
    return files.withColumn("engine_ok", F.coalesce((size > 0) & (size <= max_bytes), F.lit(False)))


def file_limits(files: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    return files.select(
        "*",
        F.col("tipo_mime").isin(*K.ALLOWED_MIME).alias("type_ok"),
        (F.col("tamano_bytes") <= max_bytes).alias("size_ok"),
    )


def admit_batch(uploads: DataFrame, clients: DataFrame) -> DataFrame:
    """Status per file: the client must exist for the firm; faults stay with their file."""
    known = clients.select(F.col("id").alias("cliente_id"), "asesoria_id", F.lit(True).alias("_known"))
    joined = admit_files(uploads).join(known, ["cliente_id", "asesoria_id"], "left")
    error = F.when(F.col("_known").isNull(), "client").otherwise(F.col("reason"))
    return joined.select(
        *uploads.columns,
        F.when(error.isNull(), "queued").otherwise("failed").alias("status"),
        error.alias("error"),
    )


def batch_summary(admitted: DataFrame) -> DataFrame:
    """Totals per batch; a batch is rejected only when nothing in it was accepted."""
    return (
        admitted.groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "queued").alias("accepted"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .withColumn("rejected", (F.col("accepted") == 0) & (F.col("failed") > 0))
    )


def duplicate_hashes(documents: DataFrame) -> DataFrame:
    """Contents stored more than once: how often, and the first document that had them."""
    return documents.groupBy("hash_archivo").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    ).filter("n > 1")


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """One row per copy, pointing at the first document with the same content.

    Copies are never gathered into one row: a content copied a million times gives a million rows, joined
    to its summary by broadcast.  Ids and hashes are written once, so that contents are read and hashed once."""
    hashed = cut_lineage(documents.select("id", "hash_archivo"))
    return join_summary(hashed, duplicate_hashes(hashed), "hash_archivo", "n").select(
        "id", "hash_archivo", "n", "first_id"
    )


def already_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New files whose content is stored already.

    Contents are matched once each, then joined back to the files with care for contents that many files
    share.  The new files are used three times: cut the lineage of frames that hash texts."""
    contents = new.groupBy("hash_archivo").agg(F.count(F.lit(1)).alias("n"))
    known = contents.join(stored.select("hash_archivo").distinct(), "hash_archivo", "left_semi")
    return join_summary(new, known, "hash_archivo", "n").drop("n")


def distinct_files(files: DataFrame) -> DataFrame:
    """First of the files with the same name, size and modification time."""
    return first_per(files, ["nombre_archivo", "tamano_bytes", "modificado"], [F.col("doc_id").asc()])


def route_text(pages: DataFrame) -> DataFrame:
    """Digital or OCR per document from its page texts ``(doc_id, page, text)``."""
    solid = F.length(F.regexp_replace("text", r"[ \n]", ""))
    trimmed = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    per = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.avg(solid).alias("mean_chars"), F.sum(trimmed).alias("chars")
    )
    digital = F.col("mean_chars") > 50
    return per.select(
        "doc_id", "pages",
        (digital & (F.col("chars") > 50)).alias("is_digital"),
        F.when(digital & (F.col("chars") > 50), "pdf").otherwise("ocr").alias("source"),
        (F.col("chars") < 20).alias("weak_read"),
    )


def page_report(blocks: DataFrame, limit: int = K.MAX_PAGES) -> DataFrame:
    """Pages of each document (by its last block), how many are read, and why the others are not."""
    per = blocks.groupBy("doc_id").agg((F.max("page") + 1).cast("long").alias("pages"))
    over = F.col("pages") > limit
    return per.select("doc_id", "pages", F.least("pages", F.lit(limit).cast("long")).alias("read"), F.when(over, F.lit(f"only the first {limit} pages are read")).alias("reason"))


def assemble_text(blocks: DataFrame, limit: int = K.MAX_PAGES) -> DataFrame:
    """Page text from positioned blocks: top to bottom, left to right; blank line between pages.

    Pages count from 0, and only the first ``limit`` are read: the rule runs on the scan, before a page is gathered in one
    row and then the pages of its document, which are therefore few.  ``page_report`` tells which documents have more.
    """
    block = F.struct(F.round("y", 1).alias("y"), F.round("x", 1).alias("x"), F.trim("text").alias("text"))
    page = blocks.filter((F.col("page") < limit) & (F.trim("text") != "")).groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(block)).alias("b")
    ).select("doc_id", "page", F.array_join(F.transform("b", lambda s: s["text"]), "\n").alias("text"))
    return page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p")).select(
        "doc_id", F.array_join(F.transform("p", lambda s: s["text"]), "\n\n").alias("text")
    )
