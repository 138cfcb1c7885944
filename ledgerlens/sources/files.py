"""Readers and writers for document corpora and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under ``path``; content is read only by queries that use the ``content`` column."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    mime = (
        F.when(ext == "pdf", "application/pdf").when(ext.isin("jpg", "jpeg"), "image/jpeg")
        .when(ext.isin("tif", "tiff"), "image/tiff").when(ext.isin("png", "webp"), F.concat(F.lit("image/"), ext))
        .otherwise("application/octet-stream")
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("nombre_archivo"),
        mime.alias("tipo_mime"),
        F.col("length").alias("tamano_bytes"),
        F.col("modificationTime").alias("modificado"),
        "content",
    )


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``(doc_id, text)`` with the path as id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def manifest(files: DataFrame, batch: Column, channel: str = "web") -> DataFrame:
    """Upload manifest row per file: content hash, storage key, size, mime, channel, batch."""
    return files.select(
        batch.alias("batch_id"),
        F.lit(channel).alias("canal_entrada"),
        "nombre_archivo",
        F.sha2("content", 256).alias("hash_archivo"),
        F.concat_ws(".", F.sha2(F.col("path"), 256), F.regexp_extract("nombre_archivo", r"\.([^.]+)$", 1)).alias("storage_key"),
        "tipo_mime",
        "tamano_bytes",
    )


def upload_rows(manifest_rows: DataFrame, user_id: int, ip: str, now: Column, *carried: str) -> dict[str, DataFrame]:
    """The document, job and audit frames one upload writes; all three derive from the same manifest.

    ``carried`` columns of the manifest go along with the audit rows.
    """
    jobs = manifest_rows.select(
        "factura_id", F.lit("PENDIENTE").alias("estado"), F.lit(0).cast("bigint").alias("retry_count"), now.alias("created_at")
    )
    audit = manifest_rows.select(
        F.lit(user_id).cast("bigint").alias("usuario_id"),
        "factura_id",
        F.lit("SUBIDA").alias("accion"),
        F.to_json(F.struct(F.col("nombre_archivo").alias("archivo"), F.col("tamano_bytes").alias("tamano"))).alias("detalle_json"),
        F.lit(ip).alias("ip_address"),
        now.alias("created_at"),
        *carried,
    )
    return {"documents": manifest_rows.withColumn("fecha_subida", now), "jobs": jobs, "audit": audit}


def write_results(df: DataFrame, path: str, issue_date: str = "fecha") -> None:
    """Result table partitioned by the year and month of the issue date, sorted by client inside a file."""
    month = F.coalesce(F.nullif(F.substring(F.col(issue_date), 1, 7), F.lit("")), F.lit("unknown"))
    out = df.withColumn("mes", month)
    sort = [c for c in ("cliente_id", "created_at") if c in out.columns]
    if sort:
        out = out.sortWithinPartitions("mes", *sort)
    out.write.mode("overwrite").partitionBy("mes").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
