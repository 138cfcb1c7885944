"""Streams over table files, and sinks that survive a replayed batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Files one micro-batch takes unless the caller says otherwise: what bounds the rows a task sees at once.
FILES_PER_TRIGGER = 200


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream with its schema, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger or FILES_PER_TRIGGER)
    # a pattern, since a stream takes folders and patterns but no single file
    return reader.parquet(f"{sf_dir}/{table}.parque[t]")


def drain(stream: DataFrame, name: str, mode: str = "update", shape=None):
    """Run a stream over what is there now.  Each micro-batch, after ``shape``, is written to its own folder by
    overwrite, so a batch that runs twice leaves one copy.  Returns the sink table (with ``batch``) and the
    finished query."""
    spark = stream.sparkSession
    # state of keyed operators lives in RocksDB, on disk rather than on the heap
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = shared_folder(spark, name)
    sink, schema = f"{base}/table", T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if shape is None else shape(batch)
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(sink), query
