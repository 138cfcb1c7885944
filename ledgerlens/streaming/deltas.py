"""Mergeable partial aggregates of a stream, kept as a table.

Each micro-batch adds a delta, its own partial aggregate.  A delta never waits for a watermark and never drops a row: rows
that come late are one more delta for an old key.  Now and then the deltas are merged into the base, bucket by bucket, so
that only buckets that the deltas touch are read and written again.  Nothing is held in memory between micro-batches.

    <folder>/deltas/batch=<id>              what a micro-batch adds; written by overwrite, so a batch that runs twice counts once
    <folder>/base/gen=<id>/bucket=<bucket>  all up to micro-batch <id>
    <folder>/marks/upto=<id>                generation of each bucket, once deltas up to <id> are merged
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import shared_folder

MERGE_EVERY = 16


def remove(path: str) -> None:
    store, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


class DeltaStore:
    """Keys with values that merge by a built-in aggregate, such as counts by ``sum`` or the newest time by ``max``.

    ``shape`` turns a micro-batch into rows with the keys, the values and ``bucket``, a text that depends on the keys alone
    (their day, a prefix of their hash): it decides what a merge rewrites.
    """

    def __init__(self, stream: DataFrame, name: str, shape: Callable[[DataFrame], DataFrame], merges: dict[str, str], merge_every: int = MERGE_EVERY):
        self.spark: SparkSession = stream.sparkSession
        self.folder, self.shape, self.merges, self.merge_every = shared_folder(self.spark, name), shape, merges, merge_every
        fields = shape(stream).schema.fields
        self.keys = [f.name for f in fields if f.name not in (*merges, "bucket")]
        self.schema = T.StructType([f for f in fields if f.name != "bucket"])
        self.upto, self.gens = -1, {}
        self.progress: list = []  # of the micro-batches of the last run
        self._stale: list[str] = []

    def _read(self, below: str, *partitions: T.StructField) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, *partitions])).parquet(f"{self.folder}/{below}")

    def _deltas(self, after: int, before: int | None) -> DataFrame:
        rows = self._read("deltas", T.StructField("bucket", T.StringType()), T.StructField("batch", T.LongType())).where(F.col("batch") > after)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def _base(self, buckets: Iterable[str] | None) -> DataFrame | None:
        live = {b: g for b, g in self.gens.items() if buckets is None or b in set(buckets)}
        if not live:
            return None
        # only these folders are listed and read, however many others there are
        schema = T.StructType([*self.schema.fields, T.StructField("gen", T.LongType()), T.StructField("bucket", T.StringType())])
        paths = [f"{self.folder}/base/gen={g}/bucket={b}" for b, g in sorted(live.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/base").parquet(*paths).drop("gen")

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", *self.keys).agg(*[getattr(F, how)(c).alias(c) for c, how in self.merges.items()])

    def rows(self, buckets: list[str] | None = None, before: int | None = None) -> DataFrame:
        """Keys and values, ``bucket`` with them; of some buckets only, or before a micro-batch."""
        found = self._deltas(self.upto, before)
        found = found if buckets is None else found.where(F.col("bucket").isin(buckets))
        base = self._base(buckets)
        return self._merged(found if base is None else base.unionByName(found))

    def table(self) -> DataFrame:
        return self.rows().drop("bucket")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The step of ``foreachBatch``."""
        self.append(self.shape(batch), batch_id)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Rows that have their shape already, as the delta of a micro-batch."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch_id}")
        if batch_id - self.upto >= self.merge_every:
            self.merge(batch_id)

    def merge(self, upto: int) -> None:
        """Take the deltas up to a micro-batch into the base.  The mark comes last, so a merge that fails leaves all as it was."""
        if upto <= self.upto:
            return
        fresh = self._deltas(self.upto, upto + 1)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # as many as these deltas have buckets
        base = self._base(touched)
        merged = self._merged(fresh if base is None else base.unionByName(fresh))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/gen={upto}")
        gens = {**self.gens, **dict.fromkeys(touched, upto)}
        marks = self.spark.createDataFrame(list(gens.items()), "bucket string, gen long")
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/upto={upto}")
        # what the merge before this one replaced: nobody reads it any more
        for path in self._stale:
            remove(path)
        self._stale = [f"{self.folder}/deltas/batch={k}" for k in range(self.upto + 1, upto + 1)]
        self._stale += [f"{self.folder}/base/gen={self.gens[b]}/bucket={b}" for b in touched if b in self.gens]
        self.upto, self.gens = upto, gens

    def resume(self) -> DeltaStore:
        """Take up the newest mark of an earlier run in this folder."""
        rows = self.spark.read.schema("bucket string, gen long, upto long").parquet(f"{self.folder}/marks")
        newest = rows.agg(F.max("upto")).first()[0]
        if newest is not None:
            self.upto, self.gens = newest, {r["bucket"]: r["gen"] for r in rows.where(F.col("upto") == newest).collect()}
        return self


def drain_into(store: DeltaStore, stream: DataFrame, write: Callable[[DataFrame, int], None] | None = None) -> DeltaStore:
    """Run a stream over what is there now into a store."""
    query = (
        stream.writeStream.option("checkpointLocation", f"{store.folder}/checkpoint")
        .foreachBatch(write or store.write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    store.progress = query.recentProgress
    if not store.progress or not any(p["numInputRows"] for p in store.progress):  # an empty stream has no micro-batch: an empty delta stands for it
        store.shape(store.spark.createDataFrame([], stream.schema)).write.mode("overwrite").parquet(f"{store.folder}/deltas/batch=0")
    return store
