"""Shared by the operators: tables, lineage cuts, Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
from collections.abc import Callable, Iterator

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as Java and Python patterns and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table of the same.
LOWER_TABLE = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(c: Column) -> Column:
    """crc32 of an id as text, the number that deals documents into folds."""
    return F.crc32(c.cast("string").cast("binary"))


#: Has Spark delete the shuffle files of a query when the query ends.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clear: bool = False) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset a temporary folder serves, but only if driver and executors are one process.  ``clear``: the
    shuffle files behind ``df`` go once it is written, rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(shared)
    if not clear:
        return df.checkpoint(eager=True)
    before = spark.conf.get(CLEAR, None)
    spark.conf.set(CLEAR, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEAR) if before is None else spark.conf.set(CLEAR, before)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def longs_of(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded count, so that what is built per piece stays small.

    At the end of a task the system gets freed memory back: the worker stays for other stages, beside the JVM.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next, such as a loaded vocabulary: made once per process.

    Workers outlive a stage, so making something ends the keeping of what an earlier operator made.
    """
    shelf = sys.modules.setdefault("_ledgerlens_kept", types.ModuleType("_ledgerlens_kept")).__dict__.setdefault("made", {})
    if key not in shelf:
        shelf.clear()
        shelf[key] = make()
    return shelf[key]


class Recent(dict):
    """Answers a worker remembers, in two generations: when the young one is full it becomes the old one, and what is
    asked again moves back.  Frequent keys thus stay while the many that occur once go; memory stays bounded."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def missing(self, keys) -> list:
        """Of ``keys``, those that must be learned; all others can be read from here afterwards."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = []
        for k in [k for k in keys if k not in self]:
            if (found := self.old.get(k)) is None:
                new.append(k)
            else:
                self[k] = found
        return new
