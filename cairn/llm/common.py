"""Helpers that the training-data operators share: row keys, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python stage works on so many bytes of text at a time, or on a single longer text.
SLICE_BYTES = 2 << 20

#: Bytes of the Arrow batches that a Python stage gets, for sessions that don't say themselves.
BATCH_BYTES = 4 << 20

#: A side of a join is broadcast only when it was counted and has at most so many rows (of a few longs each).
BROADCAST_ROWS = 500_000

#: This process's own folder, made only where spark.checkpoint.dir is unset.
_own: list[str] = []

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def give_back() -> None:
    """Returns memory that is free to the system: a worker outlives its task, and others share the executor with it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session that has no bound of its own. Results don't depend on it; it stays, as results are read later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def by_value(value: object) -> bytes:
    """A value for a broadcast, with the classes of this package that it is made of; held() has it back where the package isn't installed."""
    return cloudpickle.dumps(value)


def held(sent: Broadcast) -> object:
    """The value of a broadcast that by_value() made; unpickled anew at each call, so once a task."""
    return cloudpickle.loads(sent.value)


def bounded(batches: Iterable[pa.RecordBatch], text: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have at most `most` bytes together, but for a single longer text; empty batches are left out."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, stop - at)
            at = stop
    give_back()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where one machine does everything, it may be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='cairn-')}")
        base = _own[0]
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage, so that a lost executor costs only the tasks it ran.

    What a result still reads can't go before the result is read; the folder goes when the session ends, unless kept.
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        prepare(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/cairn/{name}-{uuid.uuid4().hex}"
        if not keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(path)
            files.deleteOnExit(path)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def cut(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and returns the written table."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Removes tables that nothing reads any more; all of them if none is named."""
        jvm = self.spark._jvm
        for at in [self.path(t) for t in tables] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns that an operator adds for itself: the wanted ones, with underscores behind those that df has already."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def kept_as(columns: Iterable[str], made: Iterable[str]) -> list[Column]:
    """Columns that a caller wants to keep beside those that are made; one with the name of a made column gets underscores behind its own."""
    have, out = {c.lower() for c in made}, []
    for c in columns:
        name = c
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return out


def row_key(*columns: str, names: tuple[str, str] | list[str] = ("_k1", "_k2")) -> list[Column]:
    """96 bits that identify a row by the given columns; equal rows share a key, nulls count as values."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in columns]
    return [F.xxhash64(*parts).alias(names[0]), F.hash(*parts).alias(names[1])]


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows allow that; otherwise Spark shuffles or splits as it sees fit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 2 modulo 4; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def texts_of(column: Iterable) -> list[str]:
    """Arrow strings as Python strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]
