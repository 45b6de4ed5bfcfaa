"""Shared plumbing of the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: One Arrow batch stays near this size, so that a Python worker's memory doesn't follow the table.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes; very long texts then travel in batches of a few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one will do as
    long as all runs on one machine (tests); a cluster must name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "cadastra-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the disk of shuffles that nothing reads any more: their files go when the driver's JVM, which else may
    wait for long, collects the plans that name them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_table(df: DataFrame, stem: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets of length n + 1) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    return data[lo : int(offsets[-1])], offsets - lo


def texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def narrow(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, cast; extra columns, whatever their names, are left behind."""
    return df.select(*(df[c].cast(kind).alias(c) for c, kind in wanted.items()))


def free_names(df: DataFrame, count: int) -> list[str]:
    """Column names that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"__own{i}" for i in range(count + len(taken))) if c not in taken][:count]


class TwoGenerations:
    """A memo of bounded size: of two generations, the older goes when the younger is full. Keys longer than LONGEST
    are forgotten after their batch, so the bound on keys is one on bytes."""

    LONGEST = 256

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.long = limit // 2, {}, {}, []

    def missing(self, keys) -> list:
        """Keys that must be computed; those known from the older generation move to the younger one."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        self.long += [k for k in out if len(k) > self.LONGEST]
        return out

    def settle(self) -> None:
        """Between batches: a full younger generation becomes the older one."""
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            yield b
