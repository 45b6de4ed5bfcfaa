"""Incremental arrival of files and reads, on Structured Streaming file sources with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, each once."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def take_in(stream: DataFrame, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Processes what has arrived since the last run and appends it to the target; a batch that is repeated after a
    failure overwrites its own folder, so each file counts once."""
    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) by tumbling windows with a watermark; at may be a timestamp without zone."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    g = timed.groupBy(F.window("_at", window).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")
