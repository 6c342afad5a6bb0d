"""The attempts log as a stream: duplicates dropped within a watermark, rollups by window and session.  An extension; the batch operators are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import scratch


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, time: str, width: str, delay: str, value: str, *keys: str) -> DataFrame:
    """(window start, keys, n, total): tumbling windows; late rows beyond the delay are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Everything that is there now, in append mode, through a Parquet sink with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    out, at = scratch(spark, name), scratch(spark, f"{name}-progress")
    run = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _parts(spark: SparkSession, folder: str) -> tuple[str | None, list[str]]:
    """The newest complete base below a folder and the complete deltas after it."""
    from ..sources.writers import _fs

    fs, root = _fs(spark, folder)
    names = sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []
    done = [n for n in names if fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[1])]
    bases = [n for n in done if n.startswith("base-")]
    base = bases[-1] if bases else None
    return base, [n for n in done if n.startswith("delta-") and (base is None or n.removeprefix("delta-") > base.removeprefix("base-"))]


def read_latest(spark: SparkSession, folder: str, schema, keys: list[str], order: str) -> DataFrame:
    """The last row of each key among a base and its deltas."""
    from ..operators.ranking import dedup_last

    base, deltas = _parts(spark, folder)
    paths = [f"{folder}/{n}" for n in ([base] if base else []) + deltas]
    return dedup_last(spark.read.schema(schema).parquet(*paths), keys, order) if paths else spark.createDataFrame([], schema)


def latest(stream: DataFrame, folder: str, progress: str, keys: list[str], order: str, compact_every: int = 16) -> DataFrame:
    """Last write wins, with everything in the two folders, so that a restart goes on where it stopped.

    A micro-batch is compacted and written as a delta under its number: a repeated batch replaces its own delta.  Every `compact_every` batches base and
    deltas become the next base, so a batch costs its own size, not that of the table.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        from ..operators.ranking import dedup_last

        own = batch.sparkSession
        dedup_last(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/delta-{epoch:012d}")
        if epoch % compact_every == compact_every - 1:
            read_latest(own, folder, schema, keys, order).write.mode("overwrite").parquet(f"{folder}/base-{epoch:012d}")

    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()
    run.awaitTermination()
    return read_latest(spark, folder, schema, keys, order)
