"""Streaming forms of batch operators. An extension: the batch functions do the work on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clausegrid.sources.sinks import append_remaining


def files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).parquet(folder)


def unique_log(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str) -> None:
    """Runs a batch transformation on everything there is and appends rows whose key is not there yet; a repeated batch adds nothing."""
    query = stream.writeStream.foreachBatch(lambda df, _: append_remaining(transform(df), out, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
