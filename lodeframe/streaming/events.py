"""Structured Streaming over event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..session import shared_dir


def counts(stream: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window and type; events later than ``late`` are left out."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def file_source(spark: SparkSession, path: str) -> DataStreamReader:
    """A reader of a table's folder, or of a single file as the one of its name in its folder."""
    return spark.readStream.option("pathGlobFilter", path.rpartition("/")[2]) if _is_file(spark, path) else spark.readStream


def hourly_counts(spark: SparkSession, path: str, late: str = "2 days", folder: str | None = None) -> DataFrame:
    """Runs the stream over all files that are there and returns its table.

    Windows that the watermark closes are appended to a Parquet table; those still
    open are read from the stream's own state, so no row is read twice. ``folder``
    holds table and checkpoint: a later run with the same one reads only files
    that are new since. Without it both are new.
    """
    schema = spark.read.parquet(path).schema
    source = file_source(spark, path).schema(schema).parquet(path if not _is_file(spark, path) else path.rpartition("/")[0])
    folder = folder or shared_dir(spark, "stream")
    out, checkpoint = f"{folder}/counts", f"{folder}/checkpoint"
    stream = counts(source, late=late)
    run = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    run.awaitTermination()
    shown = lambda df: df.select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))
    done = shown(spark.read.schema(stream.schema).parquet(out))
    state = spark.read.format("statestore").load(checkpoint)
    held = state.schema["value"].dataType.names  # the count, the sum
    open_ = state.select(F.col("key").getField(state.schema["key"].dataType.names[0]).alias("w"), F.col("key").getField(state.schema["key"].dataType.names[1]).alias("event_type"), F.col("value").getField(held[0]).alias("n"), F.col("value").getField(held[1]).alias("total"))
    return done.unionByName(shown(open_))
