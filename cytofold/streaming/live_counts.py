"""Counts over call files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.counts import methylated


def stream_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls (chrom, pos, meth, sample) of text files put into a folder; the sample is the file's name."""
    lines = spark.readStream.format("text").load(folder).withColumn("_f", F.split(F.trim("value"), r"\s+")).where("size(_f) = 3")
    return lines.select(F.get("_f", F.lit(0)).alias("chrom"), F.expr("try_cast(_f[1] AS INT)").alias("pos"), F.get("_f", F.lit(2)).startswith("+").alias("meth"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("sample"))


def live_window_counts(calls: DataFrame, width: int) -> DataFrame:
    """Running counts by window and sample; for output mode update or complete."""
    return calls.withColumn("bin_id", F.floor((F.col("pos") - 1) / width)).groupBy("chrom", "bin_id", "sample").agg(*methylated(""))


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of timed events by type; a window closes once the watermark has passed it."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    made = timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
