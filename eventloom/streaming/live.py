"""Extension: the classifier and tumbling counts over a stream. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.classify import classify, dataset_type


def classified(stream: DataFrame, line: str = "log_message") -> DataFrame:
    return stream.withColumn("event_token", classify(F.col(line))).withColumn("dataset_type", dataset_type(F.col("event_token")))


def tumbling_counts(stream: DataFrame, at: str, by: list[str], width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Counts by key and window, in append mode once the watermark has passed."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(F.col("window.start").alias("bin_start"), *by, "cnt")
