"""Streams: hits over time windows, with the same expressions as the batch plans (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.operators.detection import cue_hits
from lensmark.plans.lenses import Lens


def stream_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Documents from JSON lines files as they arrive: doc_id, text, ts."""
    return spark.readStream.schema("doc_id string, text string, ts timestamp").json(folder)


def windowed_hits(docs: DataFrame, lenses: dict[str, Lens], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Hits by lens and window of event time; docs: doc_id, text, ts, streaming or not."""
    stamped = docs.withWatermark("ts", late)
    hits = cue_hits(stamped.select(F.struct("doc_id", "ts").alias("doc_id"), "text"), lenses)
    timed = hits.select(F.col("doc_id.ts").alias("ts"), "lens_id")
    return timed.groupBy(F.window("ts", window).alias("w"), "lens_id").count().select(F.col("w.start").alias("start"), "lens_id", "count")


def windowed_events(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by type and window: count and summed value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
