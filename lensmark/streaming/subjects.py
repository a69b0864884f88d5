"""Subjects' summaries as documents arrive: the same as over all documents so far, late ones included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmark.functions.text import let
from lensmark.operators.grading import TREND


def trend_of(indices: list[float]) -> str:
    """The second half's mean against the first's, of indices in order; the middle one belongs to the second."""
    n = len(indices)
    if n < 2:
        return "insufficient-data"
    half = n // 2
    moved = sum(indices[half:]) / (n - half) - sum(indices[:half]) / half
    return "rising" if moved > TREND else "falling" if moved < -TREND else "flat"


def _trend(indices: Column) -> Column:
    """As trend_of() of an array."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    half = F.floor(F.size(indices) / 2).cast("int")
    moved = mean(F.slice(indices, half + 1, F.size(indices))) - mean(F.slice(indices, 1, half))
    return F.when(F.size(indices) < 2, "insufficient-data").otherwise(let(moved, lambda m: F.when(m > TREND, "rising").when(m < -TREND, "falling").otherwise("flat")))


def summaries(grades: DataFrame) -> DataFrame:
    """grades: a stream of subject, lens_id, index, markers_present, date, ord, as grade_documents() makes it of a stream of documents. In update mode, a row for each subject and lens that a batch
    has news of: what subject_summary() says of all its documents so far. Dates sort by themselves, so a late document takes its place among the earlier ones.

    Spark's own aggregates keep the state: sums of all of a subject's documents under a lens, and of dated ones the date, place and index, as the halves of a trend depend on each."""
    date = F.col("date").cast("string")
    signal = F.size("markers_present") > 0
    dated = F.when(date.isNotNull() & (date != ""), F.struct(date.alias("date"), F.col("ord").cast("long").alias("ord"), F.col("index").cast("double").alias("index")))
    sums = grades.groupBy("subject", "lens_id").agg(
        F.max("index").alias("max_index"), F.avg("index").alias("mean_index"), F.count("*").alias("n_documents"), F.count_if(signal).alias("n_documents_with_signal"), F.array_sort(F.collect_list(dated)).alias("dated")
    )
    return sums.withColumn("trend", let(F.transform("dated", lambda d: d["index"]), _trend)).drop("dated")
