"""Labelled evaluation of lenses and of the verifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmark.operators.detection import Transport, with_cue_hits, with_verdicts
from lensmark.plans.lenses import Lens
from lensmark.sources.scratch import written


def floor_counts(fixtures: DataFrame, grades: DataFrame, backend: str = "cues") -> DataFrame:
    """fixtures: id, lens, should_fire, min_backend, expect_any; grades: doc_id, lens_id, markers_present.

    Fires: any marker is present. Cover: a positive whose expect_any has a present marker. The cue floor skips ``llm`` fixtures.
    """
    skipped = F.lit(backend == "cues") & (F.coalesce("min_backend", F.lit("cues")) == "llm")
    g = grades.select(F.col("doc_id").alias("id"), F.col("lens_id").alias("lens"), "markers_present")
    rows = fixtures.withColumn("skipped", skipped).join(g, ["id", "lens"], "left")
    present = F.coalesce("markers_present", F.array().cast("array<string>"))
    fired, live, fire = F.size(present) > 0, ~F.col("skipped"), F.col("should_fire")
    wanted = F.coalesce(F.size("expect_any") > 0, F.lit(False))
    hit = F.coalesce(F.arrays_overlap("expect_any", present), F.lit(False))
    return rows.agg(
        F.count_if(live & fire & fired).alias("pos_hit"),
        F.count_if(live & fire).alias("pos_total"),
        F.count_if(live & ~fire & ~fired).alias("neg_quiet"),
        F.count_if(live & ~fire).alias("neg_total"),
        F.count_if(live & fire & wanted & hit).alias("cover_hit"),
        F.count_if(live & fire & wanted).alias("cover_total"),
        F.count_if(F.col("skipped")).alias("skipped"),
        F.count_if(live & ((fire & (~fired | (wanted & ~hit))) | (~fire & fired))).alias("failures"),
    )


def passes(counts: DataFrame) -> bool:
    """The strict gate: nothing failed."""
    return counts.first()["failures"] == 0


def confusion(rows: DataFrame, expected: str = "expected", kept: str = "kept") -> DataFrame:
    """tp, fp, fn, tn of two booleans, and whether neither error occurs."""
    e, k = F.col(expected), F.col(kept)
    return rows.agg(F.count_if(e & k).alias("tp"), F.count_if(~e & k).alias("fp"), F.count_if(e & ~k).alias("fn"), F.count_if(~e & ~k).alias("tn")).withColumn("passed", (F.col("fp") == 0) & (F.col("fn") == 0))


def verified_cases(cases: DataFrame, lenses: dict[str, Lens], transport: Transport) -> DataFrame:
    """cases: text, expected, and more; one row with ``kept`` each: whether the verifier finds any of its cue hits genuine. A case without a hit is not kept; cases
    are told apart by row, so that their ids may repeat."""
    marked = with_cue_hits(cases, lenses).withColumn("case", F.monotonically_increasing_id())
    marked = written(marked, "cases")
    hits = marked.select("case", "text", F.explode("hits").alias("h")).select("case", "text", "h.*")
    kept = with_verdicts(hits, lenses, transport).filter("verdict = 'genuine'").select("case").distinct().withColumn("kept", F.lit(True))
    return marked.join(kept, "case", "left").withColumn("kept", F.coalesce("kept", F.lit(False))).drop("case", "hits")
