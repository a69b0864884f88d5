"""Grades: breadth x intensity x density of a lens's markers in a document, and their summary by subject.

A document's hits are an array of its row where they were found there: every lens is then graded within the row, whatever the ids are,
with no shuffle (grade_rows). Hits that come as a table of their own are summed once by (document, lens, marker) and once by document and joined
to documents by id (grade). Indices are kept for each lens and never blended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmark.functions.numbers import nearest
from lensmark.functions.text import let, strip, token_estimate
from lensmark.plans.lenses import Lens, detection_weights, lens_literal, literal
from lensmark.sources.scratch import written

#: A trend's least difference of means.
TREND = 5.0


def contributions(hits: DataFrame, lenses: dict[str, Lens]) -> DataFrame:
    """Hits of known detections with what each adds: its confidence, clamped to 0..1, times the weight."""
    known = F.broadcast(detection_weights(hits.sparkSession, lenses).select("lens_id", "detection_id", "marker_id", "weight"))
    return hits.join(known, ["lens_id", "detection_id"]).withColumn("contribution", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")) * F.col("weight"))


def marker_scores(hits: DataFrame, lenses: dict[str, Lens]) -> DataFrame:
    """doc_id, lens_id, marker_id, score (capped at 1), added (uncapped)."""
    total = F.sum("contribution")
    return contributions(hits, lenses).groupBy("doc_id", "lens_id", "marker_id").agg(F.least(F.lit(1.0), total).alias("score"), total.alias("added"))


def tier_of(lens: Column, index: Column) -> Column:
    reached = F.filter(lens["tiers"], lambda t: index >= t["min"])
    return F.coalesce(F.try_element_at(reached, F.lit(-1))["label"], lens["first"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, c: a + c["added"])


def _graded(lens: Column, every: Column, tokens: Column, rounded: bool) -> Column:
    """every: array of lens_id, marker_id, added; several of one marker are summed."""
    return let(F.filter(every, lambda c: c["lens_id"] == lens["lens_id"]), lambda own: _graded_by(lens, own, tokens, rounded))


def _graded_by(lens: Column, own: Column, tokens: Column, rounded: bool) -> Column:
    score = lambda m: F.least(F.lit(1.0), _sum(F.filter(own, lambda c: c["marker_id"] == m["id"])))
    scored = F.transform(lens["markers"], lambda m: F.struct(m["id"].alias("id"), m["base"].alias("base"), score(m).alias("score")))
    weighted = _sum(own)

    def grade(s: Column) -> Column:
        n = F.greatest(F.size(lens["markers"]), F.lit(1))
        base = F.aggregate(lens["markers"], F.lit(0.0), lambda a, m: a + m["base"])
        present = F.filter(s, lambda m: m["score"] >= lens["thr"])
        breadth = F.size(present) / n
        intensity = F.aggregate(s, F.lit(0.0), lambda a, m: a + m["score"] * m["base"]) / F.when(base == 0, F.lit(1.0)).otherwise(base)
        density = F.when((tokens > 0) & (lens["cap"] != 0), F.least(F.lit(1.0), weighted / (tokens / F.lit(1000.0)) / F.when(lens["cap"] == 0, F.lit(1.0)).otherwise(lens["cap"]))).otherwise(F.lit(0.0))
        index = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (lens["wb"] * breadth + lens["wi"] * intensity + lens["wd"] * density)))
        shown = nearest if rounded else (lambda c, n: c)
        return F.struct(
            lens["lens_id"].alias("lens_id"),
            lens["lens_ord"].alias("lens_ord"),
            shown(index, 2).alias("index"),
            tier_of(lens, nearest(index, 2)).alias("tier"),
            shown(breadth, 4).alias("breadth"),
            shown(intensity, 4).alias("intensity"),
            shown(density, 4).alias("density"),
            F.map_from_entries(F.transform(s, lambda m: F.struct(m["id"], shown(m["score"], 4)))).alias("marker_scores"),
            F.transform(present, lambda m: m["id"]).alias("markers_present"),
        )

    return let(scored, grade)


_ADDED = "array<struct<lens_id:string,marker_id:string,added:double>>"


def grade(docs: DataFrame, hits: DataFrame, lenses: dict[str, Lens], rounded: bool = True, receipts: bool = False) -> DataFrame:
    """docs: doc_id (unique, not null), token_count, and what else to keep; hits by doc_id. A row for each document and lens, without hits too.

    receipts: all hits of the document and lens in order, those of unknown detections included.
    """
    cells = marker_scores(hits, lenses).groupBy("doc_id").agg(F.collect_list(F.struct("lens_id", "marker_id", "added")).alias("cells"))
    joined = docs.join(cells, "doc_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast(_ADDED)))
    every, tokens = F.col("cells"), F.col("token_count").cast("double")
    graded = joined.withColumn("g", F.explode(F.transform(lens_literal(lenses), lambda x: _graded(x, every, tokens, rounded))))
    out = graded.select(*docs.columns, "g.*")
    if receipts:
        shown = [c for c in ("hit_ord", "detection_id", "confidence", "span", "char_start", "char_end", "rationale") if c in hits.columns]
        own = hits.groupBy("doc_id", "lens_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("receipts"))
        out = out.join(own, ["doc_id", "lens_id"], "left")
    return out


def grade_rows(rows: DataFrame, lenses: dict[str, Lens], rounded: bool = True, receipts: bool = False) -> DataFrame:
    """rows: token_count, hits (an array, as detection.detected() makes it), and what else to keep but hits and text. As grade(), with no ids and no shuffle: a
    row stands for itself. Rows with a lens_id are graded for that lens alone."""
    weights = {x.id: [{"detection_id": d.id, "marker_id": m.id, "weight": d.weight} for m, d in x.detections()] for x in lenses.values()}
    known = literal(weights, "map<string,array<struct<detection_id:string,marker_id:string,weight:double>>>")

    def of(h: Column) -> Column:
        return let(
            F.get(F.filter(F.coalesce(F.try_element_at(known, h["lens_id"]), F.array().cast("array<struct<detection_id:string,marker_id:string,weight:double>>")), lambda w: w["detection_id"] == h["detection_id"]), F.lit(0)),
            lambda w: F.struct(h["lens_id"].alias("lens_id"), w["marker_id"].alias("marker_id"), (F.greatest(F.lit(0.0), F.least(F.lit(1.0), h["confidence"])) * w["weight"]).alias("added")),
        )

    added = F.filter(F.transform("hits", of), lambda c: c["marker_id"].isNotNull()).cast(_ADDED)
    own = F.filter(lens_literal(lenses), lambda x: x["lens_id"] == F.col("lens_id")) if "lens_id" in rows.columns else lens_literal(lenses)
    tokens = F.col("token_count").cast("double")
    kept = [c for c in rows.columns if c not in ("hits", "text", "lens_id")]
    # the sums are a column of their own, so that they are made once a row and not once a lens
    graded = rows.withColumn("added", added).withColumn("g", F.explode(F.transform(own, lambda x: _graded(x, F.col("added"), tokens, rounded))))
    out = graded.select(*kept, "hits", "g.*")
    if receipts:
        mine = F.transform(F.array_sort(F.filter("hits", lambda h: h["lens_id"] == F.col("lens_id"))), lambda h: h.dropFields("lens_id"))
        out = out.withColumn("receipts", F.when(F.size(mine) > 0, mine))
    return out.drop("hits")


def prepared(docs: DataFrame) -> DataFrame:
    """Documents whose text is not blank, stripped, with token_count."""
    return docs.withColumn("text", strip(F.col("text"))).filter("text <> ''").withColumn("token_count", token_estimate(F.col("text")))


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with ``rank`` (from 1, by order within keys) and ``n`` (rows of the keys), with no task that holds a group.

    Rows are sorted over all tasks by keys and order, so that a large group is split by order, and numbered within their task. How many rows of a group each task has, a
    row a group and task, gives what stands before it.
    """
    sorted_ = written(rows.orderBy(*keys, *order).withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("task", F.shiftright("at", 33))
    parts = sorted_.groupBy(*keys, "task").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    group = Window.partitionBy(*keys)  # a row a task that has the group
    before = F.coalesce(F.sum("c").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"{k} of") for k in keys), F.col("task").alias("task of"), (before - F.col("first") + 1).alias("shift"), F.sum("c").over(group).alias("n"))
    same = F.col("task") == F.col("task of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k} of"))
    return sorted_.join(parts, same).select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "n")


def trend(values: Column, n: Column, rank: Column) -> Column:
    """Of dated documents in order: the second half's mean against the first's; the middle one belongs to the second."""
    half = F.floor(n / 2)
    first, second = F.avg(F.when(rank <= half, values)), F.avg(F.when(rank > half, values))
    size = F.max(n)
    return F.when(size.isNull() | (size < 2), F.lit("insufficient-data")).when(second - first > TREND, F.lit("rising")).when(second - first < -TREND, F.lit("falling")).otherwise(F.lit("flat"))


def subject_summary(grades: DataFrame, rounded: bool = True) -> DataFrame:
    """grades: subject, lens_id, index, markers_present, date, ord. Per subject and lens: max, mean, n_documents,
    n_documents_with_signal, trend. Undated documents (null or empty date) take no part in the trend. A subject may have any share of all documents."""
    kept = written(grades.select("subject", "lens_id", "index", "date", "ord", (F.size("markers_present") > 0).alias("signal")), "grades")
    dated = kept.filter(F.col("date").isNotNull() & (F.col("date").cast("string") != "")).select("subject", "lens_id", "index", "date", "ord")
    moved = ranked(dated, ["subject", "lens_id"], ["date", "ord"]).groupBy("subject", "lens_id").agg(trend(F.col("index"), F.col("n"), F.col("rank")).alias("trend"))
    shown = (lambda c: nearest(c, 2)) if rounded else (lambda c: c)
    own = kept.groupBy("subject", "lens_id").agg(
        shown(F.max("index")).alias("max_index"),
        shown(F.avg("index")).alias("mean_index"),
        F.count("*").alias("n_documents"),
        F.count_if("signal").alias("n_documents_with_signal"),
    )
    same = own["subject"].eqNullSafe(moved["subject"]) & (own["lens_id"] == moved["lens_id"])
    return own.join(moved, same, "left").select(own["*"], F.coalesce("trend", F.lit("insufficient-data")).alias("trend"))


def timeline(grades: DataFrame, lens_ids: list[str]) -> DataFrame:
    """Dated documents in order with one column a lens."""
    dated = grades.filter(F.col("date").isNotNull() & (F.col("date").cast("string") != ""))
    return dated.groupBy("subject", "doc_id", "date", "ord").pivot("lens_id", lens_ids).agg(F.first("index")).orderBy("subject", "date", "ord")


def in_order(docs: DataFrame) -> DataFrame:
    """Dated documents by date, then undated ones, both in input order."""
    return docs.orderBy(F.expr("nullif(cast(date AS string), '')").asc_nulls_last(), "ord")
