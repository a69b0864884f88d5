"""Composite queries: a text, a person, a two-lane profile, and look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.functions.text import strip
from lensmark.operators.careers import LENS as CAREERS
from lensmark.operators.careers import career_grades
from lensmark.operators.detection import Transport, detected
from lensmark.operators.grading import grade_rows, prepared, ranked, subject_summary, timeline
from lensmark.operators.graph import LENS as NETWORK
from lensmark.operators.graph import metrics, network_grades
from lensmark.plans.lenses import Lens, requested, text_lenses
from lensmark.sources.intake import fetch_url, from_subject, from_text, from_urls
from lensmark.sources.scratch import written

#: The most characters of a text that the detection API takes.
API_CHARS = 40_000
#: The most characters of a fetched source that count.
SOURCE_CHARS = 8_000
#: Lenses that are scored over a graph, and how.
GRAPH_SCORERS = {
    CAREERS: career_grades,
    NETWORK: lambda entities, edges, lenses, rounded=True: network_grades(metrics(entities, edges), lenses, rounded),
}


def grade_documents(docs: DataFrame, lenses: dict[str, Lens], backend: str = "cues", transports: dict[str, Transport] | None = None, rounded: bool = True, receipts: bool = False, preflight: Callable[[], object] | None = None, kept: str | None = None) -> DataFrame:
    """docs: text and more. Blank texts are left out; a row a document and text lens, graded within the document's row: ids may repeat or be null."""
    lenses = text_lenses(lenses)
    return grade_rows(detected(prepared(docs), lenses, backend, transports, preflight, kept), lenses, rounded, receipts)


def grade_text(spark: SparkSession, text: str, lenses: dict[str, Lens], backend: str = "cues", transports: dict[str, Transport] | None = None) -> DataFrame:
    return grade_documents(from_text(spark, text), lenses, backend, transports, receipts=True)


def grade_person(docs: DataFrame, lenses: dict[str, Lens], person: str | None = None, rounded: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """The summary by lens and the timeline of a subject's documents (doc_id, text, date, ord; ids default to person#i)."""
    if person is not None:
        placed = ranked(docs.withColumn("subject", F.lit(person)), [], ["ord"])
        docs = placed.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(f"{person}#"), F.col("rank") - 1))).drop("rank", "n")
    graded = grade_documents(docs, lenses, rounded=rounded, **how)
    return subject_summary(graded, rounded), timeline(graded, sorted(text_lenses(lenses)))


def grade_sources(spark: SparkSession, graph: str, subject: str, lens: str, lenses: dict[str, Lens], fetch: Callable[[str], str] = fetch_url, max_docs: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """The first max_docs sources that a JSON graph names for a subject, fetched once and graded: a row a source (url, error, index, tier,
    markers_present; a source that fails or is blank has an error and no grade) and the subject's summary, empty if no source could be graded."""
    wanted = requested(lenses, [lens], strict=True)
    found = from_subject(spark, graph, subject)
    urls = found["sources"][:max_docs]
    if not urls:
        raise ValueError(f"{found['label'] or subject} has no sources to fetch")
    who = found["label"] or found["subject"]
    pages = from_urls(spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string"), fetch, who)
    pages = written(pages.withColumn("text", F.substring("text", 1, SOURCE_CHARS)).withColumn("ord", F.monotonically_increasing_id()), "sources")
    graded = grade_documents(pages.drop("error"), wanted, **how)
    each = pages.select("url", "error").join(graded.select("url", "index", "tier", "markers_present"), "url", "left")
    return each.withColumn("error", F.when(F.col("error").isNull() & F.col("index").isNull(), EMPTY).otherwise(F.col("error"))), subject_summary(graded)


def profile(entities: DataFrame, edges: DataFrame, docs: DataFrame | None, lenses: dict[str, Lens], subject: str, rounded: bool = True, **how) -> dict[str, DataFrame | None]:
    """The graph lane and the text lane of a subject, never blended; unknown graph lenses are skipped."""
    graph = {k: f(entities, edges, lenses, rounded).filter(F.col("doc_id") == subject) for k, f in GRAPH_SCORERS.items() if k in lenses}
    text = grade_person(docs.filter(F.col("subject") == subject), lenses, rounded=rounded, **how)[0] if docs is not None else None
    return {**graph, "text": text}


# Fixed value: what the detection service says of a text without content.
EMPTY = "empty text"


def api_errors(docs: DataFrame) -> DataFrame:
    """doc_id and error of documents that the detection service refuses: those with nothing but white space up to API_CHARS."""
    blank = strip(F.coalesce(F.substring("text", 1, API_CHARS), F.lit(""))) == ""
    return docs.filter(blank).select("doc_id", F.lit(EMPTY).alias("error"))


def service_health(lenses: dict[str, Lens]) -> dict:
    return {"ok": True, "lenses": sorted(lenses)}


def detect_api(docs: DataFrame, lenses: dict[str, Lens], ids: list[str] | None = None, rounded: bool = True, chars: int | None = API_CHARS) -> DataFrame:
    """What the detection service answers: documents cut at ``chars`` (None: whole), every lens asked for, best index first."""
    cut = prepared(docs if chars is None else docs.withColumn("text", F.substring("text", 1, chars)))
    wanted = {k: v for k, v in lenses.items() if ids is None or k in ids}
    return grade_rows(detected(cut, wanted), wanted, rounded).orderBy("doc_id", F.desc("index"), "lens_ord")


def lookup(entities: DataFrame, query: str) -> DataFrame:
    """The entity whose id or name is the query (case aside), else the first in order whose name or id holds it. entities: id, name, ord."""
    q = query.strip().lower()
    i, n = F.lower(F.col("id").cast("string")), F.lower(F.coalesce("name", F.lit("")))
    rank = F.when((i == q) | (n == q), 0).when(F.contains(i, F.lit(q)) | F.contains(n, F.lit(q)), 1)
    return entities.withColumn("match", rank).filter("match IS NOT NULL").orderBy("match", "ord").limit(1)


def _labels(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: an entity's neighbours by name, with the relation."""
    names = entities.select(F.col("id").alias("other"), "name")
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "rel").union(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "rel"))
    label = F.concat(F.coalesce("name", F.col("other").cast("string")), F.when(F.coalesce("rel", F.lit("")) != "", F.concat(F.lit(" ("), "rel", F.lit(")"))).otherwise(F.lit("")))
    return ends.join(names, "other", "left").select("id", label.alias("label"))


def affiliation_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity how many distinct labels its neighbours have: labels are made distinct first, so a hub is a sum and no list."""
    return _labels(entities, edges).distinct().groupBy("id").agg(F.count("label").alias("n_affiliations"))


def affiliations(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity its neighbours' labels, sorted and distinct, and their number; a list is as long as an entity has neighbours, and affiliation_counts() makes none."""
    found = _labels(entities, edges).groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("affiliations"))
    return found.withColumn("n_affiliations", F.size("affiliations"))
