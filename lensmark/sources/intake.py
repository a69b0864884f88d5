"""Documents, graphs and records from files, as DataFrames of one shape.

Documents: doc_id, text, subject, url, date, ord (input order, for stable ties).
"""

from __future__ import annotations

import contextlib
import importlib
import io
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmark.functions.text import html_to_text, iso_day, strip
from lensmark.sources.scratch import written

DOCUMENT = "doc_id string, text string, subject string, url string, date string, ord long"
RECORD = "institution string, lens string, marker string, move string, actor string, assurance string, severity double, self_correction double, span string, receipts array<string>, note string"


def _blank(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def from_text(spark: SparkSession, text: str, doc_id: str = "text", subject: str | None = None, url: str | None = None, date: str | None = None) -> DataFrame:
    return spark.createDataFrame([(doc_id, text, subject, url, date, 0)], DOCUMENT)


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0).alias("doc_id"), F.col("value").alias("text"))


def from_file(spark: SparkSession, path: str, subject: str | None = None, url: str | None = None, date: str | None = None) -> DataFrame:
    """A UTF-8 file; its name is the id."""
    return _files(spark, path, None).select(F.url_decode("doc_id").alias("doc_id"), "text", F.lit(subject).cast("string").alias("subject"), F.lit(url).cast("string").alias("url"), F.lit(date).cast("string").alias("date"), F.lit(0).cast("long").alias("ord"))


def from_dir(spark: SparkSession, path: str, pattern: str = "*.txt", subject: str | None = None) -> DataFrame:
    """The folder's own files that match, by name."""
    none = F.lit(None).cast("string")
    rows = _files(spark, path, pattern).select(F.url_decode("doc_id").alias("doc_id"), "text", F.lit(subject).cast("string").alias("subject"), none.alias("url"), none.alias("date"))
    places = rows.select("doc_id").withColumn("ord", F.row_number().over(Window.orderBy("doc_id")).cast("long") - 1)  # names only: the driver lists as many
    return rows.join(places, "doc_id").orderBy("ord")


def _offset(rows: DataFrame, name: str, within: Column, count: Column) -> DataFrame:
    """rows with ``name``: their number within their block of a file, from 0, and what the blocks before hold together."""
    blocks = rows.groupBy("file", "block").agg(count.alias("c"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = written(blocks.select("file", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")), "blocks")
    # No hint: blocks grow with the input. As a table their size is known, and where it allows they are broadcast and no line is shuffled.
    return rows.withColumn("within", within).join(blocks, ["file", "block"]).withColumn(name, F.col("before") + F.col("within")).drop("before", "within")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, n (from 0). A block of a file is read by one task in order, so its lines' ids rise by one; how many lines the blocks
    before it have is counted first."""
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    first = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = written(first.select("file", "block", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("start")), "blocks")  # see _offset()
    return rows.join(starts, ["file", "block"]).select("file", "block", "line", (F.col("id") + F.col("start")).alias("n"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, n: the lines of text files, numbered from 0 in the order of files' names and places."""
    return _lines(spark, path).select("line", "n")


def from_jsonl(spark: SparkSession, path: str, subject: str | None = None, text_key: str = "text") -> DataFrame:
    """Records with text; their subject is ``subject`` or ``person_id``. Others' records, those without a subject too, are left out
    if one is asked for; so is blank text. Without id: the subject or ``doc``, ``#``, the line's number, blank lines counted."""
    get = lambda k: _blank(F.get_json_object("line", f"$['{k}']"))
    rows = _lines(spark, path).filter(strip(F.col("line")) != "").select("n", get(text_key).alias("text"), F.coalesce(get("subject"), get("person_id")).alias("subject"), get("id").alias("id"), get("url").alias("url"), get("date").alias("date"))
    if subject is not None:
        rows = rows.filter(F.col("subject") == subject)
    rows = rows.filter(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    return rows.select(F.coalesce("id", F.concat(F.coalesce("subject", F.lit("doc")), F.lit("#"), "n")).alias("doc_id"), "text", "subject", "url", "date", F.col("n").alias("ord"))


def of_subject(records: DataFrame, subject: str, keep_unnamed: bool = False) -> DataFrame:
    """Records of a subject; keep_unnamed also keeps those that name none."""
    own = F.col("subject") == subject
    return records.filter(own | F.col("subject").isNull() if keep_unnamed else own)


def from_x_export(spark: SparkSession, path: str, subject: str | None = None) -> DataFrame:
    """Posts: text or full_text, the day of created_at; of the subject's handle, with or without ``@``. A post's subject is its own handle."""
    get = lambda k: _blank(F.get_json_object("line", f"$.{k}"))
    rows = _lines(spark, path).filter(strip(F.col("line")) != "").select("file", "block", "n", F.coalesce(get("text"), get("full_text")).alias("text"), get("handle").alias("handle"), get("id").alias("id"), get("url").alias("url"), iso_day(get("created_at")).alias("date"))
    if subject is not None:
        rows = rows.filter(F.col("handle").isin(subject, subject.lstrip("@")))
    rows = rows.filter(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    kept = _offset(rows, "k", F.row_number().over(Window.partitionBy("file", "block").orderBy("n")) - 1, F.count("*"))
    return kept.select(F.coalesce("id", F.concat(F.lit("x#"), "k")).alias("doc_id"), "text", F.col("handle").alias("subject"), "url", "date", F.col("n").alias("ord"))


def from_html(pages: DataFrame) -> DataFrame:
    """pages: url, html. The visible text, under the url as id."""
    return pages.select(F.col("url").alias("doc_id"), html_to_text(F.col("html")).alias("text"), F.lit(None).cast("string").alias("subject"), "url", F.lit(None).cast("string").alias("date"))


def fetch_url(url: str) -> str:
    """A page's text, within 30 seconds; used only where a caller passes it to from_urls()."""
    asked = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; lensmark)"})
    with urllib.request.urlopen(asked, timeout=30) as page:
        return page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")


def from_urls(urls: DataFrame, fetch: Callable[[str], str] = fetch_url, subject: str | None = None, date: str | None = None) -> DataFrame:
    """urls: url. Documents of pages by ``fetch``, in tasks, with ``error``; a page that fails has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            html, errors = [], []
            for u in batch["url"]:
                try:
                    html.append(fetch(u))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a fetch raises is a row's error
                    html.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"url": batch["url"], "html": html, "error": errors})

    pages = urls.select("url").mapInPandas(run, "url string, html string, error string")
    return pages.select(F.col("url").alias("doc_id"), html_to_text(F.col("html")).alias("text"), F.lit(subject).cast("string").alias("subject"), "url", F.lit(date).cast("string").alias("date"), "error")


def from_pdf(spark: SparkSession, path: str) -> DataFrame:
    """The text of PDF files, if pypdf or pdfminer is installed on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _pdf_reader()
        for batch in batches:
            yield pd.DataFrame({"doc_id": [p.rsplit("/", 1)[-1] for p in batch["path"]], "text": [read(c) for c in batch["content"]]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, text string")
    return rows.withColumn("text", strip(F.regexp_replace("text", r"\s+\n", "\n")))


#: Libraries that read PDF, best first, and how each makes a text of a file's bytes.
PDF_READERS: dict[str, Callable] = {
    "pypdf": lambda module, data: "\n".join(page.extract_text() or "" for page in module.PdfReader(data).pages),
    "pdfminer.high_level": lambda module, data: module.extract_text(data),
}


def _pdf_reader() -> Callable[[bytes], str]:
    for name, read in PDF_READERS.items():
        with contextlib.suppress(ImportError):
            module = importlib.import_module(name)
            return lambda data, module=module, read=read: read(module, io.BytesIO(data))
    raise ImportError(f"none of these is installed to read PDF: {', '.join(PDF_READERS)}")


#: Pools of a JSON graph that hold entities, in the order in which a subject is sought.
POOLS = ("people", "institutions", "entities", "nodes")


def _said(value: Column, *paths: str) -> Column:
    """The first string that a variant has at any of the paths; empty ones count as none."""
    return F.coalesce(*(_blank(F.try_variant_get(value, p, "string")) for p in paths))


def _entity(value: Column) -> Column:
    """An entity of a variant: sources may be strings, objects with a url, or such objects as text; others are left out."""
    sources = F.try_variant_get(value, "$.sources", "array<variant>")
    said = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string"))
    url = lambda x: F.when(said(x).startswith("{"), F.try_variant_get(F.try_parse_json(said(x)), "$.url", "string")).otherwise(F.coalesce(said(x), F.try_variant_get(x, "$.url", "string")))
    urls = F.transform(F.coalesce(sources, F.array().cast("array<variant>")), url)
    return F.struct(
        _said(value, "$.id").alias("id"), _said(value, "$.name", "$.label").alias("name"), _said(value, "$.type").alias("type"), _said(value, "$.sector").alias("sector"), _said(value, "$.summary").alias("summary"),
        F.filter(urls, lambda u: u.startswith("http")).alias("sources"),
    )


def _edge(value: Column) -> Column:
    """An edge of a variant: an object, or an array of source, target and relation."""
    return F.struct(_said(value, "$.source", "$[0]").alias("source"), _said(value, "$.target", "$[1]").alias("target"), _said(value, "$.rel", "$[2]").alias("rel"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value: each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _graph_values(graphs: DataFrame) -> DataFrame:
    """file, pool, ord, value of each member of the pools of JSON graphs (file, value). A graph is parsed once, and is one row: one of any size comes as lines (graph_lines)."""
    files = graphs.select("file", F.try_parse_json("value").alias("graph"))
    pools = F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("pool"), F.try_variant_get("graph", f"$.{k}", "array<variant>").alias("members")) for k in (*POOLS, "edges"))), lambda p: p["members"].isNotNull()))
    each = files.select("file", pools.alias("p"))
    return each.select("file", "p.pool", F.posexplode("p.members").alias("ord", "value"))


def last_of(entities: DataFrame) -> DataFrame:
    """Of repeated ids the last entity by ``ord``; those without id are left out."""
    kept = entities.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*(c for c in entities.columns if c not in ("id", "ord"))), "ord").alias("e"), F.max("ord").alias("ord"))
    return kept.select("id", "e.*", "ord")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """entities (the last of a repeated id counts) and edges (with edge_ord) of a JSON graph, whose edges are objects or arrays."""
    values = _graph_values(whole_files(spark, path))
    entities = last_of(values.filter("pool = 'entities'").select(_entity(F.col("value")).alias("e"), "ord").select("e.*", "ord"))
    edges = values.filter("pool = 'edges'").select(_edge(F.col("value")).alias("e"), F.col("ord").alias("edge_ord")).select("e.*", "edge_ord")
    return entities.select("id", "name", "type", "sector", "summary", "ord"), edges


def graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """entities and edges of JSON lines: an object with an id is an entity, any other object and any array an edge. Each line is parsed once; lines that
    are no JSON, and edges that lack an end, are left out; of repeated ids the last line counts."""
    rows = _lines(spark, path).select(F.try_parse_json("line").alias("v"), "n").filter("v IS NOT NULL")
    is_entity = _said(F.col("v"), "$.id").isNotNull()
    entities = last_of(rows.filter(is_entity).select(_entity(F.col("v")).alias("e"), F.col("n").alias("ord")).select("e.*", "ord"))
    edges = rows.filter(~is_entity).select(_edge(F.col("v")).alias("e"), F.col("n").alias("edge_ord")).select("e.*", "edge_ord")
    return entities, edges.filter("source IS NOT NULL AND target IS NOT NULL")


def subject_sources(graphs: DataFrame) -> DataFrame:
    """Every subject of JSON graphs (file, value), from any pool, with its sources that start with http: file, pool, ord, id, name, place (from 0), url. One row a source."""
    values = _graph_values(graphs).filter("pool <> 'edges'")
    own = values.select("file", "pool", "ord", _entity(F.col("value")).alias("e"))
    return own.select("file", "pool", "ord", "e.id", "e.name", F.posexplode("e.sources").alias("place", "url"))


def from_subject(spark: SparkSession, path: str, subject: str) -> dict:
    """An entity's id, label and sources that start with http, from the first pool of a JSON graph that has it by id or label."""
    values = _graph_values(whole_files(spark, path)).filter("pool <> 'edges'").select(F.array_position(F.array(*map(F.lit, POOLS)), F.col("pool")).alias("p"), "ord", _entity(F.col("value")).alias("e"))
    found = values.filter((F.col("e.id") == subject) | (F.col("e.name") == subject)).orderBy("p", "ord").select("e.*").head()
    if found is None:
        raise KeyError(f"subject {subject!r} not found")
    return {"subject": found["id"] or subject, "label": found["name"], "sources": list(found["sources"])}


def folder_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """entities and edges of a folder with people.jsonl, institutions.jsonl and edges.jsonl (objects or arrays), each line parsed once.
    Relations are dropped, so are edges that lack an end."""
    both = spark.read.text([f"{folder}/people.jsonl", f"{folder}/institutions.jsonl"]).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    entities = both.select(_said(F.col("v"), "$.id").alias("id"), _said(F.col("v"), "$.label", "$.id").alias("name"), _said(F.col("v"), "$.sector").alias("sector"))
    rows = spark.read.text(f"{folder}/edges.jsonl").select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("edge_ord")).filter("v IS NOT NULL")
    edges = rows.select(_edge(F.col("v")).alias("e"), "edge_ord").select("e.source", "e.target", F.lit(None).cast("string").alias("rel"), "edge_ord")
    return entities, edges.filter("source IS NOT NULL AND target IS NOT NULL")


def write_graph(entities: DataFrame, edges: DataFrame, path: str) -> int:
    """Both as JSON lines under path; how many entities there are."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    edges.drop("rel").write.mode("overwrite").json(f"{path}/edges")
    return entities.count()


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Evidence records in input order; blank lines do not count."""
    rows = _lines(spark, path).filter(strip(F.col("line")) != "")
    return rows.select(F.from_json("line", RECORD).alias("r"), F.col("n").alias("ord")).select("r.*", "ord")


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
