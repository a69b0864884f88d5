"""python -m lensmark.cli lenses | demo TEXT | grade FILE --lens ID | grade --url URL | subject --id ID --texts JSONL | profile --id ID --graph-dir DIR | board RECORDS

demo, grade, subject and profile take --backend (cues, cloud, local, auto); all but cues need --transport cloud=MODULE:FUNCTION or
--transport local=MODULE:FUNCTION, a function from a list of prompts to as many answers."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession

from lensmark.operators.board import board, render, validate
from lensmark.operators.subjects import grade_documents, grade_person, grade_text, profile
from lensmark.plans.lenses import OWN, lens_table, load_lenses, requested
from lensmark.sources.intake import folder_graph, from_file, from_jsonl, from_urls, load_records, to_json


def emit(df: DataFrame) -> None:
    for row in to_json(df).toLocalIterator():
        print(row[0])


def transports(given: list[str] | None) -> dict:
    """NAME=MODULE:FUNCTION of each as a function."""
    out = {}
    for one in given or []:
        name, _, where = one.partition("=")
        module, _, function = where.partition(":")
        out[name] = getattr(importlib.import_module(module), function)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lensmark", description=__doc__)
    p.add_argument("--lenses", default=str(OWN))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("lenses")
    d = sub.add_parser("demo")
    d.add_argument("text")
    g = sub.add_parser("grade")
    g.add_argument("file", nargs="?")
    g.add_argument("--url")
    g.add_argument("--lens", action="append")
    s = sub.add_parser("subject")
    s.add_argument("--id", required=True)
    s.add_argument("--texts", required=True)
    f = sub.add_parser("profile")
    f.add_argument("--id", required=True)
    f.add_argument("--graph-dir", required=True)
    f.add_argument("--texts")
    for command in (d, g, s, f):
        command.add_argument("--backend", default="cues", choices=["cues", "cloud", "local", "auto"])
        command.add_argument("--transport", action="append")
    sub.add_parser("board").add_argument("records")
    a = p.parse_args(argv)
    if a.command == "grade" and (a.file is None) == (a.url is None):
        p.error("grade takes a file or --url")
    how = {"backend": a.backend, "transports": transports(a.transport)} if "backend" in a else {}
    spark = SparkSession.builder.getOrCreate()
    lenses = load_lenses(a.lenses)
    if a.command == "lenses":
        emit(lens_table(spark, lenses))
    elif a.command == "demo":
        emit(grade_text(spark, a.text, lenses, **how))
    elif a.command == "grade":
        docs = from_file(spark, a.file) if a.url is None else from_urls(spark.createDataFrame([(a.url,)], "url string"))
        emit(grade_documents(docs, requested(lenses, a.lens, strict=True), receipts=True, **how))
    elif a.command == "subject":
        for df in grade_person(from_jsonl(spark, a.texts, a.id), lenses, **how):
            emit(df)
    elif a.command == "profile":
        docs = from_jsonl(spark, a.texts, a.id) if a.texts else None
        for df in profile(*folder_graph(spark, a.graph_dir), docs, lenses, a.id, **how).values():
            if df is not None:
                emit(df)
    else:
        records = load_records(spark, a.records)
        warnings = validate(records, lenses).collect()
        for w in warnings:
            print(w["message"])
        print(render(board(records), records))
        return int(any(w["kind"] == "no-receipt" for w in warnings))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
