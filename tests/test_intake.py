import json

import pytest

from lensmark import cli
from lensmark.operators import subjects
from lensmark.plans.lenses import load_lenses
from lensmark.sources import intake
from lensmark.sources.scratch import written_text
from lensmark.streaming.events import stream_jsonl, windowed_hits


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("bé", encoding="utf-8")
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "c.md").write_text("no")
    assert [(r["doc_id"], r["text"], r["ord"]) for r in intake.from_dir(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo", 0), ("b.txt", "bé", 1)]
    assert intake.from_file(spark, str(tmp_path / "c.md"), subject="s").first()["doc_id"] == "c.md"


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", ["", {"text": "a", "person_id": "p"}, {"text": " "}, {"text": "b", "subject": "q", "id": "own", "date": "2020"}, {"text": "c"}])
    got = [(r["doc_id"], r["subject"]) for r in intake.from_jsonl(spark, path).orderBy("ord").collect()]
    assert got == [("p#1", "p"), ("own", "q"), ("doc#4", None)]
    assert [r["doc_id"] for r in intake.from_jsonl(spark, path, "p").collect()] == ["p#1"]
    every = intake.from_jsonl(spark, path)
    assert intake.of_subject(every, "p", keep_unnamed=True).count() == 2 and intake.of_subject(every, "p").count() == 1


def test_x_export(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", [{"handle": "me", "full_text": "one", "created_at": "2020-01-02T03:04"}, {"handle": "@me", "text": "two", "id": 7}, {"handle": "you", "text": "three"}])
    got = [(r["doc_id"], r["text"], r["date"]) for r in intake.from_x_export(spark, path, "@me").orderBy("ord").collect()]
    assert got == [("x#0", "one", "2020-01-02"), ("7", "two", None)]


def test_graphs(spark, tmp_path):
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"entities": [{"id": "a", "name": "old"}, {"id": "b", "sector": "gov"}, {"id": "a", "name": "new"}], "edges": [{"source": "a", "target": "b", "rel": "founded"}]}))
    ents, edges = intake.load_graph(spark, str(g))
    assert {r["id"]: r["name"] for r in ents.collect()} == {"a": "new", "b": None} and edges.first()["rel"] == "founded"
    lines(tmp_path / "people.jsonl", [{"id": "p", "label": "Pat"}])
    lines(tmp_path / "institutions.jsonl", [{"id": "i", "sector": "tech"}])
    lines(tmp_path / "edges.jsonl", [{"source": "p", "target": "i", "rel": "x"}, ["i", "p"], {"source": "p"}])
    ents, edges = intake.folder_graph(spark, str(tmp_path))
    assert sorted(map(tuple, ents.collect())) == [("i", "i", "tech"), ("p", "Pat", None)] and sorted((r["source"], r["target"], r["rel"]) for r in edges.collect()) == [("i", "p", None), ("p", "i", None)]
    assert intake.write_graph(ents, edges, str(tmp_path / "out")) == 2
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"people": [{"id": "p", "label": "Pat", "sources": ["http://a", {"url": "https://b"}, "ftp://c"]}], "nodes": []}))
    assert intake.from_subject(spark, str(s), "Pat")["sources"] == ["http://a", "https://b"]
    with pytest.raises(KeyError):
        intake.from_subject(spark, str(s), "none")


def test_pages(spark):
    pages = intake.from_urls(spark.createDataFrame([("good",), ("bad",)], "url string"), lambda u: "<p>hi</p>" if u == "good" else 1 / 0)
    rows = {r["url"]: r for r in pages.collect()}
    assert rows["good"]["text"] == "hi" and "ZeroDivisionError" in rows["bad"]["error"]


def test_graded_sources(spark, tmp_path):
    g = tmp_path / "g.json"
    sources = ["http://a", json.dumps({"url": "http://bad"}), "ftp://no", "http://blank", "http://late"]
    g.write_text(json.dumps({"entities": [{"id": "p", "label": "P", "sources": sources}, {"id": "q", "label": "Q", "sources": []}]}))

    def fetch(url):
        if url == "http://bad":
            raise OSError("gone")
        return " " if url == "http://blank" else "<p>Released under the MIT License.</p>" + "x" * 9000 + " copyleft"

    each, summary = subjects.grade_sources(spark, str(g), "P", "license_register", load_lenses(), fetch)
    rows = {r["url"]: r for r in each.collect()}
    assert set(rows) == {"http://a", "http://bad", "http://blank"} and rows["http://blank"]["error"] == "empty text"
    assert rows["http://a"]["markers_present"] == ["permissive"] and rows["http://a"]["error"] is None and "gone" in rows["http://bad"]["error"]
    assert [(r["subject"], r["n_documents"]) for r in summary.collect()] == [("P", 1)]
    assert subjects.grade_sources(spark, str(g), "p", "license_register", load_lenses(), lambda u: 1 / 0)[1].count() == 0
    for who, lens, error in (("q", "license_register", ValueError), ("nobody", "license_register", KeyError), ("p", "nope", KeyError)):
        with pytest.raises(error):
            subjects.grade_sources(spark, str(g), who, lens, load_lenses(), fetch)


def test_stream_equals_batch(spark, tmp_path):
    lines(tmp_path / "1.json", [{"doc_id": "a", "text": "mit license", "ts": "2024-01-01T00:10:00"}, {"doc_id": "b", "text": "licensed under", "ts": "2024-01-01T02:10:00"}])
    lenses = load_lenses()
    query = windowed_hits(stream_jsonl(spark, str(tmp_path)), lenses).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = windowed_hits(spark.read.schema("doc_id string, text string, ts timestamp").json(str(tmp_path)), lenses)
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, batch.collect())) != []


def test_cli(spark, tmp_path, capsys):
    text = tmp_path / "t.txt"
    text.write_text("Released under the MIT License.")
    assert cli.main(["lenses"]) == 0 and cli.main(["demo", "mit license"]) == 0
    assert cli.main(["grade", str(text), "--lens", "license_register"]) == 0
    with pytest.raises(ValueError):
        cli.main(["grade", str(text), "--lens", "license_register", "--backend", "local"])
    with pytest.raises(SystemExit):
        cli.main(["grade", "--lens", "license_register"])
    assert cli.main(["grade", str(text), "--lens", "license_register", "--backend", "local", "--transport", "local=lensmark.operators.detection:no_hits"]) == 0
    out = capsys.readouterr().out
    assert '"lens_id":"license_register"' in out and "permissive" in out
    with pytest.raises(KeyError):
        cli.main(["grade", str(text), "--lens", "nope"])
    texts = lines(tmp_path / "x.jsonl", [{"text": "mit license", "person_id": "p", "date": "2020"}])
    assert cli.main(["subject", "--id", "p", "--texts", texts]) == 0
    bad = lines(tmp_path / "r.jsonl", [{"institution": "I", "lens": "license_register", "marker": "permissive", "actor": "a", "assurance": "FACT", "severity": 1}])
    assert cli.main(["board", bad]) == 1 and "NO RECEIPT" in capsys.readouterr().out


def test_graph_lines(spark, tmp_path):
    path = lines(tmp_path / "g.jsonl", [{"id": "a", "name": "old", "sources": ["http://x"]}, ["a", "b", "founded"], {"id": "a", "label": "new", "sources": [{"url": "https://y"}, 3, None, "no"]}, {"source": "b", "target": "a"}, ["a"], {"source": "", "target": "a"}, {"id": 7, "sector": "gov"}])
    with open(path, "a") as f:
        f.write("\nno json\n\n")
    entities, edges = intake.graph_lines(spark, path)
    assert {r["id"]: (r["name"], r["sector"], r["sources"]) for r in entities.collect()} == {"a": ("new", None, ["https://y"]), "7": (None, "gov", [])}
    assert [(r["source"], r["target"], r["rel"]) for r in edges.orderBy("edge_ord").collect()] == [("a", "b", "founded"), ("b", "a", None)]


def test_pools_pairs_and_odd_graphs(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"entities": [{"id": "a"}], "edges": [["a", "b", "member-of"], {"source": "b", "target": "c"}, "odd", None]}))
    entities, edges = intake.load_graph(spark, str(tmp_path / "g.json"))
    assert entities.count() == 1
    assert [(r["source"], r["target"], r["rel"]) for r in edges.filter("source IS NOT NULL").orderBy("edge_ord").collect()] == [("a", "b", "member-of"), ("b", "c", None)]
    rows = spark.createDataFrame([(1, json.dumps({"nodes": [{"label": "N", "sources": ["http://n"]}], "people": [{"id": "p", "sources": None}, {"id": "q", "sources": ["http://1", "http://2"]}]})), (2, "not json"), (3, None)], "file int, value string")
    found = intake.subject_sources(rows).orderBy("pool", "place").collect()
    assert [(r["pool"], r["id"], r["name"], r["place"], r["url"]) for r in found] == [("nodes", None, "N", 0, "http://n"), ("people", "q", None, 0, "http://1"), ("people", "q", None, 1, "http://2")]


def test_lines_are_numbered_without_a_shuffle_and_kept_compressed(spark):
    lines = spark.range(4000, numPartitions=3).selectExpr("concat(id, repeat(sha2(string(id), 256), 3)) AS value")
    path = written_text(lines, "lines")
    assert all(f.endswith(".gz") for f in spark.read.text(path).inputFiles())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        for rows in (intake.numbered_lines(spark, path), intake.from_x_export(spark, path)):
            assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        got = intake.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r["n"] for r in got) == list(range(4000)) and all(r["line"].startswith(str(r["n"])) for r in got)
