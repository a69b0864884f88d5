"""Pages as a data source; summaries of a stream against the batch's."""

import json

import pytest
from pyspark.sql import functions as F

from lensmark.operators import subjects
from lensmark.operators.grading import subject_summary
from lensmark.plans.lenses import load_lenses, text_lenses
from lensmark.sources import pages
from lensmark.streaming.subjects import summaries, trend_of


def fetch(url):
    """Used by name."""
    if "bad" in url:
        raise OSError("gone")
    with open("/tmp/lensmark-fetched-" + url.split("/")[2], "a") as f:
        f.write(url + "\n")
    return f"<p>{url}</p>"


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(f"http://h/{i}", f"<p>page {i}</p>", i) for i in range(200)] + [("http://bad/1", None, 0), (None, "<p>x</p>", 0)]
    spark.createDataFrame(rows, "url string, html string, other int").repartition(3).write.parquet(f"{tmp_path}/pages")
    return f"{tmp_path}/pages"


def test_an_archive_of_pages(spark, archive):
    for path in (archive, f"file://{archive}"):
        got = spark.read.format(pages.register(spark)).option("path", path).load()
        assert got.columns == ["url", "html", "error"] and got.count() == 202
    one = got.filter("url = 'http://h/7'")
    assert [tuple(r) for r in one.collect()] == [("http://h/7", "<p>page 7</p>", None)]
    some = got.filter(F.col("url").isin("http://h/7", "http://h/8", "none") & F.col("html").isNotNull())
    assert {r["url"] for r in some.collect()} == {"http://h/7", "http://h/8"}
    with pytest.raises(Exception, match="need a path"):
        spark.read.format(pages.NAME).load().count()


def test_pages_that_are_fetched(spark, archive, tmp_path):
    log = "/tmp/lensmark-fetched-h"
    open(log, "w").close()
    got = spark.read.format(pages.register(spark)).option("path", archive).option("fetch", "tests.test_pages_streams:fetch").load()
    rows = {r["url"]: r for r in got.filter(F.col("url").isin("http://h/3", "http://bad/1")).collect()}
    assert rows["http://h/3"]["html"] == "<p>http://h/3</p>" and rows["http://bad/1"]["html"] is None and "gone" in rows["http://bad/1"]["error"]
    with open(log) as f:
        assert set(f.read().split()) == {"http://h/3"}, "filters keep other pages from being fetched"


def test_a_stream_of_late_documents_equals_the_batch(spark, tmp_path):
    lenses = text_lenses(load_lenses())
    texts = ["Released under the MIT License.", "plain words", "write to us @mail", "mit license @mail"]
    docs = [{"doc_id": f"d{i}", "text": texts[i % 4], "subject": f"s{i % 3}", "date": ["2024-01-%02d" % (28 - i), None, ""][(i % 5) // 3], "ord": i} for i in range(24)]
    schema = "doc_id string, text string, subject string, date string, ord long"
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(d) for d in docs[i::4]))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    query = summaries(subjects.grade_documents(stream, lenses, rounded=False)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: seen.append((n, b.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for _, rows in sorted(seen):
        last |= {(r["subject"], r["lens_id"]): r for r in rows}
    want = subject_summary(subjects.grade_documents(spark.createDataFrame([tuple(d.values()) for d in docs], schema), lenses, rounded=False), rounded=False).collect()
    assert len(seen) == 4 and len(last) == len(want) == 3 * len(lenses)
    for r in want:
        own = last[r["subject"], r["lens_id"]]
        assert (own["n_documents"], own["n_documents_with_signal"], own["trend"]) == (r["n_documents"], r["n_documents_with_signal"], r["trend"])
        assert (own["max_index"], own["mean_index"]) == pytest.approx((r["max_index"], r["mean_index"]))


def test_trends():
    assert [trend_of(x) for x in ([], [1.0], [0.0, 0.0, 9.0], [9.0, 0.0], [0.0, 20.0])] == ["insufficient-data", "insufficient-data", "flat", "falling", "rising"]


def test_a_stream_is_summed_by_sparks_own_aggregates(spark, tmp_path):
    schema = "subject string, lens_id string, index double, markers_present array<string>, date string, ord long"
    (tmp_path / "in").mkdir()
    rows = [("s", "l", x, [], "d", 1) for x in (20.0, 1.0, 9.0)]  # equal dates and places: the index decides, not which came first
    for i, r in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(("subject", "lens_id", "index", "markers_present", "date", "ord"), r, strict=True))))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    told, seen = summaries(stream), []
    assert "Pandas" not in told._jdf.queryExecution().analyzed().toString()
    told.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: seen.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    assert tuple(seen[-1]) == ("s", "l", 20.0, 10.0, 3, 0, "rising")
