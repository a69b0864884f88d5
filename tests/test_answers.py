"""Answers that are asked once, through failures too; ranks of a group that no task holds."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lensmark.operators import grading
from lensmark.operators.detection import complete, detect
from lensmark.plans.lenses import load_lenses
from lensmark.sources import answers


def counting(folder, dies_at=None, fails=()):
    """A transport that notes each prompt it is asked, dies like a lost worker at one, and refuses some."""

    def ask(prompts):
        for p in prompts:
            if p == dies_at and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
        with open(f"{folder}/asked-{os.getpid()}", "a", encoding="utf-8") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        if any(p in fails for p in prompts):
            raise RuntimeError("refused")
        return [f"told {p}" for p in prompts]

    return ask


def asked(folder):
    return Counter(json.loads(line) for x in folder.iterdir() if x.name.startswith("asked-") for line in x.read_text(encoding="utf-8").splitlines())


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(answers, "BUCKETS", 3)
    monkeypatch.setattr(answers, "AT_ONCE", 2)


def test_a_prompt_is_asked_once(spark, tmp_path, few):
    df = spark.createDataFrame([(i, f"p{i % 20}") for i in range(200)] + [(900, None)], "n long, p string")
    store = f"file:{tmp_path}/store"
    for _ in range(2):
        got = {r["n"]: (r["answer"], r["error"]) for r in complete(df, "p", "local", {"local": counting(tmp_path)}, kept=store).collect()}
        assert got == {**{i: (f"told p{i % 20}", None) for i in range(200)}, 900: ("told ", None)}
    assert asked(tmp_path) == {**{f"p{i}": 1 for i in range(20)}, "": 1}
    more = spark.createDataFrame([(1, "p3"), (2, "new")], "n long, p string")
    assert {r["answer"] for r in complete(more, "p", "local", {"local": counting(tmp_path)}, kept=store).collect()} == {"told p3", "told new"}
    assert asked(tmp_path)["p3"] == 1 and asked(tmp_path)["new"] == 1
    complete(more, "p", "cloud", {"cloud": counting(tmp_path)}, kept=store).collect()
    assert asked(tmp_path)["p3"] == 2, "another back end is asked itself"


def test_a_lost_worker_and_a_failed_run_ask_nothing_twice(spark, tmp_path, few):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "n long, p string")
    store = str(tmp_path / "store")
    try:
        complete(df, "p", "local", {"local": counting(tmp_path, dies_at="p17")}, kept=store).collect()
    except Exception:  # noqa: BLE001, S110  local mode gives a task one attempt
        pass
    before = asked(tmp_path)
    assert 0 < len(before) < 40
    got = complete(df, "p", "local", {"local": counting(tmp_path)}, kept=store).collect()
    assert {r["answer"] for r in got} == {f"told p{i}" for i in range(40)}
    assert asked(tmp_path) == {f"p{i}": 1 for i in range(40)}


def test_errors_are_not_kept(spark, tmp_path, few):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "n long, p string")
    first = {r["n"]: (r["answer"], r["error"]) for r in complete(df, "p", "local", {"local": counting(tmp_path, fails=("p2",))}, kept=str(tmp_path / "s")).collect()}
    assert first[2][0] is None and "refused" in first[2][1] and first[3] == ("told p3", None)
    again = complete(df, "p", "local", {"local": counting(tmp_path)}, kept=str(tmp_path / "s"))
    assert {r["error"] for r in again.collect()} == {None}
    assert answers.known(spark, str(tmp_path / "s")).count() == 6 and answers.known(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        answers.known(spark, "s3://x")


def test_detection_by_kept_answers(spark, tmp_path, few):
    lens = load_lenses()["license_register"]
    docs = spark.createDataFrame([(1, "the MIT text"), (2, "the MIT text"), (3, "no")], "doc_id long, text string")

    def read(prompts):
        with open(f"{tmp_path}/asked-{os.getpid()}", "a", encoding="utf-8") as f:
            f.writelines(json.dumps(p[-5:]) + "\n" for p in prompts)
        return [json.dumps({"hits": [{"detection_id": "permissive-grant", "confidence": 0.9, "span": "MIT"}]})] * len(prompts)

    for _ in range(2):
        assert sorted(r["doc_id"] for r in detect(docs, {lens.id: lens}, "local", {"local": read}, kept=str(tmp_path / "s")).collect()) == [1, 2, 3]
    assert sum(asked(tmp_path).values()) == 2


def test_ranks_of_a_group_that_no_task_holds(spark):
    many = spark.range(120_000).select(F.lit("hot").alias("subject"), F.lit("l").alias("lens_id"), F.col("id").cast("string").alias("date"), F.pmod(F.col("id") * 7919, F.lit(100_003)).alias("ord"))
    rows = many.union(spark.createDataFrame([(None, "l", "1", 1), ("a", "l", "2", 5), ("a", "l", "1", 9), ("a", "m", "2", 1)], "subject string, lens_id string, date string, ord long"))
    got = grading.ranked(rows, ["subject", "lens_id"], ["date", "ord"]).cache()
    assert [(r["subject"], r["lens_id"], r["date"], r["rank"], r["n"]) for r in got.filter("subject IS NULL OR subject = 'a'").orderBy("subject", "lens_id", "rank").collect()] == [(None, "l", "1", 1, 1), ("a", "l", "1", 1, 2), ("a", "l", "2", 2, 2), ("a", "m", "2", 1, 1)]
    hot = got.filter("subject = 'hot'")
    assert hot.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.max("n")).first()[:] == (120_000, 1, 120_000, 120_000)
    earlier = hot.orderBy("rank").limit(3).select("date").collect()
    assert [r[0] for r in earlier] == ["0", "1", "10"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = rows.orderBy("subject", "lens_id", "date", "ord").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r[1] for r in parts) < 80_000


def test_trend_of_a_hot_subject(spark):
    half = 30_000
    rows = spark.range(2 * half).select(F.col("id").alias("doc_id"), F.lit("hot").alias("subject"), F.lit("l").alias("lens_id"), F.when(F.col("id") < half, 0.0).otherwise(50.0).alias("index"), F.array().cast("array<string>").alias("markers_present"), F.lpad(F.col("id").cast("string"), 9, "0").alias("date"), F.lit(0).alias("ord"))
    assert grading.subject_summary(rows).first()["trend"] == "rising"
    assert grading.subject_summary(rows.withColumn("index", -F.col("index"))).first()["trend"] == "falling"
