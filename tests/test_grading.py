"""Grades against a plain computation; the goldens of a pinned text; summaries and orders."""

import random

import pytest
from pyspark.sql import functions as F

from lensmark.operators import grading
from lensmark.operators.detection import cue_hits
from lensmark.operators.subjects import api_errors, detect_api, grade_documents, grade_person, grade_text, service_health
from lensmark.plans.lenses import Config, Detection, Lens, Marker, cue_snapshot, few_shot, load_lens, load_lenses, requested, text_lenses

SMALL = Lens(
    "small",
    "Small",
    (
        Marker("a", "A", 1.0, (Detection("a1", 0.9, "first", ("alpha one", "alpha", " ")), Detection("a2", 0.5, "", ("zeta",), (("gold", "src"),)))),
        Marker("b", "B", 0.5, (Detection("b1", 1.0, "", ("beta", "be")),)),
        Marker("c", "C", 0.8, (Detection("c1", 0.2, "", ()),)),
    ),
    config=Config(tiers=((60.0, "top"), (0.0, "low"), (35.0, "mid"))),
)


def plain(hits, tokens, lens):
    c = lens.config
    owner = {d.id: (m.id, d.weight) for m, d in lens.detections()}
    scores, total = {m.id: 0.0 for m in lens.markers}, 0.0
    for d, conf in hits:
        if d in owner:
            m, w = owner[d]
            x = max(0.0, min(1.0, conf)) * w
            total += x
            scores[m] = min(1.0, scores[m] + x)
    present = [m.id for m in lens.markers if scores[m.id] >= c.threshold]
    base = sum(m.base_weight for m in lens.markers) or 1.0
    b = len(present) / max(1, len(lens.markers))
    i = sum(scores[m.id] * m.base_weight for m in lens.markers) / base
    d = min(1.0, total / (tokens / 1000) / c.density_cap) if tokens > 0 and c.density_cap else 0.0
    index = max(0.0, min(100.0, 100 * (c.w_breadth * b + c.w_intensity * i + c.w_density * d)))
    tier = c.tiers[0][1] if c.tiers else "unknown"
    for least, label in sorted(c.tiers, key=lambda t: t[0]):
        if index >= least:
            tier = label
    return index, tier, b, i, d, sorted(present)


def test_random_hits_against_plain(spark):
    rng = random.Random(2)
    docs, hits, want = [], [], {}
    for i in range(80):
        own = [(rng.choice(["a1", "a2", "b1", "c1", "unknown"]), rng.choice([-0.5, 0.1, 0.33, 0.8, 1.7])) for _ in range(rng.randint(0, 6))]
        tokens = rng.choice([0, 5, 400, 9000])
        docs.append((i, tokens))
        hits += [(i, "small", d, c) for d, c in own]
        want[i] = plain(own, tokens, SMALL)
    got = grading.grade(spark.createDataFrame(docs, "doc_id long, token_count int"), spark.createDataFrame(hits, "doc_id long, lens_id string, detection_id string, confidence double"), {"small": SMALL}, rounded=False)
    rows = got.collect()
    assert len(rows) == 80
    for r in rows:
        index, tier, b, i, d, present = want[r["doc_id"]]
        assert (r["index"], r["breadth"], r["intensity"], r["density"]) == pytest.approx((index, b, i, d), abs=1e-9)
        assert r["tier"] == tier and sorted(r["markers_present"]) == present and set(r["marker_scores"]) == {"a", "b", "c"}


def test_cues_first_in_list_wins_and_spans_are_the_texts_own(spark):
    text = "So BETA came; ALPHA ONE... alpha Ünï be."
    rows = {r["detection_id"]: r for r in cue_hits(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string"), {"small": SMALL}).collect()}
    assert set(rows) == {"a1", "b1"}
    assert rows["a1"]["span"] == "ALPHA ONE" and text[rows["a1"]["char_start"] : rows["a1"]["char_end"]] == "ALPHA ONE"
    assert rows["b1"]["char_start"] == 3 and rows["b1"]["confidence"] == 0.55 and "'beta'" in rows["b1"]["rationale"]
    assert cue_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), {}).count() == 0


def test_zero_rows_and_blank_texts(spark):
    docs = spark.createDataFrame([(1, "   \n"), (2, "plain"), (3, None)], "doc_id long, text string")
    rows = grade_documents(docs, {"small": SMALL}, receipts=True).collect()
    assert [(r["doc_id"], r["index"], r["tier"], r["receipts"]) for r in rows] == [(2, 0.0, "low", None)]


def test_receipts_keep_unknown_hits(spark):
    hits = spark.createDataFrame([(1, "small", "ghost", 1.0, 0), (1, "small", "a1", 1.0, 1)], "doc_id long, lens_id string, detection_id string, confidence double, hit_ord int")
    r = grading.grade(spark.createDataFrame([(1, 100)], "doc_id long, token_count int"), hits, {"small": SMALL}, receipts=True).first()
    assert [h["detection_id"] for h in r["receipts"]] == ["ghost", "a1"] and r["markers_present"] == ["a"]


def test_subject_summary_and_timeline(spark):
    def rows(name, values, dates=None):
        return [(f"{name}{i}", name, "small", float(v), ["a"] if v else [], dates[i] if dates else f"2020-01-{i + 1:02d}", i) for i, v in enumerate(values)]

    data = rows("up", [0, 0, 9]) + rows("down", [9, 0]) + rows("flat", [1, 5]) + rows("one", [7]) + rows("odd", [0, 10, 0, 0, 0]) + rows("none", [1, 90], [None, ""])
    df = spark.createDataFrame(data, "doc_id string, subject string, lens_id string, index double, markers_present array<string>, date string, ord int")
    got = {r["subject"]: r for r in grading.subject_summary(df).collect()}
    assert {k: r["trend"] for k, r in got.items()} == {"up": "flat", "down": "falling", "flat": "flat", "one": "insufficient-data", "odd": "flat", "none": "insufficient-data"}
    assert got["up"]["max_index"] == 9 and got["up"]["mean_index"] == 3 and got["up"]["n_documents_with_signal"] == 1
    lines = grading.timeline(df, ["small"]).collect()
    assert len(lines) == 13 and [r["small"] for r in lines if r["subject"] == "odd"] == [0, 10, 0, 0, 0]
    order = grading.in_order(df.filter("subject IN ('none', 'one')")).select("doc_id").collect()
    assert [r[0] for r in order] == ["one0", "none0", "none1"]


def test_person_text_and_api(spark):
    lenses = load_lenses()
    docs = spark.createDataFrame([(None, "Released under the MIT License.", "2020-01-01", 0), (None, "write to us @mail", "2020-02-01", 1)], "doc_id string, text string, date string, ord int")
    summary, line = grade_person(docs, lenses, "p")
    assert {r["subject"] for r in summary.collect()} == {"p"} and [r["doc_id"] for r in line.collect()] == ["p#0", "p#1"]
    one = {r["lens_id"]: r for r in grade_text(spark, "Released under the MIT License.", lenses).collect()}
    assert set(one) == set(text_lenses(lenses)) and one["license_register"]["markers_present"] == ["permissive"]
    api = detect_api(spark.createDataFrame([(1, "x" * 50000 + " mit license")], "doc_id long, text string"), lenses).collect()
    assert len(api) == len(lenses) and api[0]["index"] == 0
    odd = spark.createDataFrame([(1, None), (2, " \n"), (3, " " * 50_000 + "x"), (4, "x")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in api_errors(odd).collect()) == [1, 2, 3]
    assert service_health(lenses) == {"ok": True, "lenses": sorted(lenses)}


def test_lens_files(tmp_path):
    lenses = load_lenses()
    assert len(lenses) == 6 and lenses["revolving_door"].config.density_cap == 0
    bare = tmp_path / "x" / "taxonomy.yaml"
    bare.parent.mkdir()
    bare.write_text("id: x\nname: X\nmarkers: []\n")
    assert load_lens(bare).config == Config() and load_lens(bare).description == ""
    assert requested(lenses, ["nope"]) == {}
    with pytest.raises(KeyError):
        requested(lenses, ["nope"], strict=True)
    assert few_shot(SMALL) == [("a2", "gold")]
    shot = cue_snapshot({"small": SMALL})
    assert [m["id"] for m in shot[0]["markers"]] == ["a", "b"]


def test_lens_without_markers_or_tiers(spark):
    bare = Lens("bare", "Bare", (), config=Config(tiers=()))
    r = grading.grade(spark.createDataFrame([(1, 10)], "doc_id long, token_count int"), spark.createDataFrame([], "doc_id long, lens_id string, detection_id string, confidence double"), {"bare": bare}).first()
    assert (r["index"], r["tier"]) == (0.0, "unknown")
    low = Lens("low", "Low", (Marker("a", "A", 1.0),), config=Config(threshold=0.0))
    r = grading.grade(spark.createDataFrame([(1, 10)], "doc_id long, token_count int"), spark.createDataFrame([], "doc_id long, lens_id string, detection_id string, confidence double"), {"low": low}).first()
    assert r["markers_present"] == ["a"] and F.col("x") is not None
