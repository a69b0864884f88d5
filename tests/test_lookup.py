"""Look-ups of many queries against one at a time; the SQL catalog; percentiles of mostly equal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmark.functions import catalog
from lensmark.operators import graph
from lensmark.operators.detection import cue_hits
from lensmark.operators.lookup import lookup_many
from lensmark.operators.subjects import lookup
from lensmark.plans.lenses import Lens, load_lenses, pair_lenses, text_lenses
from lensmark.sources import scratch


def test_many_equal_one_at_a_time(spark):
    rng = np.random.default_rng(8)
    names = ["".join(rng.choice(list("abÜ "), int(rng.integers(1, 9)))) for _ in range(120)] + [None, "", "Acme Corp", "acme corp", "ACME"]
    entities = spark.createDataFrame([(f"n{i}", n, 1000 - i) for i, n in enumerate(names)], "id string, name string, ord long")
    asked = ["a", "ab", "AB ", "abÜ", "ab a", "aaab", "acme", "acme corp", "cme c", "n7", "N1", "zzz", "zzzz", "", "  ", None, "corp", *names[:40]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {r["query_id"]: r["id"] for r in lookup_many(entities, queries).collect()}
    rows = [(r["id"], (r["name"] or "").lower(), r["ord"]) for r in entities.collect()]
    for i, q in enumerate(asked):
        q = (q or "").strip().lower()
        best = min(((0 if q in (k.lower(), n) else 1, o, k) for k, n, o in rows if q and (q in k.lower() or q in n)), default=(0, 0, None))
        assert got.get(i) == best[2], q
    for i in (0, 4, 6, 10):
        assert lookup(entities, asked[i]).first()["id"] == got[i]
    plan = lookup_many(entities, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert lookup_many(entities.limit(0), queries).count() == 0 == lookup_many(entities, queries.limit(0)).count()


@pytest.mark.parametrize("lenses", [text_lenses(load_lenses()), pair_lenses(["of", "the", "to", "and", "in", "is", "it's", "by\\", "x"]), {"bare": Lens("bare", "Bare", ())}, {}])
def test_sql_functions(spark, lenses):
    catalog.register(spark, lenses)
    docs = spark.createDataFrame([(1, "Released under the MIT License. write @mail"), (2, "OF THE to and it's to by\\ of"), (3, None), (4, "plain")], "doc_id long, text string")
    got = spark.sql("SELECT doc_id, h.* FROM {d}, LATERAL cue_hits(text) h", d=docs)
    want = cue_hits(docs, lenses)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and ("Python" in plan or "Arrow" in plan) == (len(lenses) == 9)
    one = next(iter(lenses), "none")
    assert spark.sql("SELECT h.* FROM {d}, LATERAL cue_hits(text, '" + one + "') h", d=docs).count() == want.filter(F.col("lens_id") == one).count()
    weights = {(x.id, d.id): (m.id, d.weight) for x in lenses.values() for m, d in x.detections()}
    sums = {}
    for r in want.collect():
        m, w = weights[r["lens_id"], r["detection_id"]]
        sums[r["doc_id"], r["lens_id"], m] = sums.get((r["doc_id"], r["lens_id"], m), 0) + 0.55 * w
    found = {(r["doc_id"], r["lens_id"], r["marker_id"]): r["score"] for r in spark.sql("SELECT doc_id, s.* FROM {d}, LATERAL marker_sums(text) s", d=docs).collect()}
    assert found == pytest.approx({k: min(1.0, v) for k, v in sums.items()})


def test_scalar_sql_functions(spark):
    catalog.register(spark)
    r = spark.sql("SELECT token_estimate(' a b  c'), token_estimate(NULL), html_to_text('<p>a</p><script>x</script> b'), injection_flag('Ignore all previous'), injection_flag(NULL), blank(' '), blank('x'), span_start('abc', 'c'), span_start('abc', ''), top_percent(0.999D)").first()
    assert tuple(r) == (4, 1, "a b", True, False, True, False, 2, None, 1)


def test_percentiles_of_mostly_equal_values(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 450, 0.0).otherwise(F.col("id") / 7).alias("v"))
    few = sorted(map(tuple, graph.percentiles(df, "v", "p", "c").select("id", "v", "p", "c").collect()))
    monkeypatch.setattr(graph, "BROADCAST_VALUES", 0)
    assert few == sorted(map(tuple, graph.percentiles(df, "v", "p", "c").select("id", "v", "p", "c").collect()))
    assert {r[2] for r in few if r[1] == 0} == {0.9} and len(few) == 500


def test_scratch_tables_can_be_dropped(spark):
    from pathlib import Path

    df = spark.range(3)
    with scratch.scratch_tables(spark) as outer:
        a = scratch.written(df, "a")
        with scratch.scratch_tables(spark) as inner:
            b = scratch.written(a, "b")
            scratch.written_text(df.select(F.col("id").cast("string")), "c")
            assert b.count() == 3 and len(inner) == 2 and len(outer) == 3
        assert not any(Path(p).exists() for p in inner) and Path(outer[0]).exists()
    assert not Path(outer[0]).exists() and not scratch._watched
