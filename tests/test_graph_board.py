"""Graph measures against plain computation; careers; boards; evaluation; look-ups."""

import random
from collections import deque

import pytest

from lensmark.operators import board, careers, evaluation, subjects
from lensmark.operators import graph as G
from lensmark.plans import registry, tables
from lensmark.plans.lenses import load_lenses

E, D = "id string, name string, sector string", "source string, target string, rel string"


def random_graph(seed=1, n=40, m=60):
    rng = random.Random(seed)
    ents = [(f"n{i}", f"Name {i}", rng.choice(["gov", "tech", "tank", None])) for i in range(n)]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", None) for _ in range(m)] + [("n1", None, None), ("n2", "ghost", None)]
    return ents, edges


def plain_graph(ents, edges):
    adj = {e[0]: set() for e in ents}
    for s, t, _ in edges:
        if s and t and s != t:
            adj.setdefault(s, set()).add(t)
            adj.setdefault(t, set()).add(s)
    return adj


def plain_betweenness(adj):
    out = dict.fromkeys(adj, 0.0)
    for s in adj:
        order, preds, paths, depth, q = [], {v: [] for v in adj}, dict.fromkeys(adj, 0.0), {s: 0}, deque([s])
        paths[s] = 1.0
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    q.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    preds[w].append(v)
        dep = dict.fromkeys(adj, 0.0)
        for w in reversed(order):
            for v in preds[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                out[w] += dep[w]
    n = len(adj)
    return {v: x / 2 / ((n - 1) * (n - 2) / 2) for v, x in out.items()}


def test_measures(spark):
    ents, edges = random_graph()
    adj = plain_graph(ents, edges)
    entities, ties = spark.createDataFrame(ents, E), G.neighbours(spark.createDataFrame(edges, D)).cache()
    nodes = G.nodes(entities, ties).cache()
    assert {r["id"]: r["degree"] for r in G.degree(nodes, ties).collect()} == {k: len(v) for k, v in adj.items()}
    want = plain_betweenness(adj)
    for f in (G.betweenness_by_source, G.betweenness_by_level):
        assert dict(map(tuple, f(nodes, ties).collect())) == pytest.approx(want, abs=1e-12)
    sector = {e[0]: e[2] for e in ents} | {"ghost": None}
    open_triads = sum(1 for b in adj if sector[b] for a in adj[b] for c in adj[b] if a != c and sector[a] and sector[c] and c not in adj[a])
    roles = G.brokerage_roles(nodes, ties).collect()
    assert sum(r[k] for r in roles for k in G.ROLES) == open_triads
    bridged = {r["id"]: r["bridged"] for r in G.bridged_sectors(nodes, ties).collect()}
    assert bridged == {v: sorted({sector[w] for w in adj[v]} - {None, sector[v]}) for v in adj}
    measured = G.metrics(entities, spark.createDataFrame(edges, D)).cache()
    values = sorted(want.values())
    assert measured.first()["betweenness_cut"] == pytest.approx(values[round(0.9 * (len(values) - 1))])
    hits = {(r["doc_id"], r["detection_id"]) for r in G.network_hits(measured).collect()}
    cut = values[round(0.9 * (len(values) - 1))]
    assert {d for d, k in hits if k == "high-betweenness"} == {v for v, x in want.items() if x > 0 and x >= cut - 1e-12}
    assert G.network_grades(measured, load_lenses()).count() == len(adj)


def test_top_node(spark):
    values = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0)], "id string, v double")
    assert [r["id"] for r in G.top(values, "v").collect()] == ["a"] and [r["id"] for r in G.top(values, "v", 5).collect()] == ["a", "b", "c"]


def test_decile_of_nothing(spark):
    assert G.decile_cut(spark.createDataFrame([], "x double"), "x").first()[0] == float("inf")


def test_careers(spark):
    ents = [("p", "P", None), ("q", "Q", None), ("f", "Fund", "fin")] + [(s, s.upper(), s) for s in ("tank", "tech", "gov", "media")]
    edges = [("p", "tank", "employed-by"), ("p", "tech", "moved-to"), ("p", "gov", None), ("p", "media", ""), ("p", "nowhere", "founded"), ("p", "tech", "authored"), ("q", "tank", None), ("tech", "f", "funded-by"), ("tank", "f", "funded-by"), ("tech", "f", "funded-by")]
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], D + ", edge_ord int")
    rows = careers.career_hits(spark.createDataFrame(ents, E), df).orderBy("doc_id", "hit_ord").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["detection_id"], round(r["confidence"], 3)))
    assert by == {
        "f": [("funds-three-plus", 0.8), ("funds-recipient-and-evaluator", 1.0)],
        "p": [("spans-three-sectors", 0.9), ("spans-four-plus-sectors", 1.0), ("three-plus-moves", 1.0), ("five-plus-moves", 1.0), ("watchdog-then-join", 1.0), ("crosses-gov-industry", 1.0)],
    }
    assert rows[2]["span"].startswith("TANK (tank) -> TECH (tech) -> GOV (gov) -> MEDIA (media) -> nowhere (?)")
    grades = {r["doc_id"]: r["index"] for r in careers.career_grades(spark.createDataFrame(ents, E), df, load_lenses()).collect()}
    assert grades["q"] == 0 and grades["p"] > grades["f"] > 0


def records(spark):
    rows = [
        ("I", "license_register", "permissive", "mv", "x", "FACT", 1.0, 0.5, "s", ["u"], None, 0), ("J", "license_register", "nope", "mv", "y", "RUMOR", 1.0, 0.0, "s", [], None, 1), ("J", "ghost", "m", "mv", "y", "ATTRIBUTED", 0.5, None, "s", None, None, 2),
        ("K", "license_register", "restricted", "mv", "z", "FACT", 0.5, 0.0, "s", ["u"], None, 3), ("I", "license_register", "permissive", "mv", "y", "FACT", 0.2, 0.25, "s", ["u"], None, 4),
    ]
    return spark.createDataFrame(rows, "institution string, lens string, marker string, move string, actor string, assurance string, severity double, self_correction double, span string, receipts array<string>, note string, ord long")


def test_board(spark, tmp_path):
    r = records(spark)
    ranked = board.board(r)
    rows = ranked.orderBy("rank").collect()
    assert [(x["rank"], x["institution"], x["fact"], x["unverified"]) for x in rows] == [(1, "I", 0.65, 0.0), (2, "K", 0.5, 0.0), (3, "J", 0.0, 0.55)]
    assert rows[0]["by_actor"] == {"x": 0.5, "y": 0.15} and rows[0]["self_correction_mean"] == 0.38
    kinds = sorted(x["kind"] for x in board.validate(r, load_lenses()).collect())
    assert kinds == ["no-receipt", "no-receipt", "unknown-lens", "unknown-marker"]
    with pytest.raises(Exception, match="unknown assurance"):
        board.record_score(r.withColumn("assurance", r["institution"])).collect()
    path = str(tmp_path / "cuts")
    board.write_cut(ranked, path, "2024-01-01")
    board.write_cut(board.board(r.filter("ord < 4")), path, "2024-02-01")
    board.write_cut(ranked, path, "2024-01-01")
    prior = board.prior_cut(spark, path, "2024-02-01")
    assert prior.count() == 3 and board.prior_cut(spark, path, "2024-01-01", only_earlier=True) is None
    assert board.prior_cut(spark, path, "2024-01-01").count() == 3
    shown = lambda before, now: [x["line"] for x in board.delta_lines(board.delta(before, now)).collect()]
    assert shown(ranked, ranked) == ["- No change since the prior cut."]
    assert shown(board.board(r.filter("ord < 3")), ranked.filter("institution <> 'J'")) == ["- **New on the board:** K", "- **Dropped:** J", "- **I:** FACT 0.5->0.65 (+0.15)"]
    assert tuple(board.totals(ranked).first()) == (3, 5)
    best = [(x["institution"], x["place"], x["score"], x["actor"]) for x in board.receipts(r).orderBy("institution", "place").collect()]
    assert best == [("I", 1, 0.5, "x"), ("I", 2, 0.15, "y"), ("J", 1, 0.3, "y"), ("J", 2, 0.25, "y"), ("K", 1, 0.5, "z")]
    inside = {x["institution"]: x for x in board.nested(r).collect()}
    assert [x["score"] for x in inside["I"]["records"]] == [0.5, 0.15] and inside["I"]["sc_credits"] == [0.5, 0.25] and inside["J"]["sc_credits"] == []
    text = board.render(ranked, r).split("\n")
    assert text[0].startswith("| # | Institution |") and text[2] == "| 1 | I | 0.65 | 0.0 | 1 | x:0.5, y:0.15 | 0.38 |" and len(text) == 5 + 3 * 2 + 5
    assert "### J (FACT 0.0, unverified 0.55)" in text and text[7].endswith('score 0.5: "s" [src](u)')
    board.write_board(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "board.json")).count() == 3
    assert [x[0] for x in spark.read.text(str(tmp_path / "out" / "board.md")).collect()] == text


def test_credits_are_those_of_nested_boards_and_no_records_are_gathered(spark):
    r = records(spark)
    want = {x["institution"]: (len(x["records"]), len(x["sc_credits"]), sum(x["sc_credits"])) for x in board.nested(r).collect()}
    assert {x[0]: tuple(x)[1:] for x in board.credits(r).collect()} == want
    plan = registry.queries()["board_credits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("lineitem") <= 1


def test_records_are_not_shuffled_for_customers(spark):
    """Orders meet customers first: of the joins of lines none is by customer."""
    plan = tables.records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x.strip(" :+-") for x in plan.split("\n") if "Join Inner" in x]
    assert [i for i, x in enumerate(joins) if "c_custkey" in x] == [len(joins) - 1]


def test_roles_against_brute_force(spark):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(26)]
    sector = {i: rng.choice(["a", "b", "c", None]) for i in ids}
    ties = {tuple(sorted(rng.sample(ids, 2))) for _ in range(110)} | {tuple(sorted(("n0", i))) for i in ids[1:]}
    near = {i: {a if b == i else b for a, b in ties if i in (a, b)} for i in ids}
    want = {i: dict.fromkeys(G.ROLES, 0) for i in ids}
    for b in ids:
        for x in near[b]:
            for y in near[b] - near[x] - {x}:
                if None not in (g := (sector[x], sector[b], sector[y])):
                    kind = "coordinator" if g[0] == g[1] == g[2] else "representative" if g[0] == g[1] else "gatekeeper" if g[1] == g[2] else "consultant" if g[0] == g[2] else "liaison"
                    want[b][kind] += 1
    adj = G.neighbours(spark.createDataFrame(sorted(ties), "source string, target string"))
    every = G.nodes(spark.createDataFrame([(i, i, sector[i]) for i in ids] + [("alone", "alone", "a")], E), adj)
    got = {r["id"]: r.asDict() for r in G.brokerage_roles(every, adj).collect()}
    assert got.pop("alone")["liaison"] == 0 and {i: {k: r[k] for k in G.ROLES} for i, r in got.items()} == want


def test_a_hub_with_many_neighbours(spark):
    n = 100_000
    edges = spark.range(n).selectExpr("'hub' AS source", "concat('x', id) AS target").union(spark.range(5).selectExpr("'x0' AS source", "concat('x', id + 1) AS target"))
    entities = spark.range(n).selectExpr("concat('x', id) AS id", "concat('x', id) AS name", "if(id % 2 = 0, 'a', 'b') AS sector").union(spark.createDataFrame([("hub", "hub", "a")], E))
    adj = G.neighbours(edges)
    r = G.brokerage_roles(G.nodes(entities, adj), adj).filter("id = 'hub'").first()
    half = n // 2
    assert (r["coordinator"], r["gatekeeper"], r["representative"], r["consultant"], r["liaison"]) == (half * (half - 1) - 4, half * half - 3, half * half - 3, half * (half - 1), 0)


def test_cuts_and_percentiles_against_sorting(spark):
    rng = random.Random(2)
    for n in (1, 6, 7, 400):
        v = [rng.choice((0.0, 0.5, rng.random())) for _ in range(n)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v double").repartition(5)
        assert G.decile_cut(df, "v").first()["cut"] == sorted(v)[round(0.9 * (n - 1))]
        got = {r["id"]: r["p"] for r in G.percentiles(df, "v", "p").collect()}
        assert got == {i: sum(y <= x for y in v) / n for i, x in enumerate(v)}
    assert G.decile_cut(df.limit(0), "v").first()["cut"] == float("inf")


def test_evaluation(spark):
    fixtures = spark.createDataFrame([("a", "l", True, "cues", ["m"]), ("b", "l", True, "cues", ["x"]), ("c", "l", False, "cues", []), ("d", "l", True, "llm", []), ("e", "l", True, "cues", [])], "id string, lens string, should_fire boolean, min_backend string, expect_any array<string>")
    grades = spark.createDataFrame([("a", "l", ["m"]), ("b", "l", ["m"]), ("c", "l", [])], "doc_id string, lens_id string, markers_present array<string>")
    counts = evaluation.floor_counts(fixtures, grades)
    assert tuple(counts.first()) == (2, 3, 1, 1, 1, 2, 1, 2) and not evaluation.passes(counts)
    assert tuple(evaluation.floor_counts(fixtures, grades, "llm").first())[6] == 0
    rows = spark.createDataFrame([(True, True), (False, False), (True, False)], "expected boolean, kept boolean")
    assert tuple(evaluation.confusion(rows).first()) == (1, 0, 1, 1, False)


def test_lookup_and_affiliations(spark):
    ents = spark.createDataFrame([("a", "Alpha Works", 0), ("b", "Works", 1), ("c", "Other", 2)], "id string, name string, ord int")
    assert subjects.lookup(ents, "works").first()["id"] == "b" and subjects.lookup(ents, "alph").first()["id"] == "a" and subjects.lookup(ents, "zzz").count() == 0
    edges = spark.createDataFrame([("a", "b", "founded"), ("b", "a", "founded"), ("a", "x", None)], D)
    got = {r["id"]: r["affiliations"] for r in subjects.affiliations(ents, edges).collect()}
    assert got["a"] == ["Works (founded)", "x"] and got["b"] == ["Alpha Works (founded)"]


def test_profile_lanes(spark):
    ents, edges = spark.createDataFrame([("p", "P", None), ("t", "T", "tech")], E), spark.createDataFrame([("p", "t", None, 0)], D + ", edge_ord int")
    docs = spark.createDataFrame([("d", "mit license", "p", None, 0)], "doc_id string, text string, subject string, date string, ord int")
    lanes = subjects.profile(ents, edges, docs, load_lenses(), "p")
    assert set(lanes) == {"revolving_door", "network_brokerage", "text"} and lanes["revolving_door"].count() == 1 and lanes["text"].count() == 4
    assert subjects.profile(ents, edges, None, {}, "p") == {"text": None}


def test_nodes_with_the_same_neighbours_are_searched_as_one(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(f"s{i}", f"h{h}", None) for i in range(300) for h in rng.sample(range(6), rng.choice((1, 2)))] + [("h0", "h1", None), ("h5", "far", None), ("far", "end", None)]
    ents = [(f"s{i}", f"S {i}", None) for i in range(300)] + [("alone", "alone", None)]
    ties = G.neighbours(spark.createDataFrame(edges, D)).cache()
    nodes = G.nodes(spark.createDataFrame(ents, E), ties).cache()
    want = plain_betweenness(plain_graph(ents, edges))
    searched = []
    for name in ("_by_source", "_by_level"):
        search = getattr(G, name)
        monkeypatch.setattr(G, name, lambda adj, weights, *more, search=search: searched.append(weights.count()) or search(adj, weights, *more))
    for f in (G.betweenness, G.betweenness_by_source, G.betweenness_by_level, lambda n, t: G.betweenness(n, t, reduced=True)):
        got = dict(map(tuple, f(nodes, ties).collect()))
        assert got == pytest.approx(want, abs=1e-12)
        assert len({got[k] for k in got if k.startswith("s")}) <= 6 + 15
    assert len(searched) == 4 and max(searched) <= 6 + 6 + 15 + 2
