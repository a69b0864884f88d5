"""Folded and sampled betweenness against the plain one; boards in one pass; cuts that are published whole or not at all."""

import random

import pytest
from pyspark.sql import functions as F

from lensmark.operators import board
from lensmark.operators import graph as G
from test_graph_board import D, E, plain_betweenness, plain_graph, random_graph, records


def tree_like(seed):
    """Cycles with trees on them, trees of their own, a pair, a star, a long path, a node alone."""
    rng = random.Random(seed)
    edges = [(f"c{i}", f"c{(i + 1) % 7}", None) for i in range(7)] + [("c0", "c3", None)]
    edges += [(f"t{i}", f"t{rng.randrange(i)}" if i and rng.random() < 0.7 else f"c{rng.randrange(7)}", None) for i in range(25)]
    edges += [("p0", "p1", None)] + [("s0", f"s{i}", None) for i in range(1, 6)] + [(f"l{i}", f"l{i + 1}", None) for i in range(9)] + [(f"u{i}", f"u{(i - 1) // 2}", None) for i in range(1, 12)]
    names = {x for e in edges for x in e[:2]} | {"alone"}
    return [(x, x, None) for x in sorted(names)], edges


@pytest.mark.parametrize(("graph", "folds", "most"), [(random_graph(3, 30, 34), 24, 4_000_000), (tree_like(1), 24, 4_000_000), (tree_like(2), 2, 4_000_000), (tree_like(3), 24, 0), (([("a", "a", None)], []), 24, 4_000_000)])
def test_folded_betweenness_equals_the_plain_one(spark, monkeypatch, graph, folds, most):
    monkeypatch.setattr(G, "FOLDS", folds)
    monkeypatch.setattr(G, "BROADCAST_TIES", most)
    ents, edges = graph
    ties = G.neighbours(spark.createDataFrame(edges, D))
    nodes = G.nodes(spark.createDataFrame(ents, E), ties).cache()
    adj = plain_graph(ents, edges)
    want = plain_betweenness(adj) if len(adj) > 2 else dict.fromkeys(adj, 0.0)
    assert dict(map(tuple, G.betweenness(nodes, ties, reduced=True).collect())) == pytest.approx(want, abs=1e-12)
    if folds > 2 and len(adj) > 50:
        core, children = G.fold(ties)
        assert core.count() < ties.count() / 3 and children.agg(F.count_distinct("child")).first()[0] == children.count()


def test_sampled_betweenness_stays_within_its_bound(spark):
    ents, edges = random_graph(5, 300, 500)
    ties = G.neighbours(spark.createDataFrame(edges, D)).cache()
    nodes = G.nodes(spark.createDataFrame(ents, E), ties).cache()
    want = plain_betweenness(plain_graph(ents, edges))
    got = dict(map(tuple, G.betweenness_sampled(nodes, ties, 0.2, 0.05).collect()))
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) <= 0.2 * 301 / 300
    assert max(abs(got[k] - want[k]) for k in want) > 0
    assert dict(map(tuple, G.betweenness_sampled(nodes, ties, 0.01).collect())) == pytest.approx(want, abs=1e-12)


def dated(spark):
    days = {0: "1995-01-01", 1: "1995-06-01", 2: "1996-06-01", 3: "1996-07-01", 4: "1999-01-01"}
    return records(spark).withColumn("day", F.element_at(F.create_map(*(F.lit(x) for k, v in days.items() for x in (k, v))), F.col("ord").cast("int")))


def test_drift_in_one_pass_equals_that_of_two_boards(spark):
    rows = dated(spark)
    for before, now in (("1995-03-01", "1996-06-15"), ("1990-01-01", "2000-01-01"), ("1996-12-01", "1995-03-01"), ("1996-12-01", "1996-12-01")):
        two = board.delta(*(board.board(rows.filter(F.col("day") < d)) for d in (before, now)))
        one = board.drift(rows, before, now)
        assert sorted(map(str, one.select(two.columns).collect())) == sorted(map(str, two.collect()))


def test_markdown_is_in_order_and_stays_distributed(spark, tmp_path):
    rows = records(spark)
    text = board.render(board.board(rows), rows).split("\n")
    assert text[0].startswith("| # | Institution") and text[1].startswith("|---") and text[2].startswith("| 1 | ")
    names = [x[4:].split(" (")[0] for x in text if x.startswith("### ")]
    assert names == [x.split(" | ")[1] for x in text[2 : 2 + len(names)]] and len(text) == 2 + 3 * len(names) + rows.count()
    board.write_board(rows, str(tmp_path / "b"))
    read = [r[0] for f in sorted((tmp_path / "b/board.md").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert read == text


def test_a_cut_is_published_whole_or_not_at_all(spark, tmp_path):
    rows, folder = records(spark), f"file:{tmp_path}/boards"
    assert board.published(spark, folder) == {}
    first = board.publish(rows, folder, "2024-01-01")
    board.publish(rows.limit(2), folder, "2024-02-01")
    assert list(board.published(spark, folder)) == ["2024-01-01", "2024-02-01"] and board.published(spark, folder)["2024-01-01"] == first
    bad = rows.withColumn("receipts", F.when(F.col("ord") == 3, F.raise_error(F.lit("a task fails")).cast("array<string>")).otherwise(F.col("receipts")))
    with pytest.raises(Exception, match="a task fails"):
        board.publish(bad, folder, "2024-01-01")
    assert board.published(spark, folder)["2024-01-01"] == first
    assert spark.read.parquet(f"{first}/cut").count() == 3 and spark.read.json(f"{first}/board.json").count() == 3 and spark.read.text(f"{first}/board.md").count() == 2 + 9 + rows.count()
    again = board.publish(rows, folder, "2024-01-01")
    assert again != first and board.published(spark, folder)["2024-01-01"] == again


def test_a_published_cut_is_compressed_and_in_order(spark, tmp_path):
    rows = records(spark)
    where = board.publish(rows, f"file:{tmp_path}/boards", "2024-01-01")
    files = [*(tmp_path / "boards").glob("versions/*/board.*/part-*")]
    assert files and all(f.name.endswith(".gz") for f in files)
    read = [r[0] for f in sorted((tmp_path / "boards").glob("versions/*/board.md/part-*")) for r in spark.read.text(str(f)).collect()]
    assert read == board.render(board.board(rows), rows).split("\n") and where.endswith(files[0].parent.parent.name)
