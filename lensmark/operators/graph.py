"""Positions in an undirected graph, for all nodes at once.

entities: id, name, sector; edges: source, target. Betweenness is a level-synchronous search from
all sources: each level is a join of the frontier with the neighbours and a sum of path counts, and
dependencies are summed level by level on the way back. Nodes with the same neighbours are searched
as one (merged()), so both grow with reachable pairs of different nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmark.functions.numbers import nearest
from lensmark.functions.text import top_percent
from lensmark.operators.grading import grade_rows
from lensmark.plans.lenses import Lens
from lensmark.sources.scratch import written

LENS = "network_brokerage"
# The roles in order; all but the first are across groups.
ROLES = ["coordinator", "gatekeeper", "representative", "consultant", "liaison"]
TOP = 0.10
#: Up to so many directed ties the neighbours travel to the driver and every task (16 bytes each); beyond, paths are counted by joins.
BROADCAST_TIES = 4_000_000


def latest(entities: DataFrame, order: str | None = None) -> DataFrame:
    """One row an id: the last by ``order``, if that is given, of those that repeat it."""
    if order is None:
        return entities.select("id", "name", "sector").dropDuplicates(["id"])
    last = entities.groupBy("id").agg(F.max_by(F.struct("name", "sector"), order).alias("e"))
    return last.select("id", "e.name", "e.sector")


def neighbours(edges: DataFrame) -> DataFrame:
    """src, dst: both directions once, without loops and open ends."""
    clean = edges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return clean.union(clean.select("dst", "src")).distinct()


def nodes(entities: DataFrame, adj: DataFrame) -> DataFrame:
    """Entities, isolated ones too, and endpoints that are none (sector null, name the id)."""
    other = adj.select(F.col("src").alias("id")).distinct().join(entities.select("id"), "id", "left_anti")
    own = entities.select("id", F.coalesce("name", "id").alias("name"), "sector")
    return own.unionByName(other.select("id", F.col("id").alias("name"), F.lit(None).cast("string").alias("sector")))


def degree(all_nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """id, degree, degree_centrality."""
    ties = adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    n = all_nodes.agg(F.count("*").alias("n"))
    out = all_nodes.select("id").join(ties, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.join(F.broadcast(n)).select("id", "degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_centrality"))


def _scaled(all_nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """Each unordered pair is counted twice in sums; normal for n > 2 nodes, isolated ones included."""
    n = F.broadcast(all_nodes.agg(F.count("*").cast("double").alias("n")))
    pairs = F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2) / 2).otherwise(F.lit(1.0))
    return all_nodes.select("id").join(sums, "id", "left").join(n).select("id", (F.coalesce("total", F.lit(0.0)) / 2 / pairs).alias("betweenness"))


def betweenness(all_nodes: DataFrame, adj: DataFrame, reduced: bool = False) -> DataFrame:
    """id, betweenness (unweighted, normalised). Nodes with the same neighbours are searched as one. Where neighbours are too many to travel then, or if ``reduced``,
    what hangs on the graph by one tie is folded away first (fold()), which changes no result; searches then run over the rest."""
    if not reduced:
        one = all_nodes.select("id", F.lit(1.0).alias("w"))
        same = merged(adj, one)
        if same[0].count() <= BROADCAST_TIES:
            return _scaled(all_nodes, _of_members(_by_source, *same).select("id", "total"))
    core, children = fold(adj)
    sums = children.groupBy(F.col("parent").alias("id")).agg(F.sum("size").cast("double").alias("folded"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    every = all_nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("folded", F.lit(0.0)).alias("folded"), F.coalesce("squares", F.lit(0.0)).alias("squares"))
    every = written(every, "folded")
    weights = every.select("id", (1 + F.col("folded")).alias("w"))
    same = merged(core, weights)
    search = _by_source if same[0].count() <= BROADCAST_TIES else _by_level
    found = written(_of_members(search, *same), "searched")  # id, total, reach
    # How many nodes a node's component has: what the search of the rest reached, or all that hangs on a node without ties; those folded have their parents'.
    kept = every.join(children.select(F.col("child").alias("id")), "id", "left_anti")
    size = kept.join(found.select("id", "reach"), "id", "left").select("id", F.coalesce("reach", 1 + F.col("folded")).alias("c"))
    rounds = children.agg(F.max("round")).first()[0] or 0
    for r in range(rounds, 0, -1):
        own = children.filter(F.col("round") == r).join(size, F.col("parent") == size["id"]).select(F.col("child").alias("id"), "c")
        size = written(size.union(own), "sizes")
    # Between two of a node's folded parts, and between these and all else, every path passes the node; each pair counts twice.
    through = F.col("folded") * F.col("folded") - F.col("squares") + 2 * F.col("folded") * (F.col("c") - 1 - F.col("folded"))
    total = every.join(size, "id").join(found.select("id", "total"), "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) + through).alias("total"))
    return _scaled(all_nodes, total)


#: Rounds in which nodes of one tie are folded into their neighbours: what hangs deeper stays, and is searched.
FOLDS = 24


def fold(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ties that are left when nodes of one tie are taken off, FOLDS times or until there are none, and what was taken off: child, parent, size (nodes of
    the child's own folded part, itself included), round. Of two nodes tied to each other only, the larger id goes."""
    left = written(adj, "ties")
    children = adj.sparkSession.createDataFrame([], f"child {adj.schema['src'].dataType.simpleString()}, parent {adj.schema['src'].dataType.simpleString()}, size long, round int")
    for r in range(1, FOLDS + 1):
        leaves = left.groupBy(F.col("src").alias("child")).agg(F.count("*").alias("n"), F.min("dst").alias("parent")).filter("n = 1").select("child", "parent")
        pair = leaves.select(F.col("child").alias("parent"), F.lit(True).alias("leaf"))
        off = leaves.join(pair, "parent", "left").filter("leaf IS NULL OR child > parent").select("child", "parent")
        sizes = children.groupBy(F.col("parent").alias("child")).agg(F.sum("size").alias("own"))
        off = written(off.join(sizes, "child", "left").select("child", "parent", (1 + F.coalesce("own", F.lit(0))).cast("long").alias("size"), F.lit(r).alias("round")), "leaves")
        if off.isEmpty():
            break
        children = children.union(off)
        gone = off.select("child")
        left = written(left.join(gone, left["src"] == gone["child"], "left_anti").join(gone, F.col("dst") == gone["child"], "left_anti"), "ties")
    return left, written(children, "children")


def merged(adj: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with the same neighbours (which are not tied to each other) as one, by the smallest id: the ties among those that stay; of each of them w (its members' weights),
    m (their number) and squares (of their weights); and id, rep of all. Sets of neighbours are told by hashes that are summed over all tasks; then each tie of a
    member is sought among its representative's, and who lacks one stands for itself. So a hub's neighbours are never a row."""
    adj = written(adj, "adjacency")
    marks = adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "dst")).alias(f"x{i}") for i in (1, 2)))
    marks = written(marks, "marks")
    first = marks.groupBy("n", "x1", "x2").agg(F.min("id").alias("rep"))
    of = written(marks.join(first, ["n", "x1", "x2"]).select("id", "rep"), "merged")
    claimed = adj.join(of.filter("id <> rep"), F.col("src") == F.col("id")).select("id", "rep", "dst")
    other = written(claimed.join(adj.select(F.col("src").alias("rep"), "dst"), ["rep", "dst"], "left_anti").select("id").distinct().withColumn("other", F.lit(True)), "others")
    of = written(of.join(other, "id", "left").select("id", F.when(F.col("other"), F.col("id")).otherwise(F.col("rep")).alias("rep")), "merged")
    classes = of.join(weights, "id").groupBy(F.col("rep").alias("id")).agg(F.sum("w").alias("w"), F.count("*").cast("double").alias("m"), F.sum(F.col("w") * F.col("w")).alias("squares"))
    classes = written(classes, "classes")
    ends = classes.select(F.col("id").alias("end"))
    core = adj.join(ends, F.col("src") == F.col("end"), "left_semi").join(ends, F.col("dst") == F.col("end"), "left_semi")
    return written(core, "ties"), classes, of


def _of_members(search: Callable[[DataFrame, DataFrame], DataFrame], core: DataFrame, classes: DataFrame, of: DataFrame) -> DataFrame:
    """A search of merged() nodes: id, total, reach of all members. Two members of a class have all their neighbours between them, which share what the pair gives."""
    found = search(core, classes.select("id", "w", "m"))
    deg = core.join(classes.select(F.col("id").alias("dst"), "m"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("m").alias("deg"))
    pairs = classes.filter("m > 1").join(deg, "id").select(F.col("id").alias("src"), ((F.col("w") * F.col("w") - F.col("squares")) / F.col("deg")).alias("g"))
    given = core.join(pairs, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("g").alias("g"))
    sums = written(found.join(given, "id", "left").select(F.col("id").alias("rep"), (F.col("total") + F.coalesce("g", F.lit(0.0))).alias("total"), "reach"), "found")
    return of.join(sums, "rep").select("id", "total", "reach")


def betweenness_sampled(all_nodes: DataFrame, adj: DataFrame, error: float = 0.01, chance: float = 0.01) -> DataFrame:
    """id, betweenness, estimated from searches of a sample of sources: with probability 1 - ``chance`` no node's value is further than ``error`` * n / (n - 1) from
    the exact one (Hoeffding's bound over all n nodes, as a source gives a node between 0 and n - 2). Where that takes as many sources as there are, the result is exact.

    An option beside betweenness(), for graphs whose pairs of nodes are too many."""
    n = all_nodes.count()
    k = min(n, max(1, math.ceil(math.log(2 * max(n, 1) / chance) / (2 * error * error))))
    if k >= n:
        return betweenness(all_nodes, adj)
    drawn = all_nodes.orderBy(F.xxhash64(F.lit("source"), "id"), "id").limit(k).select("id")
    weights = all_nodes.select("id", F.lit(1.0).alias("w"), F.lit(1.0).alias("m"))
    search = _by_source if adj.count() <= BROADCAST_TIES else _by_level
    found = search(adj, weights, drawn)
    return _scaled(all_nodes, found.select("id", (F.col("total") * (n / k)).alias("total")))


def betweenness_by_level(all_nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """By joins only: one round a level."""
    return _scaled(all_nodes, _of_members(_by_level, *merged(adj, all_nodes.select("id", F.lit(1.0).alias("w")))).select("id", "total"))


def _by_level(adj: DataFrame, weights: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """weights: id, w, m, where a node stands for m nodes with the same neighbours, whose weights make up w. id, total (what all sources give each of these: its share of
    paths to each node, times both ends' weights), reach (the weight that a source's search meets). Paths from a source to others of its own class are not counted."""
    adj = written(adj.join(weights.toDF("dst", "w", "m"), "dst").select("src", "dst", "w", "m"), "adjacency")
    start = adj.select(F.col("src").alias("s")).distinct()
    if sources is not None:
        start = start.join(sources.toDF("s"), "s", "left_semi")
    start = start.join(weights.select(F.col("id").alias("s"), "w"), "s")
    seen = written(start.select("s", F.col("s").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"), "w", F.lit(1.0).alias("m")), "level")
    frontier, last, level = seen, seen.limit(0), 0
    while True:
        level += 1
        met = frontier.select("s", F.col("v").alias("src"), (F.col("paths") * F.col("m")).alias("paths")).join(adj, "src")
        step = met.groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"), F.max("w").alias("w"), F.max("m").alias("m"))
        near = frontier.union(last).select("s", "v")  # a neighbour of a level lies in it, in the one before, or in a new one
        step = written(step.join(near, ["s", "v"], "left_anti").select("s", "v", F.lit(level).alias("d"), "paths", "w", "m"), "level")
        if step.isEmpty():
            break
        seen, last, frontier = seen.union(step), frontier, step
    seen = written(seen, "paths")
    reach = seen.groupBy(F.col("s").alias("id")).agg(F.sum("w").alias("reach"))
    back = seen.filter(F.col("d") == level - 1).select("s", "v", F.lit(0.0).alias("dependency"))
    total = back
    for d in range(level - 2, 0, -1):
        below = seen.filter(F.col("d") == d + 1).join(back, ["s", "v"]).select("s", F.col("v").alias("to"), ((F.col("w") + F.col("m") * F.col("dependency")) / F.col("paths")).alias("share"))
        above = below.join(adj.select("src", "dst"), F.col("to") == F.col("src")).select("s", F.col("dst").alias("v"), "share").groupBy("s", "v").agg(F.sum("share").alias("share"))
        own = seen.filter(F.col("d") == d).join(above, ["s", "v"], "left")
        back = written(own.select("s", "v", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dependency")), "back")
        total = total.union(back)
    sums = total.join(weights.select(F.col("id").alias("s"), "w"), "s").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("dependency") * F.col("w")).alias("total"))
    return sums.join(reach, "id", "full_outer").select("id", F.coalesce("total", F.lit(0.0)).alias("total"), "reach")


def betweenness_by_source(all_nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Sources in parallel, each search in a task over the neighbours (BROADCAST_TIES at most), which travel as numbers; node
    sums are partial by task."""
    return _scaled(all_nodes, _of_members(_by_source, *merged(adj, all_nodes.select("id", F.lit(1.0).alias("w")))).select("id", "total"))


def _by_source(adj: DataFrame, weights: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """As _by_level()."""
    known = written(adj.select(F.col("src").alias("id")).distinct().join(weights, "id").withColumn("at", F.monotonically_increasing_id()), "numbers")
    number = known.select("id", "at")
    ties = adj.join(number.toDF("src", "s"), "src").join(number.toDF("dst", "d"), "dst").select("s", "d").toArrow()
    of = known.select("at", "w", "m").toArrow()
    s, d = ties.column("s").to_numpy(), ties.column("d").to_numpy()
    numbers = np.sort(of.column("at").to_numpy())
    w, m = (of.column(c).to_numpy()[np.argsort(of.column("at").to_numpy())] for c in "wm")
    order = np.lexsort((d, s))
    cut = np.searchsorted(s[order], numbers)
    shared = adj.sparkSession.sparkContext.broadcast((numbers, np.searchsorted(numbers, d[order]), np.append(cut, len(s)), w, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, dst, cut, w, m = shared.value
        total, reach = np.zeros(len(numbers)), np.full(len(numbers), np.nan)
        for batch in batches:
            for source in np.searchsorted(numbers, batch["at"].to_numpy()):
                share, reach[source] = _dependencies(int(source), dst, cut, w, m)
                total += share * w[source]
        yield pd.DataFrame({"at": numbers, "total": total, "reach": reach})

    wanted = known.join(sources, "id", "left_semi") if sources is not None else known
    sums = wanted.select("at").repartition("at").mapInPandas(run, "at long, total double, reach double").groupBy("at").agg(F.sum("total").alias("total"), F.max(F.when(~F.isnan("reach"), F.col("reach"))).alias("reach"))
    return known.join(sums, "at").select("id", "total", "reach")


def _dependencies(s: int, dst: np.ndarray, cut: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, float]:
    n = len(cut) - 1
    depth, paths, out = np.full(n, -1), np.zeros(n), np.zeros(n)
    depth[s], paths[s] = 0, 1.0
    levels, front = [], np.array([s])
    while len(front):
        size = cut[front + 1] - cut[front]
        at = np.repeat(cut[front] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        a, b = np.repeat(front, size), dst[at]
        ahead = depth[b] < 0
        a, b = a[ahead], b[ahead]
        np.add.at(paths, b, paths[a] * m[a] if levels else paths[a])  # the source is one node of its class
        levels.append((a, b))
        front = np.unique(b)
        depth[front] = len(levels)
    for a, b in reversed(levels):
        np.add.at(out, a, paths[a] / paths[b] * (w[b] + m[b] * out[b]))
    out[s] = 0
    return out, float(w[depth >= 0].sum())


def role(a: Column, b: Column, c: Column) -> Column:
    return F.when((a == b) & (b == c), ROLES[0]).when((a == b) & (b != c), ROLES[2]).when((a != b) & (b == c), ROLES[1]).when((a == c) & (a != b), ROLES[3]).otherwise(ROLES[4])


def brokerage_roles(all_nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """id and a count a role: ordered open triads a - id - c whose three sectors are known.

    All pairs of a node's neighbours are counted from its neighbours' numbers by sector, and those that are tied themselves are taken off.
    These are found as triangles of ties that point to the end of more ties, so a hub's pairs are never rows.
    """
    sectors = all_nodes.filter("sector IS NOT NULL").select("id", "sector")
    known = written(adj.join(sectors.toDF("src", "gs"), "src").join(sectors.toDF("dst", "gd"), "dst").select("src", "dst", "gs", "gd"), "known")
    by_sector = known.groupBy(F.col("src").alias("id"), "gs", "gd").agg(F.count("*").alias("n"))
    own, other = F.when(F.col("gd") == F.col("gs"), F.col("n")).otherwise(0), F.when(F.col("gd") != F.col("gs"), F.col("n")).otherwise(0)
    sums = by_sector.groupBy("id").agg(F.sum(own).alias("own"), F.sum(other).alias("other"), F.sum(other * other).alias("squares"))
    across = F.col("own") * F.col("other")
    pairs = dict(zip(ROLES, (F.col("own") * (F.col("own") - 1), across, across, F.col("squares") - F.col("other"), F.col("other") * F.col("other") - F.col("squares")), strict=True))
    every = sums.select("id", *(c.alias(r) for r, c in pairs.items()))

    ties = known.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    ends = known.join(ties.toDF("src", "ds"), "src").join(ties.toDF("dst", "dd"), "dst")
    up = written(ends.filter(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst", "gs", "gd"), "oriented")
    wedges = up.toDF("x", "y", "gx", "gy").join(up.select(F.col("src").alias("x"), F.col("dst").alias("z"), F.col("gd").alias("gz")), "x")
    triangles = wedges.join(up.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    middle = [F.struct(F.col(b).alias("id"), role(F.col("g" + a), F.col("g" + b), F.col("g" + c)).alias("role")) for b, a, c in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")]
    closed = triangles.select(F.explode(F.array(*middle)).alias("m")).groupBy("m.id").agg(*(F.count_if(F.col("m.role") == r).alias(f"closed_{r}") for r in ROLES))
    found = every.join(closed, "id", "left")
    return all_nodes.select("id").join(found, "id", "left").select("id", *(F.coalesce(F.col(r) - F.coalesce(f"closed_{r}", F.lit(0)), F.lit(0)).alias(r) for r in ROLES))


def bridged_sectors(all_nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """id, bridged: the neighbours' sectors, sorted, without the own and null."""
    other = adj.join(all_nodes.select(F.col("id").alias("dst"), F.col("sector").alias("s")), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("s").alias("s"))
    out = all_nodes.join(other, "id", "left")
    own = F.when(F.col("sector").isNull(), F.array().cast("array<string>")).otherwise(F.array("sector"))
    return out.select("id", F.array_sort(F.array_except(F.coalesce("s", F.array().cast("array<string>")), own)).alias("bridged"))


def cumulative(values: DataFrame, column: str) -> DataFrame:
    """Per distinct value of a column: upto (how many values are not greater) and n (all). Values are sorted over all tasks; within
    a sorted partition they are summed up, and what earlier partitions hold is added."""
    sorted_ = values.groupBy(column).agg(F.count("*").alias("c")).orderBy(column).withColumn("at", F.monotonically_increasing_id())
    sorted_ = written(sorted_.withColumn("part", F.shiftright("at", 33)), "sorted")
    sums = sorted_.groupBy("part").agg(F.sum("c").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("n"))
    within = F.sum("c").over(Window.partitionBy("part").orderBy("at"))
    return sorted_.withColumn("within", within).join(F.broadcast(sums), "part").select(column, (F.col("before") + F.col("within")).alias("upto"), "n")


def _cut(upto: DataFrame, column: str, top: float) -> DataFrame:
    reached = upto.filter(F.col("upto") > F.bround((1.0 - top) * (F.col("n") - 1), 0))
    return reached.agg(F.coalesce(F.min(column), F.lit(float("inf"))).alias("cut"))


def decile_cut(values: DataFrame, column: str, top: float = TOP) -> DataFrame:
    """cut: the value at nearest rank round((1 - top) * (n - 1)), ties to even; infinity for no values."""
    return _cut(cumulative(values, column), column, top)


def top(values: DataFrame, column: str, k: int = 1) -> DataFrame:
    """The k rows with the largest values, ties to the smaller id."""
    return values.orderBy(F.desc(column), "id").limit(k)


#: Up to so many distinct values their shares travel to every task (some 32 bytes each).
BROADCAST_VALUES = 1_000_000
#: In how many parts rows of one value are dealt where values are more.
PARTS = 32


def percentiles(values: DataFrame, column: str, name: str = "percentile", cut: str | None = None, top: float = TOP) -> DataFrame:
    """values with the share of values that are not greater than the row's own and, if named, the decile cut. Most rows may share one value, as zeros do: distinct
    values are broadcast where they are few, else copied for PARTS parts of the rows."""
    upto = cumulative(values, column)
    shares = upto.select(column, (F.col("upto") / F.col("n")).alias(name))
    if upto.count() <= BROADCAST_VALUES:
        out = values.join(F.broadcast(shares), column)
    else:
        copies = shares.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        out = values.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(copies, [column, "part"]).drop("part")
    return out.join(F.broadcast(_cut(upto, column, top).withColumnRenamed("cut", cut))) if cut else out


def _steep(p: Column, base: float) -> Column:
    return nearest(F.when(p > 0.9, F.least(F.lit(1.0), base + (1 - base) * (p - 0.9) / 0.1)).otherwise(F.lit(base)), 3)


def metrics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """All measures of all nodes, once; subjects are filters on it."""
    adj = written(neighbours(edges), "adjacency")
    every = written(nodes(entities, adj), "nodes")
    out = every.join(degree(every, adj), "id").join(betweenness(every, adj), "id").join(brokerage_roles(every, adj), "id").join(bridged_sectors(every, adj), "id")
    out = written(out, "metrics")
    # values that differ by their order of adding alone are ties
    out = percentiles(out.withColumn("near", nearest("betweenness", 12)), "near", "betweenness_percentile").drop("near")
    out = out.join(F.broadcast(decile_cut(written(out.select("betweenness"), "values"), "betweenness").withColumnRenamed("cut", "betweenness_cut")))
    return percentiles(out, "degree_centrality", "degree_centrality_percentile", "degree_centrality_cut")


def _network_rows(measured: DataFrame) -> DataFrame:
    """doc_id and hits, a row a node."""
    b, d = F.col("betweenness"), F.col("degree_centrality")
    rows = measured.join(F.broadcast(measured.agg(F.count("*").alias("n"))))
    across = F.col(ROLES[1]) + F.col(ROLES[2]) + F.col(ROLES[3]) + F.col(ROLES[4])
    names = F.array_join("bridged", ", ")
    mix = F.concat_ws(", ", *(F.when(F.col(r) > 0, F.concat(F.lit(f"{r}:"), F.col(r))) for r in ROLES))
    sector = F.coalesce("sector", F.lit("?"))
    rules = [
        ("high-betweenness", (b > 0) & (b >= F.col("betweenness_cut") - 1e-12), _steep(F.col("betweenness_percentile"), 0.8),
         F.concat(F.col("name"), F.format_string(": betweenness %.3f (top %d%% of %d nodes); bridges sectors ", b, top_percent(F.col("betweenness_percentile")), F.col("n")), F.when(F.size("bridged") > 0, names).otherwise(sector))),
        ("hub-degree", (F.col("degree") > 0) & (d >= F.col("degree_centrality_cut")), _steep(F.col("degree_centrality_percentile"), 0.75),
         F.concat(F.col("name"), F.format_string(": degree %d (centrality %.3f, top %d%% of %d nodes)", F.col("degree"), d, top_percent(F.col("degree_centrality_percentile")), F.col("n")))),
        ("cross-group-broker", (across > 0) & (F.size("bridged") >= 2), F.round(F.least(F.lit(1.0), 0.7 + 0.15 * (F.size("bridged") - 2)), 3),
         F.concat(F.col("name"), F.lit(" ("), sector, F.lit(") brokers across "), F.size("bridged"), F.lit(" sectors ["), names, F.lit("]; roles {"), mix, F.lit("}"))),
    ]
    found = (F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(i).alias("hit_ord"), F.lit(LENS).alias("lens_id"), F.lit(k).alias("detection_id"), c.alias("confidence"), span.alias("span"), F.lit("position only").alias("rationale"))) for i, (k, rule, c, span) in enumerate(rules))
    return rows.select(F.col("id").alias("doc_id"), F.filter(F.array(*found), lambda h: h.isNotNull()).alias("hits"))


def network_hits(measured: DataFrame) -> DataFrame:
    """Hits of the graph-position lens for every node: doc_id (the node) and the columns of a hit."""
    hits = _network_rows(measured).select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.lens_id", "h.detection_id", "h.confidence", "h.span", "h.rationale", "h.hit_ord")


def network_grades(measured: DataFrame, lenses: dict[str, Lens], rounded: bool = True) -> DataFrame:
    return grade_rows(_network_rows(measured).withColumn("token_count", F.lit(0)), {LENS: lenses[LENS]}, rounded, receipts=True)
