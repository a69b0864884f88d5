"""Connected components: local contraction, then alternating large-star and small-star steps.

Edges stay distributed. Each task first contracts its share of EDGES_PER_TASK edges at most to a
forest of stars; that is the whole answer if one task holds all. Otherwise steps of DataFrame operations join the stars; each
aggregates a node's smallest neighbour before it joins, so a node with a third of all edges costs
one partial minimum per task and a join that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmark.llm.common import Scratch

EDGES_PER_TASK = 300_000


def _contracted(batches) -> Iterator[pa.RecordBatch]:
    """Each node that is not its root's own, and the root, the smallest node of its tree."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while (b := root[a]) != a:
            root[a] = a = root[b]
        return a

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, r) for x in root if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: u, v (long), from a written table. Returns node, component (the smallest node reachable), only for nodes other than it."""
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
    share = edges.select("u", "v").coalesce(1) if tasks == 1 else edges.select("u", "v").repartition(tasks)
    now = scratch.save(share.mapInArrow(_contracted, "u long, v long"), "edges")
    seen = None
    while tasks > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        seen, before = mark, now
        now = scratch.save(_small_star(_large_star(before)), "edges")
        scratch.drop(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
