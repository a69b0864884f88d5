"""Approximate nearest neighbours by collision counting.

Vectors are dealt once to blocks of bounded size; queries are sent to every block and stream past its index,
which is built once. The index keeps each of PROJECTIONS random directions' projections of the block sorted. A query's windows are
centred on its own projections; virtual rehashing widens them: at radius r they are W * r wide. Pointers keep where they began and ended,
so that only vectors that enter at their ends are counted, each once a direction. A vector whose ranks lie in the windows of a share ALPHA of the directions collides often enough and is
verified by its distance. A query is done with a block once k verified vectors lie within the radius, or all are
verified. The blocks' answers are merged.

A vector within the radius collides in a direction with probability 0.68 at least, so it is verified with probability
0.92 at least, one at nine tenths of the radius with 0.98, independent of how the vectors are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, W, ALPHA, GROWTH = 64, 2.0, 0.6, 1.15
#: Vectors of a block (ranks are 16 bits wide), queries that are looked up together, vectors whose neighbours set the first radius.
BLOCK, TOGETHER, PROBES = 16_384, 128, 16


class SortedProjections:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        n, d = vectors.shape
        self.norms = (vectors**2).sum(1)
        self.directions = np.random.default_rng(97).standard_normal((d, PROJECTIONS))
        p = (vectors @ self.directions).T
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        self.order = order.astype(np.uint16)
        probes = vectors[:: max(1, n // PROBES)][:PROBES]
        near = np.sort(((probes[:, None] - vectors[None]) ** 2).sum(2) if n * d < 1 << 16 else self.norms + self.norms[:: max(1, n // PROBES)][:PROBES, None] - 2 * probes @ vectors.T, 1)
        least = near[:, min(k, n - 1)]
        self.start = max(float(np.sqrt(max(least.min(), 0.0))) / GROWTH, float(p.std()) / 16, 1e-9)

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query positions and exact distances of the nearest k verified vectors, those of the query's own id aside."""
        n, k = len(self.ids), self.k
        at = queries @ self.directions
        least, radius = int(np.ceil(ALPHA * PROJECTIONS)), self.start
        open_ = list(range(len(queries)))
        seen = [self.ids == q for q in query_ids]
        found: list[list[np.ndarray]] = [[] for _ in open_]
        squares: list[list[np.ndarray]] = [[] for _ in open_]
        # Where each query's windows began and ended so far, and how often each vector was in them: both start at the query's own place, with nothing in them.
        begin = np.stack([np.searchsorted(self.sorted[i], at[:, i]) for i in range(PROJECTIONS)], 1)
        end = begin.copy()
        hits = np.zeros((len(queries), n), np.uint8)
        while open_:
            half = W * radius / 2
            low, high = np.empty((2, len(open_), PROJECTIONS), np.int64)
            for i in range(PROJECTIONS):
                low[:, i] = np.searchsorted(self.sorted[i], at[open_, i] - half, "left")
                high[:, i] = np.searchsorted(self.sorted[i], at[open_, i] + half, "right")
            again = []
            for j, q in enumerate(open_):
                a, b = np.minimum(low[j], begin[q]), np.maximum(high[j], end[q])
                entered = [own[x:y] for own, x, y in zip(self.order, a.tolist(), begin[q].tolist(), strict=True)] + [own[x:y] for own, x, y in zip(self.order, end[q].tolist(), b.tolist(), strict=True)]
                begin[q], end[q] = a, b
                hits[q] += np.bincount(np.concatenate(entered), minlength=n).astype(np.uint8)
                new = np.flatnonzero((hits[q] >= least) & ~seen[q])
                seen[q][new] = True
                found[q].append(new)
                squares[q].append(self.norms[new] + queries[q] @ queries[q] - 2 * self.vectors[new] @ queries[q])
                if sum((x <= radius * radius).sum() for x in squares[q]) < k and (b - a).min() < n:
                    again.append(q)
            open_, radius = again, radius * GROWTH
        for q, near in enumerate(found):
            near, square = np.concatenate(near), np.concatenate(squares[q])
            # The identity above is exact to some 1e-15 of the norms only: what could be among the nearest is measured anew.
            if len(near) > k:
                near = near[square <= np.partition(square, k - 1)[k - 1] + 1e-9 * (self.norms.max() + queries[q] @ queries[q])]
            distance = np.sqrt(((self.vectors[near] - queries[q]) ** 2).sum(1))
            best = np.lexsort((self.ids[near], distance))[:k]
            yield near[best], distance[best]


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _answered(batches, k: int) -> Iterator[pa.RecordBatch]:
    """batches: dimension, block, asks, id, v, a block's vectors before its queries. The nearest k of each query in each block."""
    block, parts, index = None, [], None
    for batch in batches:
        key = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("dimension", "block", "asks")], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if block != tuple(key[a, :2]):
                block, parts, index = tuple(key[a, :2]), [], None
            ids, v = batch.column("id").slice(a, b - a).to_numpy(), _rows(batch.column("v").slice(a, b - a))
            if not key[a, 2]:
                parts.append((ids, v))
                continue
            if index is None and parts:
                index, parts = SortedProjections(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k), []
            for i in range(0, b - a, TOGETHER) if index else ():
                found = list(index.nearest(v[i : i + TOGETHER], ids[i : i + TOGETHER]))
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[i : i + TOGETHER], sizes)), pa.array(index.ids[np.concatenate([f[0] for f in found])]), pa.array(np.concatenate([f[1] for f in found]))],
                    ["query_id", "vec_id", "score"],
                )


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every`` its k nearest others: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows of a null id; vectors of different dimension do not meet. Of
    rows that repeat an id each is a candidate, and one (of the least hash of its vector) is the query. With fewer than k
    candidates all are returned; an empty table gives an empty result. Other columns are ignored; a very long vector is one like others.
    """
    x = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(x, lambda c: c != 0))
    rows = rows.withColumn("dimension", F.size("v"))
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumns({"block": F.pmod(F.monotonically_increasing_id(), F.lit(blocks)), "asks": F.lit(False)})  # in turn, so that rows of one id part
    asked = rows.filter(F.col("id") % every == 0).groupBy("id", "dimension").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    sent = asked.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "asks": F.lit(True)})
    both = dealt.unionByName(sent).repartition(blocks, "dimension", "block").sortWithinPartitions("dimension", "block", "asks")
    met = both.select("dimension", "block", "asks", "id", "v").mapInArrow(lambda it: _answered(it, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # k rows a block at most
    return met.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
