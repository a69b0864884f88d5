"""Best-fit packing by linear grouping.

Lengths are integers of at most ``capacity``, so a histogram describes the corpus to the packer: the
plan is made on the driver from at most ``capacity`` counts, however many documents there are.

1. Large lengths, longest first, are cut into groups of equal cardinality and rounded up to a
   group's longest.
2. Configurations of these few sizes are optimised: the cutting-stock linear programme is solved by
   column generation and rounded down.
3. Actual lengths take the slots, in runs of equal lengths: the longest that fits a slot and the room
   that rounding has left in the sequence so far; the last two slots take the pair that fills it best.
4. What is left, small ones mostly, goes longest first to the fullest sequences that still fit.
5. Where that takes more sequences than the sum of lengths allows, those that are not full are taken apart and grouped anew, as
   a smaller problem whose groups are finer.

The plan says, for ranges of ranks within a length, which sequences they fill and at which offset.
Tasks number their pieces of a length from the task's own place among all tasks, and look that up.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmark.llm import bpe
from lensmark.llm.common import Scratch, pieces

GROUPS, ROUNDS = 80, 600
#: How often what is not full is grouped anew, and the rounds of column generation then.
REPAIRS, REPAIR_ROUNDS = 4, 150
#: Lengths over capacity // SMALL are large.
SMALL = 8


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often each is used, from the cutting-stock linear programme rounded down."""
    k = len(sizes)
    if not k:
        return []
    patterns = np.diag(capacity // sizes).astype(float)
    every = np.arange(capacity + 1)
    for _ in range(rounds):
        inverse = np.linalg.inv(patterns)
        use = inverse @ demand
        worth = inverse.sum(0)  # dual prices: every pattern costs one sequence
        # The most worth in each room, a slot at a time, and which size the slot takes (-1: none).
        value, slots = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):
            options = np.full((k, capacity + 1), -np.inf)
            for i, s in enumerate(sizes):
                options[i, s:] = value[: capacity + 1 - s] + worth[i]
            taken = options.argmax(0)
            best = options[taken, every]
            slots.append(np.where(best > value, taken, -1))
            value = np.maximum(best, value)
        if value[capacity] <= 1 + 1e-6:
            break
        new, room = np.zeros(k), capacity
        for taken in reversed(slots):
            if taken[room] >= 0:
                new[taken[room]] += 1
                room -= sizes[taken[room]]
        direction = inverse @ new
        ratio = np.full(k, np.inf)
        np.divide(use, direction, out=ratio, where=direction > 1e-9)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        patterns[:, out] = new
    use = np.linalg.inv(patterns) @ demand
    return [(patterns[:, j].astype(int), int(use[j] + 1e-9)) for j in range(k) if use[j] >= 1]


def substitutes(slots: list[int], capacity: int, rising: list[int], left: dict[int, int]) -> list[int]:
    """Actual lengths for a configuration's slots (sizes, longest first): each takes the longest that fits it and the
    room that earlier ones left; the last two take the pair that fills this room best, of such pairs one with a long first."""
    heads: list[int] = []
    room = capacity - sum(slots)
    known = np.array(rising)

    def take(n: int) -> bool:
        free = left[n] > heads.count(n)
        if free:
            heads.append(n)
        return free

    for i, size in enumerate(slots):
        room += size
        end = bisect.bisect_right(rising, room)
        if i == len(slots) - 2 and end:
            first = known[:end][::-1]
            second = np.searchsorted(known, room + slots[-1] - first, "right") - 1
            first, second = first[second >= 0], second[second >= 0]
            gap = room + slots[-1] - first - known[second]
            for j in np.argsort(gap, kind="stable")[:8]:
                if take(int(first[j])):
                    if take(int(known[second[j]])):
                        return heads
                    heads.pop()
        while end and not take(rising[end - 1]):
            end -= 1
        if end:
            room -= rising[end - 1]
    return heads


#: What a run of equal sequences holds, as (length, how often), and how many such sequences there are.
Run = tuple[tuple[tuple[int, int], ...], int]
Plan = tuple[list[tuple[int, int, int, int, int, int]], int]


def room_of(run: Run, capacity: int) -> int:
    return capacity - sum(n * m for n, m in run[0])


def _with(held: tuple[tuple[int, int], ...], n: int, m: int) -> tuple[tuple[int, int], ...]:
    return (*held, (n, m))


def grouped(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[Run]:
    """Linear grouping, configurations, substitution, and best fit of what is left."""
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    free: list[list[Run]] = [[] for _ in range(capacity + 1)]  # by free room
    if histogram.get(capacity):
        free[0].append((((capacity, 1),), histogram[capacity]))

    large = sorted((n for n in left if n > capacity // SMALL), reverse=True)
    total = sum(left[n] for n in large)
    groups: list[list[int]] = []
    seen = 0
    for n in large:  # a length stays whole, so groups are of equal cardinality up to one length
        if not groups or seen * GROUPS >= total * len(groups):
            groups.append([])
        groups[-1].append(n)
        seen += left[n]
    sizes = np.array([g[0] for g in groups], int)
    demand = np.array([sum(left[n] for n in g) for g in groups], float)
    rising = sorted(large)
    for pattern, times in configurations(sizes, demand, capacity, rounds):
        slots = np.repeat(sizes, pattern).tolist()
        done = 0
        while done < times and (heads := substitutes(slots, capacity, rising, left)):
            run = min([times - done, *(left[n] // heads.count(n) for n in heads)])
            for n in heads:
                left[n] -= run
            rising = [n for n in rising if left[n]]
            free[capacity - sum(heads)].append((tuple((n, heads.count(n)) for n in dict.fromkeys(heads)), run))
            done += run

    for n in sorted((n for n in left if left[n]), reverse=True):
        room = n
        while left[n]:
            while room <= capacity and not free[room]:
                room += 1
            each = (room if room <= capacity else capacity) // n
            if room <= capacity:
                held, count = free[room].pop()
            else:
                held, count, room = (), -(-left[n] // each), capacity
            used = min(count, left[n] // each)
            if used:
                left[n] -= used * each
                free[room - each * n].append((_with(held, n, each), used))
            if used < count and 0 < left[n] < each:
                free[room - left[n] * n].append((_with(held, n, left[n]), 1))
                left[n] = 0
                used += 1
            if used < count:
                free[room].append((held, count - used))
    return [run for rooms in free for run in rooms if run[0]]


def repaired(runs: list[Run], capacity: int) -> list[Run]:
    """The runs, or a packing of fewer sequences: those with room are taken apart, with as many full ones of the shortest runs, and
    grouped anew as a smaller problem of its own, with finer groups; REPAIRS times at most, and no more once the sum of lengths allows no fewer."""
    least = -(-sum((capacity - room_of(r, capacity)) * r[1] for r in runs) // capacity)
    for attempt in range(REPAIRS):
        if sum(r[1] for r in runs) <= least:
            break
        apart = [r for r in runs if room_of(r, capacity)]
        full = sorted((r for r in runs if not room_of(r, capacity)), key=lambda r: r[1])
        most, with_these = sum(r[1] for r in apart) * attempt, 0
        while full and with_these + full[0][1] <= most:
            with_these += full[0][1]
            apart.append(full.pop(0))
        histogram: dict[int, int] = defaultdict(int)
        for held, count in apart:
            for n, m in held:
                histogram[n] += m * count
        again = grouped(histogram, capacity, REPAIR_ROUNDS)
        if sum(r[1] for r in again) < sum(r[1] for r in apart):
            runs = full + again
    return runs


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Rows (length, first rank, end rank, first sequence, pieces of it a sequence, offset), and the number of sequences."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    taken: dict[int, int] = defaultdict(int)
    sequences = 0
    for held, count in repaired(grouped(histogram, capacity), capacity):
        offset = 0
        for n, m in held:
            rows.append((n, taken[n], taken[n] + m * count, sequences, m, offset))
            taken[n] += m * count
            offset += m * n
        sequences += count
    return rows, sequences


@functools.lru_cache(1)
def _merged(path: str) -> bpe.Merged:
    """Packed ids of pre-tokens, kept for all tasks of a worker: tables and cache are not made anew for each.

    Ids need no method of their own here: the library's merges make those of a pre-token that the cache lacks."""
    encode = tiktoken.Encoding("own", pat_str=".+|\\s+", mergeable_ranks=bpe.tokenizers_ranks(path), special_tokens={})._encode_single_piece
    return bpe.Merged(lambda piece: array("I", encode(piece)).tobytes(), 300_000)


def _cut(batches, path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each text, with a number among the task's own pieces of the length."""
    merged = _merged(path)
    added = bpe.AddedTokens(path)
    end_bytes = np.array([end_id], "<u4").tobytes()
    part = TaskContext.get().partitionId()
    seen = [0] * (capacity + 1)
    for batch in batches:
        ids = batch.column(0)
        for first, _, data, offsets in pieces(batch.column(1)):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, parts in enumerate(added.merged_texts(data, offsets, merged)):
                parts.append(end_bytes)
                whole = b"".join(parts)
                n = len(whole) // 4
                at, size, j = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    row.append(first + i)
                    piece.append(j)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(whole[4 * at : 4 * (at + size)]))
                    rank.append(seen[size])
                    seen[size] += 1
                    at, size, j = at + size, capacity, j + 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "part", "own_rank"],
            )


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    path: a byte-level BPE in the tokenizers library's JSON that executors can read; its added tokens are one id each, as
    the library has them. A document is its text's ids and end_id; only longer ones than ``capacity`` are cut, the first piece
    being the odd one: a very long text gives as many pieces as it needs. A null text counts as empty: one piece, end_id alone.
    Null and repeated ids pass through, one document a row. Pieces of equal length are alike to the packer: which of them
    takes which place follows from the order of rows. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, own_rank long"
    cut = scratch.save(rows.mapInArrow(lambda it: _cut(it, path, capacity, end_id), schema), "pieces")

    counts = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    steps, _ = plan(histogram, capacity)
    # The plan's size depends on capacity, not on the corpus: broadcast as three small arrays inside the task.
    steps.sort()
    table = np.array(steps, np.int64).reshape(-1, 6)
    plan_b = spark.sparkContext.broadcast(table)

    def place(batches) -> Iterator[pa.RecordBatch]:
        n, low, _, first, each, base = plan_b.value.T
        keys = (n << 44) + low
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            k = rank - low[i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(first[i] + k // each[i]), pa.array(base[i] + k % each[i] * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(places, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own_rank")).alias("rank"))
    out = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
