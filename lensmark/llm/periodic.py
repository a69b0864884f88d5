"""Periodic runs of words: stretches that repeat a block of q words at least LEAST_EXPONENT times.

A text's words become numbers, and these are compared with themselves at every lag q up to words // LEAST_EXPONENT. Words that equal
the one q further on form stretches; one of (exponent - 1) * q matches and more is a run of period q, q words longer than its matches. Texts of up to
WIDE words are compared at many lags at once, a row of a matrix a lag. In longer ones a lag is
first compared at every t-th word, t small enough that a stretch long enough has PROBES of these in a row; lags without
such a row need no full comparison, and no run is lost. A stretch that lags of several sizes find alike has the smallest as its period: were a smaller one
its period, that lag would find the same stretch (Fine and Wilf), as all have two periods in it at least.

A text of up to LAGS lags is a row of one task and takes no shuffle. Longer ones are cut into ranges of LAGS lags, which Spark deals to all
tasks; what ranges find is joined again by text. The cost of a lag with stretches is the text's length, so a text of one word
repeated is the dearest, and is dealt like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmark.llm.common import Scratch, free_name

#: Words of the shortest run, and how often its period fits into a run at least.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Lags that a task takes of one text at once.
LAGS = 1 << 14
PROBES = 8
#: Words of the longest text that is compared at many lags at once, and how many words in all at once.
WIDE, CELLS = 1200, 1 << 14
#: What parts words.
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what bytes.split() parts."""
    return (text or "").encode().split()


def numbers(own: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    return pd.factorize(np.array(own, object))[0].astype(np.int32) if own else np.empty(0, np.int32)


def lags(n: int, exponent: int = LEAST_EXPONENT) -> int:
    """The largest lag of n words."""
    return n // exponent


def stretches(a: np.ndarray, first: int, last: int, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> dict[tuple[int, int], int]:
    """(start, length) of the stretches that lags first to last find, and the smallest lag that finds each."""
    n, found = len(a), {}
    if n <= WIDE:
        step = max(1, CELLS // (n + 1))
        for lo in range(first, last + 1, step):
            for place, q in _at_once(a, lo, min(lo + step - 1, last), length, exponent).items():
                found.setdefault(place, q)
        return found
    for q in range(first, last + 1):
        need = max(length - q, (exponent - 1) * q)
        if need > n - q:
            continue
        t = max(1, need // PROBES)
        other = np.flatnonzero(a[: n - q : t] != a[q::t])
        probes = -(-(n - q) // t)
        if t > 1 and not _gap(other, probes, need // t):
            continue
        if t > 1:
            other = np.flatnonzero(a[: n - q] != a[q:])
        edges = np.empty(len(other) + 2, np.int64)
        edges[0], edges[1:-1], edges[-1] = -1, other, n - q
        same = np.diff(edges) - 1
        for i in np.flatnonzero(same >= need):
            found.setdefault((int(edges[i]) + 1, int(same[i]) + q), q)
    return found


def _at_once(a: np.ndarray, first: int, last: int, length: int, exponent: int) -> dict[tuple[int, int], int]:
    """As stretches(), by one comparison of all lags: row i of the matrix is the text against itself from word first + i on, and ends unlike."""
    n = len(a)
    longer = np.concatenate((a, np.full(last + 1, -1, a.dtype)))
    against = np.lib.stride_tricks.as_strided(longer[first:], (last - first + 1, n + 1), (a.itemsize, a.itemsize))
    padded = longer[: n + 1]  # its last word is like none but the padding
    other = against != padded
    other[:, n] = True
    other = np.flatnonzero(other)
    same = np.diff(other, prepend=-1) - 1
    some = np.flatnonzero(same >= max(1, min(length - 1, (exponent - 1) * first)))
    found: dict[tuple[int, int], int] = {}
    q = first + other[some] // (n + 1)
    fit = same[some] >= np.maximum(length - q, (exponent - 1) * q)
    for end, m, lag in zip(other[some][fit] % (n + 1), same[some][fit], q[fit], strict=True):
        found.setdefault((int(end - m), int(m + lag)), int(lag))
    return found


def _gap(other: np.ndarray, n: int, least: int) -> bool:
    """Whether ``least`` of n places in a row are not in other (sorted)."""
    if not len(other):
        return n >= least
    return other[0] >= least or n - 1 - other[-1] >= least or bool((np.diff(other) > least).any())


def joined(parts: list[dict[tuple[int, int], int]]) -> list[tuple[int, int, int]]:
    """start, length, period of runs, from what ranges of lags of one text found; by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for part in parts:
        for place, q in part.items():
            least[place] = min(q, least.get(place, q))
    return sorted(((start, length, q) for (start, length), q in least.items()), key=lambda r: (r[0], r[2]))


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties to the smallest start, then period. runs are in that order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(own: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run has after its first period, one space between."""
    if not runs:
        return b" ".join(own).decode()
    inside = np.zeros(len(own) + 1, np.int64)
    np.add.at(inside, [s + q for s, _, q in runs], 1)
    np.add.at(inside, [s + m for s, m, _ in runs], -1)
    return b" ".join(own[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0)).decode()


def _result(names: list[str], columns: list, found: list[tuple[list[bytes], list[tuple[int, int, int]]]]) -> pa.RecordBatch:
    """A batch of the columns with each row's runs, its highest and its collapsed text."""
    runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for _, own in found], _RUNS)
    top = pa.array([None if (best := highest(own)) is None else dict(zip(("start", "length", "period"), best, strict=True)) for _, own in found], _RUNS.value_type)
    return pa.RecordBatch.from_arrays([*columns, runs, top, pa.array([collapsed(w, own) for w, own in found], pa.string())], names)


def _whole(batches, text_at: int, names: list[str], length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(text_at):
            own = words(text.as_py())
            found.append((own, joined([stretches(numbers(own), 1, lags(len(own), exponent), length, exponent)])))
        yield _result(names, batch.columns, found)


def _ranges(batches, length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    """row, text, first, last: the stretches of one range of lags."""
    for batch in batches:
        for row, text, first, last in zip(*(batch.column(i) for i in range(4)), strict=True):
            found = stretches(numbers(words(text.as_py())), first.as_py(), last.as_py(), length, exponent)
            flat = [{"start": s, "length": m, "period": q} for (s, m), q in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([flat], _RUNS)], ["row", "found"])


def _finished(batches, text_at: int, parts_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts with what all their ranges found (the column at parts_at)."""
    for batch in batches:
        found = []
        for text, parts in zip(batch.column(text_at), batch.column(parts_at), strict=True):
            found.append((words(text.as_py()), joined([{(r["start"], r["length"]): r["period"]} for r in parts.as_py() or ()])))
        yield _result(names, batch.columns[:parts_at], found)


def periodic_runs(docs: DataFrame, text_column: str = "text", length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, most_lags: int = LAGS) -> DataFrame:
    """docs with n_runs, runs (start, length and period of each in words from 0, by start, then period), highest (the run with the greatest
    exponent, null if there is none) and collapsed (the text's words, one space between, without repeats), with underscores
    appended where docs have such columns.

    A run is a stretch of ``length`` words at least and of ``exponent`` times its smallest period (2 at least), which no neighbouring word
    extends. A word goes from collapsed if any run has it after its first period. Null, empty and blank texts have no runs and an empty
    collapsed text; texts of any length are compared at all lags. Each row stands for itself: ids are not looked at, repeated rows give
    repeated results, an empty table an empty one.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    added = [free_name(docs, c) for c in ("runs", "highest", "collapsed")]
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{added[0]}` {RUNS}", f"`{added[1]}` struct<start:long,length:long,period:long>", f"`{added[2]}` string"])
    text_at = names.index(text_column)
    top = F.floor(F.regexp_count(F.col(text_column), F.lit(WORD)) / exponent)
    surely = F.octet_length(text_column) < 2 * exponent * most_lags  # two bytes a word at least: no need to count
    few = F.when(surely, F.lit(True)).otherwise(F.coalesce(top, F.lit(0)) <= most_lags)
    short = docs.filter(few).mapInArrow(lambda it: _whole(it, text_at, [*names, *added], length, exponent), kinds)

    row, parts, lag = free_name(docs, "row"), free_name(docs, "parts"), free_name(docs, "lag")
    long = scratch.save(docs.filter(~few).withColumn(lag, top.cast("long")).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    ranges = long.select(F.col(row).alias("row"), F.col(text_column).alias("text"), F.col(lag).alias("lag"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(lag), F.lit(most_lags).cast("long"))).alias("first"))
    ranges = ranges.select("row", "text", "first", F.least(F.col("first") + most_lags - 1, "lag").alias("last")).repartition("row", "first")
    found = ranges.mapInArrow(lambda it: _ranges(it, length, exponent), f"row long, found {RUNS}").groupBy("row").agg(F.flatten(F.collect_list("found")).alias(parts))
    whole = long.join(found, long[row] == found["row"]).select(*(long[c] for c in names), parts)
    long = whole.mapInArrow(lambda it: _finished(it, text_at, len(names), [*names, *added]), kinds)
    return short.union(long).withColumn(free_name(docs, "n_runs"), F.size(added[0]).cast("long"))

