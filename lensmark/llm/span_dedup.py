"""Substring dedup over sliding sentence spans.

A sentence ends after a word that ends in a stop (closing quotes and brackets may follow it), and at a
line break; one of over LONG words is cut at its commas, semicolons and colons too, and what is still
longer at the smallest word hashes of its windows of LONG words, so that no part has more than LONG. All
three look at a passage's own words only, up to LONG from its edges. Parts count as sentences. Every run of
RUN consecutive sentences is hashed over its words, by 128 bits; so is a run of two that has PAIR_WORDS words. A
passage loses at most LONG words at either edge, so one of 51 words keeps 21 in whole sentences, which is
always a run.

Within an Arrow batch all but a span's first occurrence are known not to be first; only that one meets the
other batches', so that a span of a third of all documents is a row a batch. A span's smallest document id is a
window's minimum, and all sentences that non-first occurrences cover go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmark.llm import hashes
from lensmark.llm.common import Scratch, free_name, numbered, pieces

#: Sentences in a run, and the fewest words of a run of two.
RUN, PAIR_WORDS = 3, 20
#: Words in a sentence's part at most.
LONG = 15
#: A run is its first sentence times _SIZES and its size.
_SIZES = 4
_STOPS = tuple(c.encode() for c in ".!?…。！？．｡؟۔।॥።։။")
_PAUSES = tuple(c.encode() for c in ",;:，、；：､،؛")
_CLOSERS = tuple(c.encode() for c in "\"')]}*_`’”»›」』）】〉》")


def _ends_in(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """The length of the mark that data[start:end] ends in, 0 where in none."""
    found = np.zeros(len(ends), np.int64)
    for size in sorted({len(m) for m in marks}):
        at = np.flatnonzero(ends - starts >= size)
        code = np.zeros(len(at), np.int64)
        for i in range(size):
            code = code * 256 + data[ends[at] - size + i]
        found[at[np.isin(code, [int.from_bytes(m, "big") for m in marks if len(m) == size])]] = size
    return found


def _bare_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words end without the quotes and brackets that close after them."""
    ends = ends.copy()
    open_ = np.arange(len(ends))
    while len(open_):
        size = _ends_in(data, starts[open_], ends[open_], _CLOSERS)
        open_ = open_[size > 0]
        ends[open_] -= size[size > 0]
    return ends


def _least_of_windows(h: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Places of the smallest, and of these the last, of each LONG neighbours of h in one piece."""
    n = len(h) - LONG + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = h[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, LONG):
        lower = h[i : i + n] <= least
        least[lower] = h[i : i + n][lower]
        at[lower] = i
    whole = piece[:n] == piece[LONG - 1 :]
    return (np.arange(n) + at)[whole]


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of many texts: where each starts, two hashes, words, and n + 1 offsets into these by text."""
    starts, ends, h, of = hashes.words(data, offsets, lower=False)
    if not len(starts):
        return starts, np.empty((2, 0), np.uint64), starts, np.zeros(len(offsets), np.int64)
    lines = np.concatenate(([0], np.cumsum((data == 0x0A) | (data == 0x0D))))
    bare = _bare_ends(data, starts[:-1], ends[:-1])
    new = np.ones(len(starts), bool)
    new[1:] = (_ends_in(data, starts[:-1], bare, _STOPS) > 0) | (lines[starts[1:]] > lines[ends[:-1]])
    new[of[:-1][np.diff(of) > 0]] = True
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    new[1:] |= np.repeat(count > LONG, count)[:-1] & (_ends_in(data, starts[:-1], bare, _PAUSES) > 0)
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    long = np.flatnonzero(np.repeat(count > LONG, count))
    new[long[_least_of_windows(h[long], (np.cumsum(new) - 1)[long])]] = True
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    place = (np.arange(len(starts)) - np.repeat(at, count)).astype(np.uint64)
    both = []
    with np.errstate(over="ignore"):
        for x in (h, hashes.spans(data, starts, ends, other=True)):
            total = np.add.reduceat(hashes.mix(x + (place + np.uint64(1)) * hashes.BASE), at)
            both.append(hashes.mix(total + count.astype(np.uint64)))
    return starts[at], np.stack(both), count, np.searchsorted(at, of)


def spans(h: np.ndarray, count: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of sentences: text, first sentence (within all), sentences, two hashes."""
    last = np.repeat(of[1:], np.diff(of))  # the end of a sentence's text
    total = np.concatenate(([0], np.cumsum(count)))
    at, size, value = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((2, 0), np.uint64)]
    for k in (RUN, 2):
        if len(count) >= k:
            first = np.arange(len(count) - k + 1)
            ok = first + k <= last[: len(first)]
            if k < RUN:
                ok &= total[k:] - total[:-k] >= PAIR_WORDS
            at.append(first[ok])
            size.append(np.full(ok.sum(), k))
            value.append(np.stack([hashes.runs(x, k)[ok] for x in h]))
    at, size, value = np.concatenate(at), np.concatenate(size), np.concatenate(value, 1)
    return np.searchsorted(of, at, "right") - 1, at, size, value


def _emitted(batches) -> Iterator[pa.RecordBatch]:
    """Runs: the document, which run, two hashes, and whether it is known not to be the first of its like; such runs
    have a place of their own instead of hashes. And a row a document: less than no run, by its number of sentences."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        parts = []
        n = np.empty(len(ids), np.int64)
        for first, end, data, offsets in pieces(batch.column(1)):
            _, h, count, of = sentences(data, offsets)
            text, at, size, value = spans(h, count, of)
            parts.append((first + text, (at - of[text]) * _SIZES + size, value))
            n[first:end] = np.diff(of)
        if not parts:
            continue
        text, run = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        value = np.concatenate([p[2] for p in parts], 1)
        order = np.lexsort((run, ids[text], value[1], value[0]))
        text, run, value = text[order], run[order], value[:, order]
        later = np.zeros(len(run), bool)
        later[1:] = (value[:, 1:] == value[:, :-1]).all(0)
        own = ids[text]
        value[0, later], value[1, later] = hashes.mix(own[later].astype(np.uint64)), run[later].astype(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((own, ids))),
                pa.array(np.concatenate((run, -1 - n))),
                pa.array(np.concatenate((value[0], hashes.mix(ids.astype(np.uint64)))).view(np.int64)),
                pa.array(np.concatenate((value[1], np.zeros(len(ids), np.uint64))).view(np.int64)),
                pa.array(np.concatenate((later, np.ones(len(ids), bool)))),
            ],
            ["id", "run", "h1", "h2", "later"],
        )


def _cleaned(batches, text_at: int, marks_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns before the marks, texts without the sentences of marked runs, and how many sentences each had and lost."""
    for batch in batches:
        marks = batch.column(marks_at).to_pylist()
        n_all = np.array([next((-1 - m for m in own if m < 0), 0) for own in marks])
        n_gone = np.zeros(len(marks), np.int64)
        texts: list[str | None] = [None] * len(marks)
        some = np.flatnonzero([any(m >= 0 for m in own) for own in marks])
        for first, end, data, offsets in pieces(batch.column(text_at).take(pa.array(some))):
            start, _, count, of = sentences(data, offsets)
            gone = np.zeros(len(count) + 1, np.int64)
            for j, row in enumerate(some[first:end]):
                runs = np.array([m for m in marks[row] if m >= 0])
                np.add.at(gone, of[j] + runs // _SIZES, 1)
                np.add.at(gone, of[j] + runs // _SIZES + runs % _SIZES, -1)
            drop = np.cumsum(gone)[:-1] > 0
            buffer = data.tobytes()
            for j, row in enumerate(some[first:end]):
                own = drop[of[j] : of[j + 1]]
                n_gone[row] = own.sum()
                lo, hi = int(offsets[j]), int(offsets[j + 1])
                edges = [*start[of[j] : of[j + 1]].tolist(), hi]
                texts[row] = b"".join([buffer[lo : edges[0]], *(buffer[edges[i] : edges[i + 1]] for i in np.flatnonzero(~own))]).decode("utf-8")
        new, old = pa.array(texts, pa.string()), batch.column(text_at).cast(pa.string())
        columns = [*batch.columns[:marks_at]]
        columns[text_at] = pc.if_else(pc.is_valid(new), new, old)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_all, pa.int32()), pa.array(n_gone, pa.int32())], names)


def drop_repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with repeated spans cut from the text, and columns n_sentences and n_removed after the others (with
    underscores appended where docs have such columns).

    Of a span's occurrences the first, by smallest id and then place, stays. A text of repeated
    sentences only becomes empty; its row stays. White space before a text's first sentence and after kept sentences
    stays as it is. Null and blank texts stay as they are, with no sentences; very long texts are cut like others. Where ids
    repeat or are null, each row is a document, in the order of ids, nulls last; which of rows of one id comes first is
    left open. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own, row = numbered(docs, id_column, scratch)
    found = own.select(F.col(row).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(_emitted, "id long, run long, h1 long, h2 long, later boolean")
    first = F.min(F.when(~F.col("later"), F.col("id"))).over(Window.partitionBy("h1", "h2"))  # a row a batch and span
    covered = found.withColumn("first", first).filter("later OR id > first")
    marks = covered.groupBy("id").agg(F.collect_list("run").alias("marks"))
    mark, added = free_name(own, "marks"), [free_name(docs, c) for c in ("n_sentences", "n_removed")]
    joined = own.join(marks, own[row].cast("long") == marks["id"]).select(*(own[c] for c in own.columns), marks["marks"].alias(mark))
    names = joined.columns
    text_at, marks_at = names.index(text_column), names.index(mark)
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in joined.dtypes[:marks_at]), *(f"`{c}` int" for c in added)])
    return joined.mapInArrow(lambda it: _cleaned(it, text_at, marks_at, [*names[:marks_at], *added]), kinds).select(*docs.columns, *added)
