"""Interpolated modified Kneser-Ney n-grams, counted in Spark and read from memory-mapped sorted hash arrays.

1. Word counts: tasks count words' hashes, and shards of the hash range write the vocabulary: sorted hashes and counts. A word's number is its place.
2. n-grams of the top order, as words' numbers, are counted within tasks and dealt by their hash to shards. A shard writes its sorted hashes and counts, and
   sends on what other shards need of it: partial sums of contexts (how often, how many followers of one, two and more occurrences) and, for the
   order below, how many words its n-grams' tails follow. So each order takes one shuffle, until words are reached. A frequent pair is a row a task; a frequent context is dealt
   like others, as only its partial sums meet.
3. Scoring needs no shuffle: each task maps the shards' files into memory, looks sorted hashes of a batch up, and interpolates from words upwards.

The files lie in the folder of ``spark.checkpoint.dir``, which must be mounted: a plain path or file: URL on all machines. They are written under a temporary name and
renamed, so that a repeated task replaces a file by its equal. Nothing is pruned: all n-grams of all training texts are kept.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.llm import hashes
from lensmark.llm.common import free_name, modest_batches, pieces
from lensmark.sources.scratch import shared_dir

#: Tokens that a shard of n-grams stands for, and bytes of text that a token is taken to have in choosing the number of shards.
SHARD, BYTES = 1 << 21, 6
#: Tokens that a task counts at once before it sends their distinct n-grams on.
AT_ONCE = 1 << 21
ORDER = 2
END = np.uint64(0x1D8E4E27C47D124F)
#: Numbers that no word has: what precedes a text, and a word that training texts lack.
BEGIN, UNKNOWN = np.uint32(0xFFFFFFFE), np.uint32(0xFFFFFFFF)
GRAM, CONTEXT, STATS = 0, 1, 2
_STATS = np.dtype([("v", "<u8", 5)])
_ROWS = "shard int, what int, data binary"


def _gram(level: int) -> np.dtype:
    return np.dtype([("ids", ">u4", level), ("c", "<u8")])


def _context(level: int) -> np.dtype:
    """Of a level's contexts: their numbers, how often they have a follower, and how many followers they have once, twice and more."""
    return np.dtype([("ids", ">u4", level - 1), ("v", "<u8", 4)])


def keys_of(ids: np.ndarray) -> np.ndarray:
    """Hashes of rows of words' numbers."""
    h = np.full(len(ids), ids.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ids.shape[1]):
            h = hashes.mix(h * hashes.BASE + ids[:, j].astype(np.uint64))
    return h


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's lower-cased words and an end, and n + 1 offsets by text."""
    _, _, h, of = hashes.words(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(h) + n, END)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(of))] = h
    return out, of + np.arange(n + 1)


def grams_of(ids: np.ndarray, of: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token with the level - 1 before it, as rows of numbers with BEGIN before a text; and each token's place in its text."""
    i = np.arange(len(ids))
    place = i - np.repeat(of[:-1], np.diff(of))
    out = np.empty((len(ids), level), np.uint32)
    for j in range(level):
        back = level - 1 - j
        out[:, j] = np.where(place >= back, ids[np.maximum(i - back, 0)], BEGIN)
    return out, place


@dataclass
class Files:
    """Sorted hash arrays in shards, mapped where they are first needed."""

    folder: str
    bits: int
    open: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "bits": self.bits, "open": {}}

    def write(self, name: str, shard: int, keys: np.ndarray, values: np.ndarray) -> None:
        for what, array in (("keys", keys), ("values", values)):
            path = f"{self.folder}/{name}-{shard:06d}-{what}.npy"
            draft = f"{path}.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                np.save(f, array)
            os.replace(draft, path)

    def shard(self, name: str, shard: int) -> tuple[np.ndarray, np.ndarray] | None:
        if (name, shard) not in self.open:
            path = f"{self.folder}/{name}-{shard:06d}-"
            self.open[name, shard] = tuple(np.load(f"{path}{what}.npy", mmap_mode="r") for what in ("keys", "values")) if os.path.exists(f"{path}keys.npy") else None
        return self.open[name, shard]

    def find(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys (zeros where there are none) in one column a value, and a place that is unique to a key and shard (-1 where there is none)."""
        sought, back = np.unique(keys, return_inverse=True)
        cuts = np.searchsorted(shard_of(sought, self.bits), np.arange((1 << self.bits) + 1))
        values, places = None, np.full(len(sought), -1, np.int64)
        for s in np.flatnonzero(np.diff(cuts)):
            if (have := self.shard(name, int(s))) is None:
                continue
            own = slice(cuts[s], cuts[s + 1])
            at = np.minimum(np.searchsorted(have[0], sought[own]), len(have[0]) - 1)
            found = have[0][at] == sought[own]
            if values is None:
                values = np.zeros((len(sought), have[1].shape[1]), np.int64)
            values[own] = np.where(found[:, None], have[1][at], 0)
            places[own] = np.where(found, (at.astype(np.int64) << self.bits) | s, -1)
        return (np.zeros((len(keys), 4), np.int64) if values is None else values[back]), places[back]

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words' counts and numbers."""
        values, places = self.find("words", h)
        return values[:, 0], np.where(places < 0, np.int64(UNKNOWN), places).astype(np.uint32)


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _rows(what: int, shard: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Fixed-size records as rows."""
    size = data.dtype.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    binary = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(data), what, np.int32)), binary], ["shard", "what", "data"])


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, where each is first, and the sums of values by key in columns."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.empty(0, np.int64)
    sums = [np.add.reduceat(v[order], new) if len(new) else np.empty(0, np.int64) for v in values]
    return ranked[new], order[new], np.stack(sums, 1).astype(np.int64) if values else np.empty((len(new), 0), np.int64)


def _gathered(batches, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and their offsets by text, about ``at_once`` together."""
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            held.append(tokens(data, offsets))
            size += len(held[-1][0])
            if size >= at_once:
                yield _together(held)
                held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(h) for h, _ in held)])
    return np.concatenate([h for h, _ in held]), np.concatenate([[0], *(of[1:] + s for (_, of), s in zip(held, starts, strict=False))]).astype(np.int64)


def _word_counts(batches, bits: int, at_once: int) -> Iterator[pa.RecordBatch]:
    for h, _ in _gathered(batches, at_once):
        keys, c = np.unique(h, return_counts=True)
        data = np.empty(len(keys), np.dtype([("key", "<u8"), ("c", "<u8")]))
        data["key"], data["c"] = keys, c
        yield _rows(GRAM, shard_of(keys, bits), data)


def _by_shard(batches) -> Iterator[tuple[int, int, bytes]]:
    """shard, what and all data of each, from rows sorted by both."""
    key, held = None, []
    for batch in batches:
        shard, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(shard):
            continue
        data = batch.column(2).cast(pa.large_binary())
        _, offsets, buffer = data.buffers()
        offsets = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (what[1:] != what[:-1])) + 1), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = (int(shard[lo]), int(what[lo]))
            if own != key:
                if key is not None:
                    yield *key, b"".join(held)
                key, held = own, []
            held.append(memoryview(buffer)[offsets[lo] : offsets[hi]].tobytes() if buffer is not None else b"")
    if key is not None:
        yield *key, b"".join(held)


def _write_words(batches, files: Files) -> Iterator[pa.RecordBatch]:
    for shard, _, data in _by_shard(batches):
        rows = np.frombuffer(data, np.dtype([("key", "<u8"), ("c", "<u8")]))
        keys, _, c = _sums(rows["key"], rows["c"])
        files.write("words", shard, keys, _small(c))
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["types", "tokens"])


def _sent(what: int, kind: np.dtype, keys: np.ndarray, ids: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Records by shard and numbers: neighbours begin alike, which a shuffle's compression makes use of."""
    shard = shard_of(keys, bits)
    order = np.lexsort((*ids.T[::-1], shard))
    data = np.empty(len(keys), kind)
    data[kind.names[0]], data[kind.names[1]] = ids[order], values[order]
    return _rows(what, shard[order], data)


def _distinct(level: int, ids: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    keys, first, c = _sums(keys_of(ids), counts)
    return _sent(level * 4 + GRAM, _gram(level), keys, ids[first], c[:, 0], bits)


def _gram_counts(batches, files: Files, order: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """n-grams of the top order; a text's first ones, which have less before them, of their own order."""
    for h, of in _gathered(batches, at_once):
        ids, place = grams_of(files.numbers(h)[1], of, order)
        for level in range(min(2, order), order + 1):
            own = ids[place == level - 2] if level < order else ids[place >= order - 2]
            if len(own):
                yield _distinct(level, own[:, order - level :], np.ones(len(own), np.int64), files.bits)


def _write_level(batches, files: Files, level: int) -> Iterator[pa.RecordBatch]:
    """Writes a level's n-grams and the contexts of the one above, and sends on contexts and tails of its n-grams, sums, and what lower levels wait for."""
    for shard, what, data in _by_shard(batches):
        of, kind = divmod(what, 4)
        if kind == STATS:
            rows = np.frombuffer(data, _STATS)
            total = np.zeros(1, _STATS)
            total["v"] = rows["v"].sum(0)
            yield _rows(what, np.zeros(1, np.int32), total)
        elif kind == CONTEXT:
            rows = np.frombuffer(data, _context(of))
            keys, _, v = _sums(keys_of(rows["ids"].astype(np.uint32).reshape(len(rows), of - 1)), *rows["v"].T)
            files.write(f"contexts{of}", shard, keys, _small(v))
        elif of < level:
            rows = np.frombuffer(data, _gram(of))
            yield _rows(what, np.full(len(rows), shard, np.int32), rows)
        else:
            rows = np.frombuffer(data, _gram(level))
            ids = rows["ids"].astype(np.uint32).reshape(len(rows), level)
            keys, first, c = _sums(keys_of(ids), rows["c"])
            ids, c = ids[first], c[:, 0]
            files.write(f"grams{level}", shard, keys, _small(c[:, None]))
            stats = np.zeros(1, _STATS)
            stats["v"] = [*((c == i).sum() for i in (1, 2, 3, 4)), c.sum()]
            yield _rows(level * 4 + STATS, np.zeros(1, np.int32), stats)
            if level > 1:
                own, first, v = _sums(keys_of(ids[:, :-1]), c, c == 1, c == 2, c > 2)
                yield _sent(level * 4 + CONTEXT, _context(level), own, ids[first, :-1], v, files.bits)
                yield _distinct(level - 1, ids[:, 1:], np.ones(len(ids), np.int64), files.bits)


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off n-grams of one, two and more occurrences, from how many have one to four; half of one to three where some number is missing."""
    if min(n) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) for i in (1, 2, 3))])


@dataclass
class Model:
    files: Files
    order: int
    tokens: int
    types: int
    discounts: dict[int, np.ndarray]
    #: How many occurrences there are of words as continuations, and of how many words of one, two and more.
    words: tuple[int, int, int, int]

    def log10(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's training count and log10 probability."""
        count, numbers = self.files.numbers(h)
        ids, place = grams_of(numbers, of, self.order)
        total, *n = self.words
        d = self.discounts[1]
        p = np.full(len(h), 1.0 / (self.types + 1))
        if total:
            a = self.files.find("grams1", keys_of(ids[:, -1:]))[0][:, 0]
            p = np.maximum(a - d[np.minimum(a, 3)], 0) / total + (d[1:] * n).sum() / total * p
        for level in range(2, self.order + 1):
            d = self.discounts[level]
            context = self.files.find(f"contexts{level}", keys_of(ids[:, self.order - level : -1]))[0]
            a = self.files.find(f"grams{level}", keys_of(ids[:, self.order - level :]))[0][:, 0]
            seen = (context[:, 0] > 0) & (place >= level - 2)
            all_ = np.where(seen, context[:, 0], 1)
            p = np.where(seen, np.maximum(a - d[np.minimum(a, 3)], 0) / all_ + context[:, 1:] @ d[1:] / all_ * p, p)
        return count, np.log10(p)


def _mounted(spark: SparkSession) -> str:
    where = shared_dir(spark)
    if where.startswith("file:"):
        where = "/" + where.removeprefix("file:").lstrip("/")
    if not where.startswith("/"):
        raise ValueError(f"memory-mapped files need a mounted folder in spark.checkpoint.dir, not {where}")
    folder = f"{where}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def train(texts: DataFrame, order: int = ORDER, shard: int = SHARD, at_once: int = AT_ONCE) -> Model:
    """A model of all texts (one string column; null counts as empty)."""
    if order < 1:
        raise ValueError("the order is one at least")
    spark = texts.sparkSession
    modest_batches(spark)
    texts = texts.toDF("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    bits = max(0, int(size / BYTES / shard - 1e-9)).bit_length()
    files = Files(_mounted(spark), bits)
    dealt = lambda df: df.repartitionById(1 << bits, "shard").sortWithinPartitions("shard", "what")
    counted = dealt(texts.mapInArrow(lambda it: _word_counts(it, bits, at_once), _ROWS)).mapInArrow(lambda it: _write_words(it, files), "types long, tokens long")
    types, n = counted.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    rows = texts.mapInArrow(lambda it: _gram_counts(it, files, order, at_once), _ROWS)
    for level in range(order, 0, -1):
        rows = dealt(rows).mapInArrow(lambda it, level=level: _write_level(it, files, level), _ROWS)
    stats = {level: np.zeros(5, np.int64) for level in range(1, order + 1)}
    for what, data in rows.select("what", "data").collect():  # sums: a row a level, and one a shard of the last
        stats[what // 4] += np.frombuffer(bytes(data), _STATS)["v"][0].astype(np.int64)
    n1, n2, _, _, total = (int(x) for x in stats[1])
    return Model(files, order, int(n), int(types), {k: discounts([int(x) for x in v[:4]]) for k, v in stats.items()}, (total, n1, n2, int(types) - n1 - n2 if total else 0))


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with n_tokens, n_known (tokens that training texts have), base_score (log10 probability by word counts, each raised by one) and score (by the model), with underscores
    appended where docs have such columns. A null or blank text is an end alone; texts of any length are scored whole; rows that repeat score alike."""
    names, at = docs.columns, docs.columns.index(text_column)
    added = [free_name(docs, c) for c in ("n_tokens", "n_known", "base_score", "score")]
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"`{c}` {t}" for c, t in zip(added, ("long", "long", "double", "double"), strict=True))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.empty((4, 0))]
            for _, _, data, offsets in pieces(batch.column(at)):
                h, of = tokens(data, offsets)
                count, p = model.log10(h, of)
                base = np.log10((count + 1) / (model.tokens + model.types + 1))
                parts.append(np.stack([np.diff(of), *(np.add.reduceat(x, of[:-1]) for x in (count > 0, base, p))]))
            n, known, base, p = np.concatenate(parts, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(p)], [*names, *added])

    return docs.mapInArrow(run, kinds)


def perplexity(scored: DataFrame, held_out: Column) -> DataFrame:
    """Perplexity a token of the model and of word counts over the rows where held_out holds, and how many tokens they have."""
    own = scored.filter(held_out).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    return own.select("n_tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("b") / F.col("n_tokens")).alias("base_perplexity"))
