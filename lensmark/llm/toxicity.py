"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index.

Terms are the lower-cased words of a bounded sample of labelled rows, all of them. A term weighs in a text by its count, its
rarity over all documents and how unevenly the sample's classes use it. The sample's vectors make the index: rare
terms' postings, common terms' weights by blocks of BLOCK examples, and their largest weight in each block. A query adds up its
rare terms' postings and the blocks' bounds, scores the most promising blocks exactly, and stops where no other block can
reach the k-th similarity.
Neighbours vote with their similarity; an isotonic fit to the sample's own leave-one-out votes
calibrates the score. The neighbours are the evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensmark.llm import hashes
from lensmark.llm.common import free_name, in_fold, pieces

#: Bounds of what is fitted: labelled rows of each class, distinct terms of each class's rows added up (rows are taken in the order
#: of their ids' hashes until they are reached), and examples in the leave-one-out fit.
MOST_TOXIC, MOST_CLEAN, MOST_IN_ALL, MOST_FITTED = 2500, 5000, 750_000, 3000
#: A row of over this part of MOST_IN_ALL is passed over: it would leave no place for the rest.
LARGEST = 10
BLOCK, GROUP, NEIGHBOURS = 128, 8, 15
#: Terms in more than one of so many examples are common.
COMMON = 32
#: What a term weighs that both classes use alike. What the two-sided z of the difference of its rates has over CHANCE is added; RARE
#: more examples of both classes' kind are taken to use the term, so that few uses say little.
LEAST_WEIGHT, CHANCE, RARE = 0.1, 1.0, 4
#: A vote's prior counts as a neighbour of this similarity.
FAINT = 1.0

#: ASCII letters and digits in lower case, what is not ASCII as it is, all else as a space.
_WORD = np.array([b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text, as hashes: text, term, count; by text, then term."""
    data = _WORD[data]
    quotes = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))  # U+2000 to U+203F: dashes, quotes, dots, spaces
    for i in range(3):
        data[quotes + i] = 0x20
    _, _, h, of = hashes.words(data, offsets, lower=False)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers each, one after the other."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Unit vectors of examples. Rare terms have postings; the common ones have a row of weights, zeros included, in each block of
    BLOCK examples, and their largest weight there."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, weights: np.ndarray, ids: np.ndarray, n_terms: int):
        """owner, term, weight: postings; labels, weights, ids: of the examples."""
        n = len(labels)
        leading = np.full(n, -1)
        order = np.lexsort((term, weight, owner))
        leading[owner[order]] = term[order]  # the term of the largest weight: like examples come to one block
        place = np.lexsort((np.arange(n), leading, labels))
        self.position = np.empty(n, np.int64)
        self.position[place] = np.arange(n)
        self.labels, self.weights, self.ids = labels[place], weights[place], ids[place]
        self.blocks, self.prior = -(-n // BLOCK), 0.0
        owner, weight = self.position[owner], weight.astype(np.float32)

        common = np.flatnonzero(np.bincount(term, minlength=n_terms) * COMMON > n)
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        own = self.row[term] >= 0
        self.dense[owner[own] // BLOCK, self.row[term[own]], owner[own] % BLOCK] = weight[own]
        self.largest = self.dense.max(2).T.copy()

        owner, term, weight = owner[~own], term[~own], weight[~own]
        order = np.lexsort((owner, term))
        self.example, self.weight = owner[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, t: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the k nearest with a similarity over 0; ties to the smaller position."""
        at, score = np.empty(0, np.int64), np.empty(0)
        rare = t[self.row[t] < 0]
        size = self.at[rare + 1] - self.at[rare]
        p = _ranges(self.at[rare], size)
        sums = np.bincount(self.example[p], np.repeat(w[self.row[t] < 0], size) * self.weight[p], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        rows, share = self.row[t][self.row[t] >= 0], w[self.row[t] >= 0].astype(np.float32)
        bound = (share @ self.largest[rows] + sums.max(1)) * (1 + 1e-5)  # sums are rounded to 24 bits
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done, step, least = 0, GROUP, 0.0
        while done < len(order) and bound[order[done]] >= least:
            group = order[done : done + step]
            group = group[bound[group] >= least]
            found = (sums[group] + share @ self.dense[group[:, None], rows]).ravel()
            place = (group[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            new = np.flatnonzero((found > 0) & (found >= least) & (place != but))
            score, at = np.concatenate((score, found[new])), np.concatenate((at, place[new]))
            if len(score) > 8 * k:
                some = np.flatnonzero(score >= np.partition(score, -k)[-k])
                score, at = score[some], at[some]
            best = np.lexsort((at, -score))[:k]
            score, at = score[best], at[best]
            if len(score) == k:
                least = score[-1]
            done, step = done + step, step * 2
        return at, score

    def vote(self, t: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of label 1 among the neighbours' weights, the prior counting as a faint neighbour."""
        at, s = self.search(t, w, NEIGHBOURS, but)
        x = s * self.weights[at]
        return float((x @ self.labels[at] + FAINT * self.prior) / (x.sum() + FAINT)), at, s


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots for linear interpolation of the mean of y as a rising function of x."""
    levels = np.unique(x)
    at = np.searchsorted(levels, x)
    weight, total = np.bincount(at, w, len(levels)), np.bincount(at, w * y, len(levels))
    stack: list[list[float]] = []
    for v, a, b in zip(levels, weight, total, strict=True):
        stack.append([a, b, v * a])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            top = stack.pop()
            stack[-1] = [p + q for p, q in zip(stack[-1], top, strict=True)]
    return np.array([s[2] / s[0] for s in stack]), np.array([s[1] / s[0] for s in stack])


class Model:
    """vocabulary: the terms' hashes, sorted; weight: what each weighs beside its count."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, index: BlockMaxIndex | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.vocabulary, self.weight, self.index, self.knots = vocabulary, weight, index, knots

    def vectors(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of n texts from what terms() found: text, place in the vocabulary, weight; other terms left out."""
        at, known = _places(self.vocabulary, term)
        text, at = text[known], at[known]
        x = (1 + np.log(count[known])) * self.weight[at]
        norm = np.sqrt(np.bincount(text, x * x, n))
        return text, at, x / np.where(norm > 0, norm, 1)[text]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores of texts, and each one's neighbours: positions and similarities."""
        n = len(offsets) - 1
        if self.index is None:
            return np.zeros(n), [(np.empty(0, np.int64), np.empty(0))] * n
        text, at, x = self.vectors(*terms(data, offsets), n)
        cut = np.searchsorted(text, np.arange(n + 1))
        votes, found = np.empty(n), []
        for i in range(n):
            own = slice(cut[i], cut[i + 1])
            votes[i], where, s = self.index.vote(at[own], x[own])
            found.append((where, s))
        return np.clip(np.interp(votes, *self.knots), 0, 1), found


def _places(vocabulary: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms are in the vocabulary, and whether they are."""
    at = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
    return at, vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)


def _counted(batches, vocabulary) -> Iterator[pa.RecordBatch]:
    """How many of the task's texts hold each term, and at -1 how many texts there are."""
    known, n = vocabulary.value, 0
    counts = np.zeros(len(known), np.int64)
    for batch in batches:
        n += len(batch)
        for _, _, data, offsets in pieces(batch.column(0)):
            at, ok = _places(known, terms(data, offsets)[1])
            counts += np.bincount(at[ok], minlength=len(known))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(counts[some], n))], ["term", "texts"])


def _learned(batches) -> Iterator[pa.RecordBatch]:
    """Each example's terms and counts, and how many terms it has."""
    for batch in batches:
        for first, end, data, offsets in pieces(batch.column("text")):
            text, term, count = terms(data, offsets)
            cut = np.searchsorted(text, np.arange(end - first + 1))
            lists = pa.array(cut, pa.int32())
            columns = [batch.column("id").slice(first, end - first), batch.column("label").slice(first, end - first), pa.array(np.diff(cut)), pa.ListArray.from_arrays(lists, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(count))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "n", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_out: int = 0) -> Model:
    """Learns from documents whose label is 0 or 1 and whose crc32(id) mod folds is not held_out.

    Of several labels of one id the largest counts, of several texts the one of the least hash. Without any example of both
    classes the model scores all texts 0.
    """
    spark: SparkSession = docs.sparkSession
    none = Model(np.empty(0, np.uint64), np.empty(0), None, None)
    own = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    own = own.filter(~in_fold(F.col("id"), folds, held_out)).groupBy("id").agg(F.max("label").alias("label"))
    own = own.join(docs.select(F.col(id_column).cast("long").alias("id")), "id", "left_semi")  # labels of absent documents take no place in the sample
    true = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    if len(true) < 2:
        return none
    picked = [r for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)) for r in own.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    chosen = spark.createDataFrame(picked, "id long, label int")  # MOST_TOXIC + MOST_CLEAN rows at most
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    examples = rows.mapInArrow(_learned, "id long, label int, n long, terms array<bigint>, counts array<bigint>")
    so_far = F.sum("n").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))  # a bounded sample
    found = examples.filter(F.col("n") <= MOST_IN_ALL // LARGEST).withColumn("so_far", so_far).filter(F.col("so_far") <= MOST_IN_ALL).drop("so_far").orderBy("id").toArrow()
    y = found.column("label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return none
    term, count = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "counts"))
    owner = np.repeat(np.arange(len(y)), found.column("n").to_numpy())
    vocabulary, at = np.unique(term.view(np.uint64), return_inverse=True)

    shared = spark.sparkContext.broadcast(vocabulary)
    counts = docs.select(text_column).mapInArrow(lambda it: _counted(it, shared), "term int, texts long").groupBy("term").agg(F.sum("texts").alias("texts")).toArrow()
    where, texts = counts.column("term").to_numpy(), counts.column("texts").to_numpy()
    frequency = np.zeros(len(vocabulary))
    frequency[where[where >= 0]] = texts[where >= 0]
    idf = np.log((1 + texts[where < 0].sum()) / (1 + frequency)) + 1e-6

    toxic, both = np.bincount(at, y[owner], len(vocabulary)), np.bincount(at, minlength=len(vocabulary))
    n = np.array([len(y) - y.sum(), y.sum()])
    rate = np.minimum((both + RARE) / len(y), 0.999)
    z = np.abs(toxic / n[1] - (both - toxic) / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n).sum())

    model = Model(vocabulary, idf * (LEAST_WEIGHT + np.maximum(z - CHANCE, 0)), None, None)
    weights = np.where(y > 0, true[1] / n[1], true[0] / n[0])
    weights /= weights.min()
    owner, at, x = model.vectors(owner, term.view(np.uint64), count, len(y))
    index = BlockMaxIndex(owner, at, x, y, weights, found.column("id").to_numpy(), len(vocabulary))
    index.prior = true[1] / (true[0] + true[1])
    cut = np.searchsorted(owner, np.arange(len(y) + 1))
    fitted = np.arange(0, len(y), max(1, math.ceil(len(y) / MOST_FITTED)))
    votes = np.array([index.vote(at[cut[i] : cut[i + 1]], x[cut[i] : cut[i + 1]], index.position[i])[0] for i in fitted])
    model.index = index
    model.knots = isotonic(votes, y[fitted], weights[fitted])
    return model


_EVIDENCE = "array<struct<example:bigint,label:int,similarity:double>>"


def score(docs: DataFrame, model: Model, text_column: str = "text", only_clean: bool = False) -> DataFrame:
    """docs with score, predicted and evidence added, under names that clash with no column; or, for
    only_clean, the rows of docs whose score is under 0.5. Null and empty texts have no neighbours: they get the score of the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    added = [free_name(docs, c) for c in ("score", "predicted", "evidence")]
    position = names.index(text_column)

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(position)):
                own = batch.slice(first, end - first)
                scores, found = m.score(data, offsets)
                if only_clean:
                    yield own.filter(pa.array(scores < 0.5))
                    continue
                at, s = (np.concatenate([x[i][:3] for x in found]) for i in (0, 1))
                cut = pa.array(np.cumsum([0, *(min(3, len(x[0])) for x in found)]), pa.int32())
                ids, labels = (m.index.ids[at], m.index.labels[at]) if m.index else (at, at)
                shown = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(labels.astype(np.int32)), pa.array(s)], ["example", "label", "similarity"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(cut, shown)], [*names, *added])

    schema = T.StructType(docs.schema.fields[:])
    if not only_clean:
        more = T._parse_datatype_string(f"score double, predicted int, evidence {_EVIDENCE}")
        for name, field in zip(added, more.fields, strict=True):
            schema = schema.add(name, field.dataType)
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted, evidence (the nearest three examples).

    Null, empty and wordless texts have no neighbours and score the calibrated prior. Of equally near examples those before in the
    index count; a score of exactly 0.5 predicts 1. A null id is never held out; rows that repeat an id are each scored by their
    own text. Texts of any length are scored whole. Other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_column=id_column, text_column=text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    held = F.coalesce(in_fold(F.col("id"), 5, 0), F.lit(False))
    return score(rows, model).select(F.col("id").alias(id_column), held.alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; each row is judged by its own text, as toxicity() does. Other columns pass through,
    whatever their names; an empty table gives an empty one."""
    return score(docs, fit(docs, labels, id_column=id_column, text_column=text_column), text_column, only_clean=True)
