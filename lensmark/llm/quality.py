"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its characters and words and those of the lines before and after. The
field labels lines good or bad; it learns from the lines of a bounded sample of labelled documents,
which carry their document's label. A document's quality is the mean of its lines' forward-backward
marginals for good, weighted by length, put on a probability scale by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmark.llm import hashes
from lensmark.llm.common import in_fold, pieces

#: Bounds of what is fitted: labelled documents of each label, lines of one (documents of more are not learned from), and lines
#: of each label in all (documents are taken in the order of their ids' hashes until they are reached).
MOST_EACH, MOST_LINES, MOST_IN_ALL = 1500, 2000, 100_000
ROUNDS = 250

_CLASSES = ["upper", "lower", "digit", "exclaim", "bar", "symbol", "stop", "blank", "wide", "control"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("control"), np.uint8)
    for b in range(33, 127):
        c = chr(b)
        t[b] = _CLASSES.index("upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "exclaim" if c in "!?" else "bar" if c in "|/\\_~" else "stop" if c in ".,;:'\"()-" else "symbol")
    t[[0x20, 0x09]] = _CLASSES.index("blank")
    t[0x80:] = _CLASSES.index("wide")
    return t


_TABLE = _class_table()
#: A line's own features.
OWN = len(_CLASSES) + 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line that is not blank: features with those of its neighbours, length in bytes; and n + 1 offsets by text."""
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    new[1:] |= np.append(data, 0)[: len(data)] == 0x0A
    at = np.flatnonzero(new[:-1])
    starts, ends, h, _ = hashes.words(data, offsets)
    line_of_word = np.searchsorted(at, starts, "right") - 1
    n_words = np.bincount(line_of_word, minlength=len(at))
    keep = n_words > 0
    if not keep.any():
        return np.empty((0, 3 * OWN + 3)), np.empty(0), np.zeros(len(offsets), np.int64)
    size = np.diff(np.append(at, len(data))).astype(float)
    kind = _TABLE[data]
    counts = np.stack([np.add.reduceat((kind == i).astype(np.int32), at) for i in range(len(_CLASSES))], 1).astype(float)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    capital = (kind[starts] == 0) & (np.append(kind, 0)[np.minimum(starts + 1, len(kind))] == 0)
    w = np.maximum(n_words, 1)
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    total = np.add.reduceat(h, np.minimum(first, len(h) - 1))
    same = np.zeros(len(at), bool)
    rows = np.flatnonzero(keep)
    same[rows[1:]] = (total[rows[1:]] == total[rows[:-1]]) & (n_words[rows[1:]] == n_words[rows[:-1]])
    last = np.zeros(len(at), bool)
    last[rows] = np.isin(data[ends[first[rows] + n_words[rows] - 1] - 1], [ord(c) for c in ".!?"])
    own = np.concatenate(
        (
            counts / size[:, None],
            np.stack(
                (
                    np.log1p(n_words) / 5,
                    np.log1p(size) / 7,
                    (np.bincount(line_of_word, ends - starts, len(at)) / w) / 10,
                    np.bincount(line_of_word, again, len(at)) / w,
                    np.bincount(line_of_word, capital, len(at)) / w,
                    same,
                    last,
                    kind[np.minimum(starts[np.minimum(first, len(starts) - 1)], len(kind) - 1)] == 0,
                ),
                1,
            ),
        ),
        1,
    )[rows]
    size = size[rows]
    by = np.searchsorted(at[rows], offsets)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    full = np.diff(by) > 0
    head, tail = np.zeros(len(rows)), np.zeros(len(rows))
    head[by[:-1][full]] = 1
    tail[by[1:][full] - 1] = 1
    before[head > 0] = 0
    after[tail > 0] = 0
    return np.concatenate((own, before, after, head[:, None], tail[:, None], np.ones((len(rows), 1))), 1), size, by


def _batched(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with lines, longest first, and their lengths."""
    n = np.diff(by)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    return order, n[order]


def marginals(unary: np.ndarray, by: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions [from, to], and the log partition summed.

    unary: a line's log potential of good against bad; chain: log potentials of transitions. All
    texts step together, longest first.
    """
    order, n = _batched(by)
    forward, p = np.zeros((len(unary), 2)), np.zeros(len(unary))
    moved, log_z = np.zeros((2, 2)), 0.0
    if not len(order):
        return p, moved, log_z
    start = by[order]
    u = np.stack((np.zeros(len(unary)), unary), 1)
    longest = int(n[0])
    alive = np.searchsorted(-n, -np.arange(longest), "left")  # texts longer than t
    forward[start] = u[start]
    for t in range(1, longest):
        at = start[: alive[t]] + t
        f = forward[at - 1][:, :, None] + chain
        forward[at] = np.logaddexp(f[:, 0], f[:, 1]) + u[at]
    end = start + n - 1
    z = np.zeros(len(by) - 1)
    z[order] = np.logaddexp(forward[end, 0], forward[end, 1])
    back = np.zeros((len(order), 2))
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        total = z[order[:k]]
        p[at] = np.exp(forward[at, 1] + back[:k, 1] - total)
        if t:
            inner = u[at] + back[:k]
            moved += np.exp(forward[at - 1][:, :, None] + chain + inner[:, None, :] - total[:, None, None]).sum(0)
            b = chain + inner[:, None, :]
            back[:k] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    return p, moved, float(z.sum())


class Model:
    """weights by feature, chain potentials, feature means and scales, and the logistic fit of the mean marginal."""

    def __init__(self, weights, chain, mean, scale, slope, offset):
        self.weights, self.chain, self.mean, self.scale, self.slope, self.offset = weights, chain, mean, scale, slope, offset

    def means(self, x: np.ndarray, size: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The length-weighted mean of P(good) by text; nan without lines."""
        p, _, _ = marginals((x - self.mean) / self.scale @ self.weights, by, self.chain)
        total = np.concatenate(([0.0], np.cumsum(size)))
        good = np.concatenate(([0.0], np.cumsum(size * p)))
        with np.errstate(invalid="ignore"):
            return (good[by[1:]] - good[by[:-1]]) / (total[by[1:]] - total[by[:-1]])

    def scores(self, means: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(means), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * np.nan_to_num(means) + self.offset, -50, 50))))


def train(x: np.ndarray, size: np.ndarray, by: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Full-batch Adam on the conditional likelihood with an L2 penalty; then the logistic fit with class weights."""
    mean, scale = x.mean(0), x.std(0)
    mean[scale < 1e-9] = 0
    scale[scale < 1e-9] = 1
    xs = (x - mean) / scale
    y = np.repeat(label, np.diff(by)).astype(float)
    counts = np.diff(by)
    order, n = _batched(by)
    seen = np.zeros((2, 2))
    for i, k in zip(order, n, strict=True):
        seen[int(label[i]), int(label[i])] += k - 1
    w, chain = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.concatenate((w, chain.ravel()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, ROUNDS + 1):
        p, moved, _ = marginals(xs @ theta[:-4], by, theta[-4:].reshape(2, 2))
        g = np.concatenate((xs.T @ (y - p), (seen - moved).ravel())) / max(1, counts.sum()) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.08 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), mean, scale, 1.0, 0.0)
    s = model.means(x, size, by)
    ok = ~np.isnan(s)
    s, t, c = s[ok], label[ok].astype(float), weight[ok]
    ab = np.array([1.0, 0.0])
    for _ in range(50):  # Newton, a little ridge
        q = 1 / (1 + np.exp(-np.clip(ab[0] * s + ab[1], -50, 50)))
        z = np.stack((s, np.ones_like(s)), 1)
        grad = z.T @ (c * (t - q)) - 1e-2 * ab
        hess = (z * (c * q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(2)
        ab = ab + np.clip(np.linalg.solve(hess, grad), -5, 5)
    model.slope, model.offset = float(ab[0]), float(ab[1])
    return model


def _learned(batches) -> Iterator[pa.RecordBatch]:
    """Features of each labelled text's lines, as one binary a text, and how many there are."""
    for batch in batches:
        out, n = [], []
        for first, end, data, offsets in pieces(batch.column("text")):
            x, size, by = features(data, offsets)
            for i in range(end - first):
                part = slice(by[i], by[i + 1])
                ok = 0 < by[i + 1] - by[i] <= MOST_LINES
                out.append(np.concatenate((x[part], size[part, None]), 1).astype(np.float32).tobytes() if ok else None)
                n.append(int(by[i + 1] - by[i]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["id", "label", "lines", "n"])


def fit(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", folds: int = 3, held_out: int = 1) -> Model | None:
    """Learns from documents whose label is 0 or 1 and whose crc32(id) mod folds is not held_out; None without both labels.
    Of several labels of one id the smallest counts, of several texts the one of the least hash."""
    own = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    own = own.filter(~in_fold(F.col("id"), folds, held_out)).groupBy("id").agg(F.min("label").alias("label"))
    true = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    if len(true) < 2:
        return None
    picked = [r for y in (0, 1) for r in own.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(MOST_EACH).collect()]
    chosen = docs.sparkSession.createDataFrame(picked, "id long, label int")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    lines = rows.mapInArrow(_learned, "id long, label int, lines binary, n long").filter("lines IS NOT NULL")
    so_far = F.sum("n").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))  # MOST_EACH rows a label at most
    found = sorted(lines.withColumn("so_far", so_far).filter(F.col("so_far") <= MOST_IN_ALL).select("id", "label", "lines").collect(), key=lambda r: r[0])
    if len({r[1] for r in found}) < 2:
        return None
    parts = [np.frombuffer(r[2], np.float32).reshape(-1, 3 * OWN + 4).astype(float) for r in found]
    x = np.concatenate(parts)
    by = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    label = np.array([r[1] for r in found])
    weight = np.where(label == 1, true[1] / (label == 1).sum(), true[0] / (label == 0).sum())
    return train(x[:, :-1], x[:, -1], by, label, weight * len(label) / weight.sum())


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted, n_lines.

    Null, empty and blank texts have no lines and score 0, as do all texts if there are not labelled
    documents of both kinds. A score of exactly 0.5 predicts 1. A null id is never held out; rows that repeat an id are each scored by
    their own text. Texts of any length and number of lines are scored whole. Other columns are ignored; an empty table gives an empty
    result.
    """
    model = fit(docs, labels, id_column=id_column, text_column=text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column("text")):
                x, size, by = features(data, offsets)
                s = model.scores(model.means(x, size, by)) if model else np.zeros(end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.diff(by).astype(np.int32))], ["id", "score", "predicted", "n_lines"]
                )

    out = rows.mapInArrow(run, "id long, score double, predicted int, n_lines int")
    held = F.coalesce(in_fold(F.col("id"), 3, 1), F.lit(False))
    return out.select(F.col("id").alias(id_column), held.alias("held_out"), "score", "predicted", "n_lines")
