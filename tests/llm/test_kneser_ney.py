"""Interpolated modified Kneser-Ney against plain dictionaries of whole words."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lensmark.llm import kneser_ney, queries

END, BEGIN = "</s>", "<s>"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Plain:
    def __init__(self, texts, order):
        self.order, self.c = order, Counter(t for x in texts for t in words(x))
        self.a = {order: Counter()}
        lower = {k: Counter() for k in range(1, order)}
        for x in texts:
            own = [BEGIN, *words(x)] if order > 1 else words(x)
            for i in range(len(own)):
                if own[i] != BEGIN:
                    k = min(order, i + 1)
                    (self.a[order] if k == order else lower[k])[tuple(own[i - k + 1 : i + 1])] += 1
        for k in range(order - 1, 0, -1):
            self.a[k] = lower[k] + Counter(g[1:] for g in self.a[k + 1])
        self.d, self.by = {}, {}
        for k, a in self.a.items():
            n = [sum(v == i for v in a.values()) for i in (1, 2, 3, 4)]
            if min(n):
                y = n[0] / (n[0] + 2 * n[1])
                self.d[k] = [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3)]
            else:
                self.d[k] = [0, 0.5, 1, 1.5]
            self.by[k] = defaultdict(list)
            for g, v in a.items():
                self.by[k][g[:-1]].append(v)

    def p(self, history, w):
        out = 1 / (len(self.c) + 1)
        for k in range(1, self.order + 1):
            if k - 1 > len(history):
                break
            context = tuple(history[len(history) - k + 1 :]) if k > 1 else ()
            if own := self.by[k].get(context):
                a, d, total = self.a[k].get((*context, w), 0), self.d[k], sum(own)
                out = max(a - d[min(a, 3)], 0) / total + sum(d[min(v, 3)] for v in own) / total * out
        return out

    def score(self, text):
        own = words(text)
        n, v = sum(self.c.values()), len(self.c)
        base = sum(math.log10((self.c[w] + 1) / (n + v + 1)) for w in own)
        full = [BEGIN, *own] if self.order > 1 else own
        skip = self.order > 1
        return len(own), sum(self.c[w] > 0 for w in own), base, sum(math.log10(self.p(full[max(0, i - self.order + 1) : i], full[i])) for i in range(skip, len(full)))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    out = [" ".join("abcdefghijkl"[i] for i in rng.zipf(1.4, int(rng.integers(1, 60))) % 12) for _ in range(60)]
    return [*out, None, "", " \n", "A b C", "a b c", "a b c", "É é ß", "zz " * 500]


@pytest.mark.parametrize(("order", "shard", "at_once"), [(1, 1 << 20, 1 << 20), (2, 1 << 20, 1 << 20), (2, 64, 50), (3, 100, 70), (4, 1 << 20, 1 << 20)])
def test_scores_equal_plain_ones(spark, texts, order, shard, at_once):
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = kneser_ney.train(train, order, shard, at_once)
    plain = Plain(texts, order)
    assert (model.tokens, model.types) == (sum(plain.c.values()), len(plain.c))
    other = [*texts, "a b unheard c", "unheard", "l k j i h g f e d c b a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(other)], "i int, text string, Score int")
    got = kneser_ney.score(docs, model)
    assert got.columns == ["i", "text", "Score", "n_tokens", "n_known", "base_score", "score_"]
    for row in got.collect():
        want = plain.score(row.text)
        assert (row.n_tokens, row.n_known) == want[:2]
        assert row.base_score == pytest.approx(want[2], abs=1e-8)
        assert row.score_ == pytest.approx(want[3], abs=1e-8)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(spark, texts, order):
    plain = Plain(texts, order)
    for history in ([BEGIN], [BEGIN, "a"], ["a", "b"], ["unheard", "c"]):
        assert sum(plain.p(history, w) for w in [*plain.c, "unheard"]) == pytest.approx(1)


def test_query(spark, texts, tmp_path):
    rows = [*enumerate(texts), (None, "a b"), (3, "a b c"), (3, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    plain = Plain([t for i, t in rows if not held(i)], kneser_ney.ORDER)
    got = queries.op12_kneser_ney(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), held(i), *plain.score(t)) for i, t in rows)
    for g, w in zip(sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], abs=6e-7)  # the query rounds to six digits
    assert {r.train_tokens for r in got} == {sum(plain.c.values())}


def test_no_training_texts(spark):
    model = kneser_ney.train(spark.createDataFrame([], "text string"))
    docs = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser_ney.score(docs, model).collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert kneser_ney.score(docs.filter("false"), model).count() == 0


def test_unmounted_folder_is_refused(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "shared_dir", lambda s: "hdfs://host/shared")
    with pytest.raises(ValueError, match="mounted"):
        kneser_ney.train(spark.createDataFrame([("a",)], "text string"))
