"""Toxicity, language and quality: exactness, held-out accuracy, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lensmark.llm import language, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, id string"
ODD = [(None, "no id", "aa", 0.5, "x"), (9001, None, None, 0.5, "x"), (9002, "", "aa", 0.5, "x"), (9003, "?!  12", "bb", 0.5, "x"), (9004, "w " * 30000, "aa", 0.5, "x"), (9005, "same text", "bb", 0.5, "x"), (9005, "same text", "bb", 0.5, "x")]


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvéü"))}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["aa", "bb", "cc"])
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        lines = []
        for _ in range(rng.randint(1, 6)):
            own = [rng.choice(words[lang]) for _ in range(rng.randint(6, 14))]
            if toxic:
                own[rng.randrange(len(own))] = rng.choice(["vilewordx", "nastyterm", "foulthing"])
            lines.append(" ".join(own) + "." if good else " ".join(f"{w.upper()}!!" for w in own))
        rows.append((i, "\n".join(lines), lang, 0.5, "x"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows + ODD, SCHEMA), spark.createDataFrame(labels + [(9002, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), labels


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def check(rows, labels, at, m, r, least=0.95):
    truth = {x[0]: x[at] for x in labels}
    assert all(x["held_out"] == held(x["doc_id"], m, r) for x in rows)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows)
    own = [x["predicted"] == truth[x["doc_id"]] for x in rows if x["held_out"] and x["doc_id"] in truth]
    assert len(own) > 20 and sum(own) / len(own) >= least


def test_toxicity(spark):
    docs, labels, truth = frames(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(truth) + len(ODD)
    check(rows, truth, 2, 5, 0)
    shown = [x for x in rows if x["predicted"]]
    assert shown and all(x["evidence"] and x["evidence"][0]["similarity"] > 0 for x in shown)
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns
    assert sorted(str(r[0]) for r in clean.collect()) == sorted(str(x["doc_id"]) for x in rows if not x["predicted"])
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(x["score"] == 0 for x in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("common", [1, 32, 10**6])
def test_block_max_search_is_exact(common, monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = np.random.default_rng(0)
    full = np.zeros((540, 60))
    for row in full[:500]:
        t = rng.choice(60, rng.integers(0, 6), replace=False)
        row[t] = rng.random(len(t))
    full[500:] = full[:40]  # ties
    full /= np.maximum(np.linalg.norm(full, axis=1), 1e-12)[:, None]
    full = full.astype(np.float32).astype(float)
    owner, term = np.nonzero(full)
    index = toxicity.BlockMaxIndex(owner, term, full[owner, term], rng.integers(0, 2, 540).astype(float), np.ones(540), np.arange(540), 60)
    placed = np.zeros_like(full)
    placed[index.position] = full
    assert np.array_equal(index.ids[index.position], np.arange(540))
    for i in range(200):
        t = np.flatnonzero(full[i])
        for but in (-1, int(index.position[i])):
            want = placed @ full[i]
            want[but if but >= 0 else []] = 0
            order = np.lexsort((np.arange(540), -np.round(want, 12)))[:15]
            order = order[want[order] > 0]
            at, s = index.search(t, full[i, t], 15, but)
            assert np.allclose(s, want[order], atol=1e-6) and len(at) == len(order) and np.allclose(placed[at] @ full[i], s, atol=1e-6)


def test_scores_against_brute_force(spark):
    """The whole query: vectors, votes and calibration by plain loops."""
    docs, labels, truth = frames(spark)
    got = {x["doc_id"]: x["score"] for x in toxicity.toxicity(docs, labels).collect() if x["doc_id"] is not None and x["doc_id"] < 9000}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    known = {i: t for i, _, t in truth if not held(i, 5, 0)} | {9002: 0}
    n1 = sum(known.values())
    n0 = len(known) - n1
    rows = [split(r["text"] or "") for r in docs.collect()]
    vocabulary = {w for i in known for w in split(texts[i])}
    weight = {}
    for w in vocabulary:
        a, b = (sum(w in split(texts[i]) for i, y in known.items() if y == want) for want in (1, 0))
        rate = min((a + b + 4) / len(known), 0.999)
        z = abs(a / n1 - b / n0) / math.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
        weight[w] = (math.log((1 + len(rows)) / (1 + sum(w in r for r in rows))) + 1e-6) * (0.1 + max(z - 1, 0))

    def vector(text):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in Counter(split(text)).items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i in known}

    def vote(v, but=None):
        s = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), known[i]) for i, u in vectors.items() if i != but), reverse=True)[:15]
        s = [x for x in s if x[0] > 0]
        return (sum(x * y for x, y in s) + 1.0 * n1 / len(known)) / (sum(x for x, _ in s) + 1.0)

    own = [(vote(vectors[i], i), y) for i, y in sorted(known.items())]
    knots = toxicity.isotonic(np.array([v for v, _ in own]), np.array([float(y) for _, y in own]), np.ones(len(own)))
    near = [abs(float(np.interp(vote(vector(texts[i])), *knots)) - got[i]) < 1e-3 for i in got]
    assert len(near) == 300 and sum(near) >= 0.99 * len(near)  # weights of examples are 32 bits wide: a step of the fit may be missed


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1, 1, 0, 1]), np.ones(5))
    assert np.all(np.diff(x) > 0) and np.all(np.diff(y) >= 0) and y[0] == 0 and y[-1] == 1


def test_languages(spark):
    docs, _, _ = frames(spark)
    rows = language.languages(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == 300 + len(ODD)
    assert all(x["held_out"] == held(x["doc_id"], 3, 1) and 0 <= x["score"] <= 1 for x in rows)
    own = [x["lang_pred"] == truth[x["doc_id"]] for x in rows if x["held_out"] and x["doc_id"] < 9000]
    assert sum(own) / len(own) >= 0.97
    odd = {x["doc_id"]: x["lang_pred"] for x in rows if x["doc_id"] in (9001, 9002, 9003)}
    assert set(odd.values()) == {"und"}
    assert {x["lang_pred"] for x in rows} <= {"aa", "bb", "cc", "und"}
    assert language.languages(docs.limit(0)).count() == 0
    unlabelled = language.languages(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {x["lang_pred"] for x in unlabelled} == {"und"}


def test_quality(spark):
    docs, labels, truth = frames(spark)
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(truth) + len(ODD)
    check(rows, truth, 1, 3, 1)
    assert all(x["score"] == 0 for x in rows if x["doc_id"] in (9001, 9002))
    assert {x["score"] for x in quality.quality(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 5, 1]
    by = np.concatenate(([0], np.cumsum(sizes)))
    unary, chain = rng.normal(size=9), rng.normal(size=(2, 2))
    p, moved, log_z = quality.marginals(unary, by, chain)
    want, pairs, z_all = np.zeros(9), np.zeros((2, 2)), 0.0
    for k, n in enumerate(sizes):
        if not n:
            continue
        total, good, trans = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(unary[by[k] + i] * y[i] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            good += w * np.array(y)
            for i in range(n - 1):
                trans[y[i], y[i + 1]] += w
        want[by[k] : by[k + 1]] = good / total
        pairs += trans / total
        z_all += np.log(total)
    assert np.allclose(p, want) and np.allclose(moved, pairs) and np.isclose(log_z, z_all)


def test_languages_equal_a_plain_compression(spark):
    """Each text under each dictionary by zstandard's own calls; the least wins, the more frequent language in ties."""
    import zstandard
    from pyspark.sql import functions as F

    docs, _, _ = frames(spark)
    docs = docs.union(spark.createDataFrame([(9100, "abab " * 400, None), (9101, "é", None), (9102, "x", None)], docs.select("doc_id", "text", "lang").schema)) if docs.columns == ["doc_id", "text", "lang"] else docs
    content = language.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.languages(docs).collect()}
    want = set()
    for r in docs.select("doc_id", language.letters(F.col("text")).alias("t")).collect():
        sizes = []
        for name, c in content.items():
            d = zstandard.ZstdCompressionDict(c.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append((len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(r["t"].encode())), name))
        best = min(s for s, _ in sizes)
        want.add((r["doc_id"], next(n for s, n in sizes if s == best) if r["t"] else "und"))
    assert got == want


def test_a_row_too_large_for_the_sample_leaves_the_rest(spark, monkeypatch):
    docs, labels, _ = frames(spark)
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    large = [(20_000 + i, " ".join(f"w{i}x{j}" for j in range(3000)), i % 2) for i in range(40)]
    more = docs.union(spark.createDataFrame([r[:2] for r in large], docs.schema))
    known = labels.union(spark.createDataFrame([(r[0], r[2]) for r in large] + [(90_000 + i, 1) for i in range(50)], labels.schema))
    monkeypatch.setattr(toxicity, "MOST_IN_ALL", 20_000)
    rows = [r for r in toxicity.toxicity(more, known).collect() if r["doc_id"] is not None and r["doc_id"] < 9000]
    assert any(r["score"] >= 0.5 for r in rows) and any(0 < r["score"] < 0.5 for r in rows)
