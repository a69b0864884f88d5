"""Periodic runs against a plain definition: all stretches, smallest periods by trial."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensmark.llm import periodic, queries


def plain(own, length=6, exponent=4):
    """Every maximal stretch whose smallest period q fits exponent times, by trying all starts and periods."""
    n, out = len(own), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and own[j] == own[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(length, exponent * q):
                piece = own[i : i + size]
                if q == next(p for p in range(1, q + 1) if all(piece[k] == piece[k + p] for k in range(size - p))):
                    out.add((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    own = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(own), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = plain(own)
    kept = [w for i, w in enumerate(own) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = max(runs, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(b" ".join(kept)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(2, 5), st.integers(1, 8), st.sampled_from([0, 1200]))
def test_stretches_equal_the_definition(word_ids, exponent, length, wide):
    periodic.WIDE = wide
    own = [str(x).encode() for x in word_ids]
    a, top = periodic.numbers(own), periodic.lags(len(own), exponent)
    parts = [periodic.stretches(a, lo, min(lo + 2, top), length, exponent) for lo in range(1, top + 1, 3)]
    periodic.WIDE = 1200
    assert periodic.joined(parts) == plain(own, length, exponent)


def test_long_repeats_among_random_words_are_found():
    rng = np.random.default_rng(3)
    own = [str(x).encode() for x in rng.integers(0, 5, 4000)]
    for at, q, times in ((100, 37, 6), (1500, 300, 4), (3000, 1, 40)):
        own[at : at + q * times] = own[at : at + q] * times
    assert periodic.joined([periodic.stretches(periodic.numbers(own), 1, 1000)]) == plain(own)


TEXTS = ["", None, "   \n", "a", "a a a a a a", "a b " * 9 + "c", "x y z " * 5 + "q " + "w " * 7, "é ü " * 4 + "é", "a\x0bb\x1ca b a b a b a b", "la " * 3000, "one two three four five six"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(44)] + [(1000 + i, " ".join(map(str, rng.integers(0, 3, int(rng.integers(0, 120)))))) for i in range(120)] + [(None, "b b b b b b b"), (7, "again again"), (7, "again again")]
    where = tmp_path_factory.mktemp("runs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    return str(where), rows


def test_query_equals_brute_force(spark, folder):
    where, rows = folder
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, where).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_ranges_of_lags_give_the_same(spark, folder):
    where, rows = folder
    docs = spark.read.parquet(f"{where}/documents.parquet").selectExpr("doc_id", "text", "1 AS runs", "text AS Row", "2 AS n_runs")
    one = periodic.periodic_runs(docs)
    many = periodic.periodic_runs(docs, most_lags=3)
    assert one.columns == ["doc_id", "text", "runs", "Row", "n_runs", "runs_", "highest", "collapsed", "n_runs_"] == many.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(docs).count() == 0


def test_exponent_of_one_is_refused(spark):
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(spark.createDataFrame([], "text string"), exponent=1)
