"""Exact dedup, near-dedup and components against brute force."""

import hashlib
import random
import re

from lensmark.llm import common, exact_dedup, near_dedup
from lensmark.llm.common import Scratch
from lensmark.llm.components import components

SCHEMA = "doc_id long, text string, id string, kept int, bucket string"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        rows.append((i * 3 + 1, " ".join(words)))
    hot = [f"h{i}" for i in range(150)]
    for i in range(60):  # one large group of near copies, some of them apart
        words = list(hot)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    return rows


def brute(rows, k=4):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            common = len(sets[x] & sets[y])
            if x < y and common and 100 * common >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE two"), (2005, "one two three"), (2006, "a b c d")]
    df = spark.createDataFrame([(*r, "z", 1, "q") for r in rows], SCHEMA)
    got = {r[0]: (r[1], r[2], r[3]) for r in near_dedup.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    assert got[2004] == (1, 2003, False) and got[2000] == (0, 2000, True)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    rows = corpus(5, 30)
    got = {r[0]: (r[1], r[2], r[3]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_hot_pivots_and_clusters_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "SPLIT", 2)
    monkeypatch.setattr(common, "HOT", 50)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    rows = corpus(6, 30)
    got = {r[0]: (r[1], r[2], r[3]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, long), (8, long + " end")]
    got = sorted((r[0] or -1, r[1], r[2] or -1, r[3]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 2, -1, True), (7, 2, 7, True), (7, 2, 7, True), (8, 29998, 8, True), (9, 29997, 8, False)]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).columns == empty.columns


def test_fewest_matches_is_a_posterior_bound():
    least = near_dedup.fewest_matches(0.8, 1e-7)
    assert len(least) == 8 and all(a < b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.8 * 128


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, i) for i in range(901, 950)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()))
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in list(root) if find(x) != x}


def test_exact_duplicates(spark):
    rows = [(1, "Ab"), (5, "aB"), (3, None), (4, ""), (9, "É"), (10, "é"), (11, "x" * 50000), (12, "x" * 50000), (None, "ab"), (None, "alone"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame([(*r, "z", 1, "q") for r in rows], SCHEMA)
    got = sorted(((r[0] or -1, r[1] or -1, r[2], r[3], r[4]) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(-1 if i is None else i)
    want = []
    for i, t in rows:
        own, i = groups[lower(t)], -1 if i is None else i
        want.append((i, max(own), len(own), max(own) in (i, -1), hashlib.sha256(lower(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = [r[0] for r in exact_dedup.drop_exact_duplicates(df.filter("doc_id < 6")).orderBy("doc_id").collect()]
    assert kept == [4, 5]


def test_rows_are_dropped_by_id_and_text(spark):
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "pq"]
    rows = [(1, "same"), (1, "other"), (2, "Same"), (3, "twice"), (3, "twice"), (None, "same"), (None, "alone"), (None, "ALONE"), (4, "twice"), (5, None), (5, ""), (5, "five")]
    df = spark.createDataFrame([(*r, "z", 1, "q") for r in rows], SCHEMA)
    kept = sorted(((r[0] or -1, lower(r[1])) for r in exact_dedup.drop_exact_duplicates(df).collect()))
    assert kept == [(-1, "alone"), (1, "other"), (2, "same"), (4, "twice"), (5, ""), (5, "five")]
    only = spark.createDataFrame([(3, "twice", "a"), (3, "twice", "b")], "doc_id long, text string, row string")
    assert exact_dedup.drop_exact_duplicates(only).count() == 1
    near = [(1, long[0]), (2, long[0] + " end"), (2, long[1]), (3, "end " + long[1]), (None, long[0] + " null"), (4, "four words of text")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [near[0], near[2], near[5]]
