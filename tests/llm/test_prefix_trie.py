"""The prefix trie against a plain one: a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lensmark.llm import prefix_trie, queries
from lensmark.llm.common import Scratch


def rebuilt(rows):
    """conv_id, turns of the contract's conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def plain(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for c in range(300):
        for turn in range(int(rng.integers(0, 9)) or (c % 3)):
            out.append((c, turn, ["user", "assistant"][turn % 2], "abé"[int(rng.integers(0, 2 if c % 2 else 1))] * (turn + 1)))
    out += [(401, None, None, None), (401, 3, "user", ""), (401, 3, "user", "tie"), (401, 3, "a", "tie"), (402, -1, "user", "x"), (None, 0, "user", "nobody"), (407, 0, "user", "no base")]
    return out


def got(df):
    return [tuple(r) for r in df.select(prefix_trie.COLUMNS).collect()]


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 40, 1])
def test_query_equals_brute_force(spark, rows, tmp_path, monkeypatch, local):
    """Also where most buckets go through the distributed rounds."""
    where = table(spark, tmp_path, rows)
    real = prefix_trie.prefix_trie
    monkeypatch.setattr(prefix_trie, "prefix_trie", lambda r, s: real(r, s, local))
    found = got(queries.op13_prefix_trie(spark, where))
    assert len(found) == len(set(found))
    assert set(found) == plain(rebuilt(rows))


def test_large_buckets_joined_by_shuffles(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_BUCKETS", 0)
    scratch = Scratch(spark)
    conversations = spark.createDataFrame([r for r in rows if r[0] is not None], "conv_id long, turn long, role string, text string")
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    want = plain({c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()})
    assert set(got(prefix_trie.prefix_trie(prefix_trie.sequences(conversations, scratch), scratch, 30))) == want


def test_long_shared_prefix_and_copies():
    deep = list(range(3000))
    found = [(deep, [1] * 3000, 4, 2, "x"), (deep + [9], [1] * 3001, 1, 1, "y")]
    nodes = prefix_trie.trie_nodes(found, 0)
    assert len(nodes) == 3002
    assert nodes[0][3:7] == [5, 1, 1, 3000 * 4]


def test_empty_table_and_extra_columns(spark):
    scratch = Scratch(spark)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, path int, own string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(none, scratch), scratch).count() == 0
    one = spark.createDataFrame([(3, 0, "user", "hi", 1, "q"), (3, 0, "user", "hi", 1, "q")], none.schema)
    assert [r.depth for r in prefix_trie.prefix_trie(prefix_trie.sequences(one, scratch), scratch).orderBy("depth").collect()] == [0, 1, 2]
