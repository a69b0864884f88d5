"""Byte-level BPE against its library; packing against its contract."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lensmark.llm import bpe, packing, tokens
from lensmark.llm.common import pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tiktoken_ranks(RANKS), special_tokens={})


def odd_texts(n=3000, seed=4):
    rng = random.Random(seed)
    alphabet = " \n\t'strevelmdLAZ09!?.é中  \x1c\x85''½²\U0001f600ǅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return texts + ["", "'s", "''s", " 's", "we've I'll x'l 'lx 'rex", "\n's  y", "a  \n", "  ", "<|endoftext|>", "a" * 3000, "x'" * 400, "é" * 300, " " * 99 + "b"]


def test_pretokens_are_the_pattern_matches(library):
    ranks, merged = bpe.tiktoken_ranks(RANKS), None
    merged = bpe.Merged(lambda p: bpe.merge_pairs(p, ranks), 50)
    texts = odd_texts()
    for first, end, data, offsets in pieces(pa.array(texts), 5000):
        for i, parts in enumerate(bpe.merged_texts(data, offsets, merged)):
            assert [x for p in parts for x in p] == library.encode_ordinary(texts[first + i])
    assert end == len(texts) and len(merged) <= 50


def test_both_files_have_the_same_ranks():
    assert bpe.tokenizers_ranks(JSON) == bpe.tiktoken_ranks(RANKS)


def test_encode_and_decode(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(odd_texts(200))] + [(None, None, "x"), (5, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode(df, RANKS, with_ids=True)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        at = np.cumsum([0, *(len(library.decode_single_token_bytes(x)) for x in ids)])[:-1].tolist()
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, at))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted((r[1] for r in tokens.decode(got, RANKS).collect())) == sorted(t or "" for _, t, _ in rows)
    part = got.filter("doc_id IS NOT NULL").selectExpr("doc_id", "slice(ids, 2, 5) ids", "slice(offsets, 2, 5) offsets")
    by = {(i, t): library.decode_bytes(library.encode_ordinary(t or "")[1:6]).decode("utf-8", "replace") for i, t, _ in rows if i is not None}
    assert sorted(map(tuple, tokens.decode(part, RANKS).collect())) == sorted((i, x) for (i, _), x in by.items())
    assert tokens.encode(df.limit(0), RANKS).count() == 0


def whole(histogram, capacity=2048):
    rows, n = packing.plan(dict(histogram), capacity)
    ranks, sequences = {}, {}
    for length, low, end, first, each, offset in rows:
        ranks.setdefault(length, []).append((low, end))
        for k in range(end - low):
            sequences.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for length, count in histogram.items():
        at = 0
        for low, end in sorted(ranks[length]):
            assert low == at < end
            at = end
        assert at == count
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == n
    return n


def best_fit_alone(histogram, capacity=2048):
    """Sequences of best fit, longest first."""
    rooms, n = Counter(), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room, n = capacity, n + 1
            else:
                rooms[room] -= 1
                rooms += Counter()
            rooms[room - length] += 1
    return n


def test_plan_places_all_and_wastes_little():
    rng = np.random.default_rng(0)
    for n, slack in ((1, 1), (30, 1.2), (3000, 1.002), (40000, 1.0005)):
        lengths = (np.clip(rng.lognormal(6.5, 0.9, n).astype(int), 1, None) - 1) % 2048 + 1
        least = -(-int(lengths.sum()) // 2048)
        used = whole(Counter(lengths.tolist()))
        assert used <= max(least + 1, slack * least)
        assert n < 40000 or used <= best_fit_alone(Counter(lengths.tolist()))
    assert whole({700: 1000}) == 500 and whole({1: 5}) == 1 and whole({1500: 100, 300: 7}) == 100 and whole({2048: 3}) == 3
    assert packing.plan({}, 2048) == ([], 0)


def test_plan_needs_no_more_sequences_than_best_fit():
    rng = np.random.default_rng(1)
    for n, low, high in ((200, 1, 2048), (1500, 300, 1400), (1500, 600, 1100), (800, 1, 300)):
        lengths = Counter(rng.integers(low, high, n).tolist())
        assert whole(lengths) <= best_fit_alone(lengths)


def test_pack_against_the_library(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdef gh\n é") for _ in range(rng.choice((3, 90, 900, 9000)))), "c") for i in range(60)] + [(None, None, "c"), (3, "", "c"), (9, "same", "c"), (10, "same", "c")]
    rows += [(20 + i, t, "c") for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|", "x\n<|endoftext|>  c d" * 700])]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = packing.pack(df, JSON)
    library = Tokenizer.from_file(JSON)
    want, total = [], 0
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at, size, j = 0, (len(ids) - 1) % 2048 + 1, 0
        while at < len(ids):
            want.append((i, j, at, size, zlib.crc32(struct.pack(f"<{size}I", *ids[at : at + size]))))
            at, size, j = at + size, 2048, j + 1
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.1 * total / 2048 + 1
    assert packing.pack(df.limit(0), JSON).count() == 0
