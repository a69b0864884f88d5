"""Byte-level BPE without a regular expression.

Every code point has a class; an apostrophe's and a space's class also says what follows. A class is
a function on the states of a small automaton, the functions that arise by composition form a finite
monoid, and an associative scan over a table of its products gives the state before every code point
of a whole batch, hence where the pre-tokens start. The slices between go through a bounded cache of
merged pairs.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np

# Classes. PREFIX: a space before another kind of character; BLANK: any other white space.
# SHORT and LONG: an apostrophe that can start a contraction of two or three characters.
LETTER, NUMBER, OTHER, SHORT, LONG, PREFIX, BLANK = range(7)
# States. FRESH: the next character starts a pre-token; ONE and TWO: a contraction lacks so many characters.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_PREFIX, ONE, TWO = range(7)
WIDTH = 64


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of each code point, contexts aside: LETTER, NUMBER, OTHER, PREFIX (for U+0020) or BLANK."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if (kind := kinds.get(unicodedata.category(c)[0])) is not None:
            out[i] = kind
        elif c.isspace() and not 0x1C <= i <= 0x1F:
            out[i] = BLANK
    out[0x20] = PREFIX
    return out


def _step(c: int, s: int) -> tuple[int, int]:
    """The state after a character of class c in state s, and whether it starts a pre-token (white space aside)."""
    if c == PREFIX:
        return AFTER_PREFIX, 1
    if c == BLANK:
        return FRESH, 1
    if s == ONE:
        return FRESH, 0
    if s == TWO:
        return ONE, 0
    if c in (SHORT, LONG):
        return (IN_OTHERS, 0) if s in (IN_OTHERS, AFTER_PREFIX) else (ONE if c == SHORT else TWO, 1)
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[c]
    return own, int(s not in (own, AFTER_PREFIX))


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of functions [first, second], function values [function, state], starts [class, state].

    Functions 0 to 6 are those of the classes, 7 to 13 those of a text's first character, 14 the identity.
    """
    steps = [[_step(c, s) for s in range(7)] for c in range(7)]
    known = [tuple(x[0] for x in row) for row in steps]
    known += [(row[FRESH],) * 7 for row in known]
    known.append(tuple(range(7)))
    at: dict[tuple, int] = {}
    for i, f in enumerate(known):
        at.setdefault(f, i)
    i = 0
    while i < len(known):
        for j in range(len(known)):
            for f, g in ((known[i], known[j]), (known[j], known[i])):
                h = tuple(g[x] for x in f)
                if h not in at:
                    at[h] = len(known)
                    known.append(h)
        i += 1
    product = np.array([[at[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    assert len(known) < 256
    return product, np.array(known, np.uint8), np.array([[x[1] for x in row] for row in steps], bool)


def _states(functions: np.ndarray) -> np.ndarray:
    """The state after each element, from FRESH, by a two-level scan."""
    product, values, _ = _monoid()
    n = len(functions)
    rows = -(-n // WIDTH)
    f = np.full(rows * WIDTH, 14, np.uint8)
    f[:n] = functions
    f = np.ascontiguousarray(f.reshape(rows, WIDTH).T)
    for j in range(1, WIDTH):
        f[j] = product[f[j - 1], f[j]]
    total, gap = f[-1].copy(), 1
    while gap < rows:
        total[gap:] = product[total[:-gap], total[gap:]]
        gap *= 2
    before = np.concatenate(([FRESH], values[total[:-1], FRESH])).astype(np.uint8)
    return values[f, before[None, :]].T.ravel()[:n]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each starts."""
    if not (data & 0x80).any():
        return data, np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    out = padded[at].astype(np.uint32)
    for low, keep, tail in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero((out >= low) & (out < low + (0x20 if tail == 1 else 0x10 if tail == 2 else 8)) & (padded[at] >= 0xC0))
        value = padded[at[wide]].astype(np.uint32) & keep
        for i in range(1, tail + 1):
            value = (value << 6) | (padded[at[wide] + i] & 0x3F)
        out[wide] = value + np.uint32(1 << 22)  # marked as done
    return out & np.uint32((1 << 22) - 1), at


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start, in texts that start at offsets[:-1] (and end at offsets[-1])."""
    if not len(data):
        return np.empty(0, np.int64)
    points, at = _code_points(data)
    n = len(points)
    kind = code_point_classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(at, offsets)] = True
    blank = np.zeros(n + 1, bool)
    blank[:-1] = (kind == PREFIX) | (kind == BLANK)
    ends = text_start[1:]  # the text ends after this character
    last = blank[:-1] & ~ends & ~blank[1:]  # the last of its white space, more text follows
    kind[(kind == PREFIX) & ~last] = BLANK
    quotes = np.flatnonzero((points == 0x27) & ~ends)
    if len(quotes):
        one = points[quotes + 1]
        kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        inner = quotes[~ends[quotes + 1]] if len(quotes) else quotes
        inner = inner[inner + 2 < n]
        a, b = points[inner + 1], points[inner + 2]
        pairs = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        kind[inner[pairs]] = LONG
    after = _states(kind + np.uint8(7) * text_start[:-1])
    before = np.empty(n, np.uint8)
    before[0], before[1:] = FRESH, after[:-1]
    before[text_start[:-1]] = FRESH
    starts = _monoid()[2][kind, before]
    previous = np.concatenate(([False], blank[:-2])) & ~text_start[:-1]
    starts[blank[:-1]] = (~previous | last)[blank[:-1]]
    return at[np.flatnonzero(starts)]


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, leftmost of equals, is joined until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair and (least := min(pair)) < none:
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap and a linked list, in n log n steps."""
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or (j := right[i]) < 0 or end[j] != to:
            continue
        end[i], right[i], alive[j] = to, right[j], False
        if right[i] >= 0:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizers_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE in the tokenizers library's JSON: its ids, where merges are listed in order of ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab = {t: i for t, i in model["vocab"].items() if all(c in back for c in t)}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [vocab["".join(m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)):
        raise ValueError("merges are not in order of ids")
    merged = set(order)
    return {bytes(back[c] for c in t): i for t, i in vocab.items() if i in merged or len(t) == 1}


class Merged(dict):
    """Pre-token to what ``make`` makes of it; keeps so many at most, others are made again."""

    def __init__(self, make: Callable[[bytes], object], most: int = 600_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: bytes):
        out = self.make(piece)
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = out
        return out


def merged_texts(data: np.ndarray, offsets: np.ndarray, merged: Merged) -> list[list]:
    """For each text what ``merged`` has for its pre-tokens, in order; the pre-tokens' bytes are slices of data."""
    starts = pretokens(data, offsets)
    buffer, at = data.tobytes(), starts.tolist()
    at.append(len(buffer))
    values = list(map(merged.__getitem__, map(buffer.__getitem__, map(slice, at, at[1:]))))
    cut = np.searchsorted(starts, offsets).tolist()
    return [values[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class AddedTokens:
    """The tokens that the tokenizers library cuts out of a text before all else."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            known = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in known for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.ids = {t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in known}
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) or b"(?!)")

    def merged_texts(self, data: np.ndarray, offsets: np.ndarray, merged: Merged) -> list[list]:
        """merged_texts() with these tokens' packed ids in their places."""
        buffer = data.tobytes()
        if not self.pattern.search(buffer):
            return merged_texts(data, offsets, merged)
        cuts, tokens, owner = [0], {}, []  # ends of parts, ids by part, text by part
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            for m in self.pattern.finditer(buffer, a, b):
                tokens[len(cuts)] = self.ids[m.group()]
                cuts += m.span()
                owner += (i, i)
            cuts.append(b)
            owner.append(i)
        out: list[list] = [[] for _ in offsets[1:]]
        for j, (i, parts) in enumerate(zip(owner, merged_texts(data, np.array(cuts), merged), strict=True)):
            out[i] += [tokens[j]] if j in tokens else parts
        return out
