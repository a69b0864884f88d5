"""Vectorised hashing of words, sentences and shingles over the raw bytes of many texts at once.

A span's hash is a difference of prefix sums of ``value[byte] * B**position`` (mod 2**64), shifted
back by ``B**-start`` and mixed, so every word of a batch is hashed by a few numpy passes.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_VALUES = np.random.default_rng(20250101).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_VALUES = np.random.default_rng(20250202).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.random.default_rng(7).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = min(filled, size - filled)
                have[filled : filled + step] = have[:step] * (have[filled - 1] * base)
                filled += step
        if n <= 1 << 21:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """Hashes of data[start:end] for each span. other: by a second function, independent of the first."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((_OTHER_VALUES if other else _VALUES)[data] * _power("up", BASE, n), out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * _power("down", INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: starts, ends, hashes, and n + 1 offsets into these by text."""
    if lower:
        data = LOWER[data]
    n = len(data)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[data], out=solid[1:-1])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return starts, ends, spans(data, starts, ends), np.searchsorted(starts, offsets)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k items of h, in order; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _MULT[0]
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * _MULT[i] + h[i : i + n]
        return mix(out + np.uint64(k))


def sequence(h: np.ndarray) -> int:
    """One hash of a whole run of any length."""
    with np.errstate(over="ignore"):
        w = mix(h + np.arange(1, len(h) + 1, dtype=np.uint64) * BASE)
        return int(mix(np.array([w.sum(dtype=np.uint64) + np.uint64(len(h))]))[0])


def shingles(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of many texts, repeats kept: hashes, and n + 1 offsets by text.

    h: word hashes; of: n + 1 offsets by text. A text of fewer than k words, but some, has its whole
    sequence as one shingle; one without words has none.
    """
    counts = np.diff(of)
    all_runs = runs(h, k)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(at[-1], np.uint64)
    full = counts >= k
    if full.any():
        m = n[full]
        index = np.repeat(of[:-1][full] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        target = np.repeat(at[:-1][full] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        out[target] = all_runs[index]
    for i in np.flatnonzero((counts > 0) & ~full):
        out[at[i]] = sequence(h[of[i] : of[i + 1]] ^ np.uint64(0x5851F42D4C957F2D))
    return out, at
