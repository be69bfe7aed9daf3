"""Vectorised word kernels over the UTF-8 bytes of many documents at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64

#: A-Z become a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes outside of [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes outside of [\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z (after lower-casing) and non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = int(_random.integers(1, 2**63, dtype=np.uint64)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}
#: Powers that are kept, enough for a slice of texts; a longer text has its own made.
_KEPT = (1 << 20) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _KEPT), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) == _KEPT:
            _powers[base] = have
    return have[:n]


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of ``inside`` bytes; no run crosses documents.

    data: lower-cased bytes of all documents; at: their n + 1 offsets.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    hit = inside[data]
    full = at[1:] > at[:-1]
    before = np.empty_like(hit)
    before[0], before[1:] = False, hit[:-1]
    before[at[:-1][full]] = False
    after = np.empty_like(hit)
    after[-1], after[:-1] = False, hit[1:]
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero(hit & ~before)
    ends = np.flatnonzero(hit & ~after) + 1
    return starts, ends, np.searchsorted(at[1:], starts, side="right")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial in the position."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def shingles(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of k words; a document of fewer gives one of all its words."""
    m = len(word)
    if m == 0:
        return word, doc
    total = np.zeros(max(m - k + 1, 0), np.uint64)
    for j in range(k):
        total += word[j : j + len(total)] * _STEP[j]
    whole = doc[: len(total)] == doc[k - 1 :] if len(total) else np.zeros(0, bool)
    value, owner = mix(total[whole]), doc[: len(total)][whole]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, m])
    short = count < k
    if short.any():
        part = np.zeros(int(short.sum()), np.uint64)
        begin, n = first[short], count[short]
        for j in range(k - 1):
            held = n > j
            part[held] += word[begin[held] + j] * _STEP[j]
        part = mix(part + n.astype(np.uint64) * _STEP[63])
        value, owner = np.r_[value, part], np.r_[owner, doc[begin]]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner
