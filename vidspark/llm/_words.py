"""Word hashes of whole Arrow batches, without a Python loop over words.

A word is a longest run of ``[0-9a-z]`` and code points from U+0080 on, after A-Z were lower-cased.
"""

from __future__ import annotations

import numpy as np

from ._common import mix

#: Bytes handled at a time; the scratch arrays take about 30 times as much.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return word[lower], mix(lower.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))


_IS_WORD, _VALUE = _tables()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        have = _power(_BASE, size), _power(_INVERSE, size)
        if size <= CHUNK + 1:
            _powers[0] = have
    return have


def _part(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    up, down = _powers_to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and where each text's words begin (one more than texts)."""
    hashes, bounds, at, base = [], [np.zeros(1, np.int64)], 0, 0
    n = len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        got, where = _part(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        hashes.append(got)
        bounds.append(where[1:] + base)
        base += len(got)
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words of one text; of all its words if it has fewer but some."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    k = len(hashes) - n + 1
    out = np.full(k, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[i : i + k]
    return mix(out)


def stretch_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of words hashes[start:end], wherever it stands, from running sums of both."""
    up, down = _powers_to(len(hashes) + 1)
    out = []
    for values in (hashes, mix(hashes ^ np.uint64(0xA24BAED4963EE407))):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(values * up[: len(hashes)], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]
