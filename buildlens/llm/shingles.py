"""Words and shingles of many texts at once, as 64-bit hashes over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Bytes that are handled at once; a longer text is handled alone.
CHUNK = 250_000
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, an odd multiplier and its inverse modulo 2**64.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: White space and ASCII punctuation.
SPACE_OR_MARK = SPACE.copy()
SPACE_OR_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(texts: list[bytes], separators: np.ndarray = SPACE):
    """Yield (first text, word hashes, bounds) for chunks of ``texts``: the words of text
    first + i are those from bounds[i] to bounds[i + 1]. A-Z count as lower case."""
    at = 0
    while at < len(texts):
        upto, n = at, 0
        while upto < len(texts) and (upto == at or n + len(texts[upto]) < CHUNK):
            n += len(texts[upto]) + 1
            upto += 1
        buf = _LOWER[np.frombuffer(b" ".join(texts[at:upto]) + b" ", np.uint8)]
        gap = separators[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        start, end = edge[0::2], edge[1::2]
        forth, back = _power(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * forth[:-1], out=total[1:])
        h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in texts[at:upto]])
        bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        yield at, h, bounds
        at = upto


_STEPS = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**63, 64, dtype=np.uint64)]


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from every word on (shorter at the end: not given)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * _STEPS[i]
    return mix(s)


def whole_hash(h: np.ndarray) -> np.ndarray:
    """One hash for a sequence of fewer than k words, apart from those of k words."""
    s = np.uint64(len(h))
    for i, x in enumerate(h):
        s = s + x * _STEPS[i + 16]
    return mix(np.array([s], np.uint64))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; with fewer than k words the whole
    sequence is one shingle, without words the set is empty."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for _, h, bounds in words(texts):
            s = shingle_hashes(h, k)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= k:
                    own = np.sort(s[a : b - k + 1])
                    keep = np.empty(len(own), bool)
                    keep[0] = True
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    out.append(own[keep])
                elif b > a:
                    out.append(whole_hash(h[a:b]))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out
