"""Words of texts as hashes, computed over whole byte arrays at once.

A word is a run of bytes above 0x20 in the text's UTF-8 form, ASCII capitals lowered.
"""

from __future__ import annotations

import numpy as np

_LONGEST = 4096
_BASE = np.uint64(0x100000001B3)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_LONGEST, _BASE, dtype=np.uint64))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes hashed in one go; a cut falls between words.
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = data > 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    letters = _LOWER[data[inside]].astype(np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        values = np.add.reduceat((letters + np.uint64(1)) * _POWERS[place % _LONGEST], first)
    return mix(values + sizes.astype(np.uint64)), starts, ends


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; long arrays are taken in chunks that end between words."""
    if len(data) <= _CHUNK:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and data[end] > 0x20:
            end += 1
        h, s, e = _hashes(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of each ``n`` words in a row; of fewer words, of them all; of none, nothing."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))
