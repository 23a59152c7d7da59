"""Token shingles of many texts at once, as arrays of hashes."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

#: A token: one Chinese character, or the longest run of other letters and digits, in lower case.
TOKEN = regex.compile(r"[一-鿿]|[[\p{L}\p{N}]--[一-鿿]]+", regex.V1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_kinds: np.ndarray | None = None


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _char_kinds() -> np.ndarray:
    """By code point: 0 no part of a token, 1 part of a run, 2 a token of its own."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)], np.uint8)
        _kinds[0x4E00:0xA000] = 2
    return _kinds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters near values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` tokens, and the number of the text that each is in; in order of the texts.

    Nothing loops over tokens: code points are classed by a table, token hashes are differences of running sums.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _char_kinds()[points]
    before = np.concatenate([[0], kind[:-1]])
    starts = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
    after = np.concatenate([kind[1:], [0]])
    ends = np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1
    power = np.cumprod(np.full(int((ends - starts).max(initial=1)), _BASE, np.uint64))
    # Weight each character by its place in its token.
    place = _places(starts, len(points))
    inside = kind > 0
    weighted = np.zeros(len(points) + 1, np.uint64)
    weighted[1:][inside] = mix(points[inside].astype(np.uint64) + np.uint64(1)) * power[place[inside]]
    sums = np.cumsum(weighted, dtype=np.uint64)
    token = mix(sums[ends] - sums[starts])
    lengths = np.array([len(t) + 1 for t in lowered])
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    count = len(token) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.zeros(count, np.uint64)
    for j in range(width):
        hashed = hashed * _STEP + token[j : j + count]
    whole = owner[:count] == owner[width - 1 :]
    return mix(hashed[whole]), owner[:count][whole]


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(n, np.int64)
    return np.arange(n) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, n)))])
