"""Words and five-word shingles as 64-bit hashes, for whole texts at numpy's speed.

A word is a run of bytes other than space and tab to carriage return, with A-Z in lower case; bytes
of other characters stay. A word's hash is a polynomial over random numbers of its bytes, taken for
all words at once from running sums; a shingle's hash mixes those of its words in order. Two
different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Bytes hashed at once; a longer text is cut between words.
PART = 1 << 20

#: Multipliers drawn by rule: the golden ratio's fractional part, stepped and made odd.
_STEP = 0x9E3779B97F4A7C15
_ALL = 2**64 - 1
_PLACES = [np.uint64((_STEP * (2 * i + 3) | 1) & _ALL) for i in range(SHINGLE)]
_MIX = [np.uint64((_STEP * k | 1) & _ALL) for k in (11, 29)]
_BASE = (_STEP * 101 | 1) & _ALL
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def _bytes_table() -> np.ndarray:
    table = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP)))
    table[65:91] = table[97:123]  # A-Z as a-z
    return table


_BYTES = _bytes_table()
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown as texts need them."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _powers


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _parts(text: str | None) -> list[np.ndarray]:
    """A text's bytes in parts of about ``PART``, cut between words."""
    codes, out, at = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), [], 0
    while len(codes) - at > PART:
        end = at + PART
        while end < len(codes) and not _SPACE[codes[end]]:
            end += 1
        out.append(codes[at:end])
        at = end
    return [*out, codes[at:]]


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of every word of a text, in order."""
    found = [split_words(part)[0] for part in _parts(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def words_and_endings(text: str | None, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and of its last ``size`` bytes."""
    found = []
    for part in _parts(text):
        h, starts, ends = split_words(part)
        found.append((h, mix(range_hashes(_BYTES[part], np.maximum(starts, ends - size), ends))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def split_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of an array of bytes."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    return mix(range_hashes(_BYTES[codes], starts, ends)), starts, ends


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each range of ``values``, the same wherever the range lies, plus its length."""
    power, inverse = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)


def words_and_endings_of(texts: list[str | None], size: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words_and_endings`` of many texts one after the other, and how many words each text has."""
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    if len(raw) == 1 or sum(map(len, raw)) > 2 * PART:
        found = [words_and_endings(text, size) for text in texts]
        return *(np.concatenate(x) for x in zip(*found, strict=True)), np.array([len(h) for h, _ in found])
    codes = np.frombuffer(b" ".join(raw), np.uint8)
    h, starts, ends = split_words(codes)
    edges = np.cumsum([0, *(len(x) + 1 for x in raw)])
    endings = mix(range_hashes(_BYTES[codes], np.maximum(starts, ends - size), ends)) if len(h) else h
    return h, endings, np.diff(np.searchsorted(starts, edges))


def shingle_hashes(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One hash for each window of ``width`` words, in order; of a shorter text, one for all of it."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    w = min(width, n)
    total = hashes[: n - w + 1] * _PLACES[0]
    for i in range(1, w):
        total = (total ^ (total >> np.uint64(29))) * _PLACES[i] + hashes[i : n - w + 1 + i]
    return mix(total + np.uint64(w))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(shingle_hashes(word_hashes(text)))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a shingle set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
