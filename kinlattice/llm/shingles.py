"""Word shingles of a text as sets of 64-bit hashes, and their MinHash signatures (NumPy)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(90_210)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPREAD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at a time, but for words that are longer.
_CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _chunks(data: bytes):
    start = 0
    while start < len(data):
        end = min(len(data), start + _CHUNK)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end]
        start = end


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    out = []
    for data in _chunks(text.encode("utf-8", "replace").lower()):
        raw = np.frombuffer(data, np.uint8)
        edge = np.diff(np.concatenate([[1], _BLANK[raw].view(np.int8), [1]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            continue
        forth, back = _power_tables(max(len(raw), 4096))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * forth[: len(raw)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter sequence is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, _U(size))
    for k in range(size):
        total = total + mix(words[k : len(words) - size + 1 + k] * _SPREAD[k] + _U(k))
        total = (total << _U(7)) | (total >> _U(57))
    return np.unique(mix(total))


def fingerprint(words: np.ndarray) -> tuple[int, int]:
    """128 bits that tell the word sequence, as two signed 64-bit numbers."""
    at = np.arange(len(words), dtype=np.uint64)
    pair = mix(words ^ (at * _SPREAD[60])).sum(dtype=np.uint64), mix(words * _SPREAD[61] + at * _SPREAD[62]).sum(dtype=np.uint64)
    return tuple(int(x.astype(np.int64)) for x in map(np.asarray, pair))


class MinHash:
    """``n`` minima of universal hashes (multiply-add modulo 2**64, the upper 32 bits kept)."""

    def __init__(self, n: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2)

    def signature(self, items: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for k in range(0, len(items), 512):
            least = np.minimum(least, (items[k : k + 512, None] * self.a + self.b).min(axis=0))
        return (least >> _U(32)).astype(np.uint32).view(np.int32)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0
