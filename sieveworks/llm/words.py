"""Vectorised hashing of words, for operators that work on word windows.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. In UTF-8 those six are
single bytes that occur in no other character, so all work is done on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLES: list[np.ndarray] = []
PIECE = 1 << 19


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, PIECE + (PIECE >> 1))
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _TABLES[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b, dtype=_U))]) for b in (_BASE, inverse)]
    return _TABLES


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a byte array."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=total[1:])
        found = (total[ends] - total[starts]) * inverse[starts]
        return starts, mix64(found ^ (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As _hash_piece, in pieces cut at white space, so that memory stays in bounds for long texts."""
    if len(data) <= 2 * PIECE:
        return _hash_piece(np.frombuffer(data, dtype=np.uint8))
    array, at, starts, hashes = np.frombuffer(data, dtype=np.uint8), 0, [], []
    while at < len(array):
        end = min(len(array), at + PIECE)
        while end < len(array):
            space = np.flatnonzero(_SPACE[array[end : end + PIECE]])
            end = end + int(space[0]) if len(space) else min(len(array), end + PIECE)
            if len(space):
                break
        s, h = _hash_piece(array[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def hashed_words(texts: Sequence[bytes], size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, last, hashes, offsets): the words of texts[i] have the hashes
    hashes[offsets[i - first] : offsets[i - first + 1]]."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) < size):
            total += len(texts[last]) + 1
            last += 1
        starts, hashes = hash_bytes(b"\n".join(texts[first:last]))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
        yield first, last, hashes, np.searchsorted(starts, begins)
        first = last


def windows(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` consecutive words; empty if there are fewer."""
    if len(hashes) < length:
        return np.empty(0, dtype=_U)
    multiplier = _U(((0xDA942042E4DD58B5 + 2 * seed * 0x9E3779B97F4A7C15) | 1) & (2**64 - 1))
    with np.errstate(over="ignore"):
        n = len(hashes) - length + 1
        found = hashes[:n].copy()
        for k in range(1, length):
            found *= multiplier
            found += hashes[k : k + n]
        return mix64(found, seed)
