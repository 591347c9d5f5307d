"""Word hashing of whole Arrow text columns without a Python loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are
the runs of ``[^\\x20\\x09-\\x0D]``. A word's hash is a polynomial in its bytes modulo
2**64, taken from one running sum over the column, then scrambled.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C13)  # 3 modulo 4, so that 1 - base loses one bit only
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(4)
def _byte_values(lower: bool) -> np.ndarray:
    of = np.arange(256)
    if lower:
        of = np.where((of >= 65) & (of <= 90), of + 32, of)
    return mix(of.astype(U) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        step = U(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE
        have = np.full(max(n, 1 << 16), step, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 1 << 24:
            _POWERS[inverse] = have
    return have[:n]


class Words(NamedTuple):
    hashes: np.ndarray  # uint64 for each word
    starts: np.ndarray  # byte offsets into data
    ends: np.ndarray
    first: np.ndarray  # for each row the index of its first word, and the end
    data: np.ndarray  # the column's bytes


def words(arr: pa.StringArray, lower: bool = False) -> Words:
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data):
        return Words(np.zeros(0, U), off[:0], off[:0], np.zeros(n + 1, np.int64), data)
    solid = ~_SPACE[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(data))]
    begin[edge] = solid[edge]
    finish[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_byte_values(lower)[data] * powers(len(data)), out=total[1:])
    sums = (total[ends] - total[starts]) * powers(len(data), True)[starts]
    hashes = mix(sums + (ends - starts).astype(U) * U(0xA0761D6478BD642F))
    return Words(hashes, starts, ends, np.searchsorted(starts, off), data)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of width consecutive words within a row, and the index of each run's first word."""
    if len(hashes) < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) + 1, U)
    values = mix(hashes ^ U(salt)) if salt else hashes
    np.cumsum(values * powers(len(hashes)), out=total[1:])
    end = np.repeat(first[1:], np.diff(first))  # of each word's row
    left = np.arange(len(hashes) - width + 1) + width <= end[: len(hashes) - width + 1]
    at = np.flatnonzero(left)
    return mix((total[at + width] - total[at]) * powers(len(hashes), True)[at]), at
