"""Words of Arrow string columns as NumPy arrays: bytes are lower-cased (A-Z only), cut and hashed without a Python loop per word.

Everything here works on slices of about ``SLICE_BYTES`` of text, so that a task's memory follows the longest
single text and not the batch. A word is identified by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words: everything but ASCII white space; or letters, digits and whatever is not ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


_I1, _I2 = np.uint64(pow(int(_C1), -1, 1 << 64)), np.uint64(pow(int(_C2), -1, 1 << 64))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out = x
    for _ in range(64 // by):
        out = x ^ (out >> np.uint64(by))
    return out


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    with np.errstate(over="ignore"):
        x = _unshift(x, 31) * _I2
        x = _unshift(x, 27) * _I1
        return _unshift(x, 30)


class Words(NamedTuple):
    """``hash[bound[r]:bound[r + 1]]`` are the words of row ``r`` of the slice."""

    first_row: int
    hash: np.ndarray
    bound: np.ndarray


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of consecutive slices; a null is an empty text."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        part = offsets[row : end + 1]
        yield row, data[part[0] : part[-1]], part - part[0]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words; a word never crosses a row."""
    low = LOWER[data]
    is_word = kind[low]
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    starts[edge] = is_word[edge]
    ends[edge - 1] = is_word[edge - 1]
    return low, np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``low[start:end]``, eight bytes a step."""
    padded = np.concatenate([low, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(low) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _C3 + (eight[start] & _MASK[np.minimum(size, 8)]))
        left, at = np.flatnonzero(size > 8), 8
        while len(left):
            rest = size[left] - at
            out[left] = mix(out[left] * _C3 + (eight[start[left] + at] & _MASK[np.minimum(rest, 8)]))
            at += 8
            left = left[rest > 8]
    return out


def words(column: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    for row, data, offsets in text_slices(column):
        low, start, end = spans(data, offsets, kind)
        yield Words(row, hash_spans(low, start, end), np.searchsorted(start, offsets))


def word_hash(text: str | bytes) -> int:
    """The hash of one word, for tests and small tables."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, dtype=np.uint8)
    return int(hash_spans(LOWER[raw], np.array([0]), np.array([len(raw)]))[0])


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of words, given the words of its first, second, ... place."""
    with np.errstate(over="ignore"):
        out = mix(hashes[0] + _C3)
        for h in hashes[1:]:
            out = mix(out * _C3 + h)
    return out
