"""Counts of words that a task holds before it passes them on as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD, HELD_BYTES = 250_000, 24 << 20


def edges(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses a row."""
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(is_word))]
    starts[inner] = is_word[inner]
    ends[inner - 1] = is_word[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Tally:
    """Occurrences by (label, word), summed until there are too many words or bytes of words to hold."""

    def __init__(self, most: int = HELD, most_bytes: int = HELD_BYTES) -> None:
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.count: dict[int, int] = {}
        self.word: dict[int, tuple[str | None, bytes]] = {}
        self.size = 0

    def add(self, names: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, labels: list[str | None] | None = None, row: np.ndarray | None = None) -> None:
        """``names`` are 64-bit names of (label, word); ``row`` has the place of each word's label in ``labels``."""
        found, first, times = np.unique(names, return_index=True, return_counts=True)
        count, raw = self.count, low.tobytes()
        for name, i, n, a, b in zip(found.tolist(), first.tolist(), times.tolist(), start[first].tolist(), end[first].tolist()):
            if name in count:
                count[name] += n
            else:
                count[name] = n
                self.word[name] = (labels[row[i]] if labels is not None else None, raw[a:b])
                self.size += b - a

    def add_word(self, name: int, word: bytes) -> None:
        if name not in self.count:
            self.word[name] = (None, word)
            self.size += len(word)
        self.count[name] = self.count.get(name, 0) + 1

    def full(self) -> bool:
        return len(self.count) > self.most or self.size > self.most_bytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        """``label``, ``word``, ``n`` of all that is held; nothing is held after."""
        if self.count:
            held = list(self.word.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.string()), pa.array([x[1] for x in held], pa.binary()).cast(pa.string()), pa.array(list(self.count.values()), pa.int64())],
                names=["label", "word", "n"],
            )
        self.clear()
