"""Sorted hash arrays in the shared folder, which workers map into memory.

An array set is cut at the top bits of its 64-bit keys into ``2 ** bits`` files, so that the files in order are
one sorted array. Each is made by one task from blocks of counts that other tasks have summed before, and has at
most a few million keys: the number of files follows the data. Files get a new name for each attempt and only
those that a finished task reports are used, so a lost executor leaves nothing wrong behind. Where the shared
folder is no mounted file system, a worker copies a file to its own disk before mapping it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmweave.session import shared_dir, staged

PENDING = 1_200_000  # keys a task holds before it passes them on
PER_FILE = 700_000  # keys a file should have

_OPEN: dict[str, np.ndarray] = {}


def shared_uri(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(uri: str, array: np.ndarray) -> str:
    """Write raw bytes under a new name; returns the name."""
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{folder}/{name}") as out:
        out.write(np.ascontiguousarray(array).data)
    return name


def load(uri: str, dtype: str) -> np.ndarray:
    """The file's numbers, mapped into memory."""
    if uri not in _OPEN:
        store, path = fs.FileSystem.from_uri(uri)
        size = store.get_file_info(path).size
        if not isinstance(store, fs.LocalFileSystem) and size:
            local = os.path.join(tempfile.gettempdir(), uri.rsplit("/", 1)[1])
            if not os.path.exists(local):
                with store.open_input_file(path) as src, open(f"{local}.{os.getpid()}", "wb") as out:
                    while part := src.read(1 << 24):
                        out.write(part)
                os.replace(f"{local}.{os.getpid()}", local)
            path = local
        if len(_OPEN) > 4096:
            _OPEN.clear()
        _OPEN[uri] = np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype=dtype)
    return _OPEN[uri]


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def sum_by_key(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


class Sums:
    """Sums by key that a task passes on as blocks: one row for each file's range of keys."""

    def __init__(self, bits: int, values: int, pending: int = PENDING) -> None:
        self.bits, self.n, self.held, self.pending = bits, values, 0, pending
        self.parts: list[tuple[np.ndarray, list[np.ndarray]]] = []

    def add(self, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(sum_by_key(keys, values))
        self.held += len(self.parts[-1][0])
        if self.held > self.pending:
            keys, values = self.merged()
            if len(keys) > self.pending // 2:
                yield from self.blocks(keys, values)
            else:
                self.parts, self.held = [(keys, values)], len(keys)

    def merged(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.parts:
            return np.zeros(0, dtype=np.uint64), [np.zeros(0, dtype=np.int64)] * self.n
        return sum_by_key(
            np.concatenate([k for k, _ in self.parts]),
            [np.concatenate([v[i] for _, v in self.parts]) for i in range(self.n)],
        )

    def blocks(self, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts, self.held = [], 0
        shard = file_of(keys, self.bits)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else []
        for a, b in zip(cut, [*cut[1:], len(keys)]):
            delta = np.diff(keys[a:b], prepend=np.uint64(0))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([int(shard[a])], pa.int32()),
                "blob": pa.array([[pack(delta), *(pack(v[a:b].astype(np.int64)) for v in values)]], pa.list_(pa.binary())),
            })

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.blocks(*self.merged())


BLOCKS = "shard int, blob array<binary>"


def file_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


class Sorted(NamedTuple):
    """A finished array set. ``files[i]`` has the file of keys and those of values, and the number of keys before it."""

    uri: str
    bits: int
    dtypes: tuple[str, ...]
    files: dict[int, tuple[list[str], int]]
    totals: list[int]

    def column(self, shard: int, i: int) -> np.ndarray:
        return load(f"{self.uri}/{self.files[shard][0][i]}", self.dtypes[i])

    def find(self, keys: np.ndarray, columns: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Place of each key in the whole array (-1: absent) and the values there (0: absent)."""
        asked, back = np.unique(keys, return_inverse=True)
        place = np.full(len(asked), -1, dtype=np.int64)
        out = [np.zeros(len(asked), dtype=self.dtypes[c]) for c in columns]
        shard = file_of(asked, self.bits)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(asked) else []
        for a, b in zip(cut, [*cut[1:], len(asked)]):
            if (s := int(shard[a])) in self.files:
                own = self.column(s, 0)
                at = np.searchsorted(own, asked[a:b])
                at[at == len(own)] = 0
                hit = np.asarray(own[at]) == asked[a:b] if len(own) else np.zeros(b - a, dtype=bool)
                place[a:b] = np.where(hit, at + self.files[s][1], -1)
                for o, c in zip(out, columns):
                    o[a:b] = np.where(hit, np.asarray(self.column(s, c)[at]) if len(own) else 0, 0)
        return place[back], [o[back] for o in out]


def merge_blob_rows(blobs: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sum of several blocks of one shard."""
    keys = np.concatenate([np.cumsum(unpack(b[0], "<u8"), dtype=np.uint64) for b in blobs])
    return sum_by_key(keys, [np.concatenate([unpack(b[i], "<i8") for b in blobs]) for i in range(1, len(blobs[0]))])


def bits_for(keys: int) -> int:
    """Files for so many keys, as a power of two."""
    return max(0, int(np.ceil(np.log2(max(1, keys / PER_FILE)))))


def build(
    blocks: DataFrame,
    bits: int,
    uri: str,
    dtypes: tuple[str, ...],
    totals: Callable[[np.ndarray, list[np.ndarray]], list[int]],
    extra: Callable[[np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]] | None = None,
    keep: Callable[[list[np.ndarray]], np.ndarray] | None = None,
) -> tuple[Sorted, DataFrame]:
    """Sum blocks by key and write one sorted file set for each range of keys.

    ``keep`` picks the sums that are written. ``totals`` are summed over all files. ``extra`` may derive further blocks from each finished range; they come back as a DataFrame. The range of one
    task is bounded (``PER_FILE`` keys on average, and hashes spread evenly), whatever the frequency of a key.
    """

    def task(table: pa.Table) -> pa.Table:
        keys, values = merge_blob_rows(table.column("blob").to_pylist())
        if keep:
            kept = keep(values)
            keys, values = keys[kept], [v[kept] for v in values]
        shard = table.column("shard")[0].as_py()
        names = [save(uri, x.astype(d)) for x, d in zip([keys, *values], dtypes)]
        parts = list(extra(keys, values)) if extra else []
        found = pa.Table.from_batches(parts) if parts else None
        n = 1 + (found.num_rows if found else 0)
        pad = [None] * (n - 1)
        return pa.table({
            "shard": pa.array([shard, *pad], pa.int32()),
            "names": pa.array([names, *pad], pa.list_(pa.string())),
            "n_keys": pa.array([len(keys), *pad], pa.int64()),
            "totals": pa.array([[int(x) for x in totals(keys, values)], *pad], pa.list_(pa.int64())),
            "to_shard": pa.array([None, *(found.column("shard").to_pylist() if found else [])], pa.int32()),
            "blob": pa.array([None, *(found.column("blob").to_pylist() if found else [])], pa.list_(pa.binary())),
        })

    schema = "shard int, names array<string>, n_keys bigint, totals array<bigint>, to_shard int, blob array<binary>"
    made = staged(blocks.groupBy("shard").applyInArrow(task, schema))
    files, before, sums = {}, 0, [int(x) for x in totals(np.zeros(0, dtype=np.uint64), [np.zeros(0, dtype=np.int64)] * (len(dtypes) - 1))]
    # One row for each file.
    for r in made.where("shard is not null").select("shard", "names", "n_keys", "totals").orderBy("shard").toLocalIterator():
        files[r[0]] = (list(r[1]), before)
        before += r[2]
        sums = [x + y for x, y in zip(sums, r[3])]
    return Sorted(uri, bits, dtypes, files, sums), made.where("to_shard is not null").select(F.col("to_shard").alias("shard"), "blob")
