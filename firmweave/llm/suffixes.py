"""Repeated byte strings by a distributed difference-cover algorithm.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere else. Positions of a text that are 1
or 2 modulo 3 are the sample.

1. *Triples and names.* A sampled position is named by its triple of bytes, then by the triple of names 3, 9 and
   27 places apart, and so on to 198 bytes. A name is a 64-bit hash of its triple, so the recursion stays within the
   text; 198 is a multiple of 3, so it stays within the residue.
2. *Sorting the sample.* The names of all sampled positions are sorted over the cluster, in ranges of bounded size;
   those that stand alone drop out.
3. *Merging the rest.* Any two positions i and j have a shift of 0, 1 or 2 that puts both in the sample. So each
   position is keyed, for both shifts that do so, by the bytes before the shifted name, the name and the bytes after
   it, 200 in all. For each shift the keys are sorted; neighbours that are equal are equal strings.
4. Positions with an equal neighbour cover the bytes that go.

Before that, positions that cannot repeat are left out without loss: a string of 200 bytes holds 120 names of 81 bytes,
and the least of them is the same wherever the string stands; where it occurs once in the corpus, so does the string.
Of equal texts, one is sorted and all go whole. Every step counts over all texts; blocks of counts, not texts, move.

Starts that may repeat are found once and go along with the texts as runs.

Edge cases: null texts are empty ones; shorter texts stay; nothing crosses the end of a text; repeated rows are copies; a text of any
length is cut whole, one at a time; NUL bytes are bytes like others; an empty table gives no rows; only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmweave.llm import arrays
from firmweave.llm.common import prepare
from firmweave.llm.words import chain, mix, text_slices
from firmweave.session import staged

LENGTH, GRAM = 200, 81
WINDOW = LENGTH - GRAM + 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SHIFTS = ((1, 2), (0, 1), (0, 2))  # by residue: the shifts that lead into the sample


def _join(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _A + (b ^ (b >> np.uint64(29))) * _B + c * _C
        return (x ^ (x >> np.uint64(32))) * _B


def names(data: np.ndarray) -> np.ndarray:
    """Names of 81 bytes of all positions that have them."""
    n = data.astype(np.uint64) + np.uint64(1)  # no byte is 0, so no name of NUL bytes is either: 0 says that another text begins
    for step in (1, 3, 9, 27):
        if len(n) <= 2 * step:
            return n[:0]
        n = _join(n[: -2 * step], n[step:-step], n[2 * step :])
    return n


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """Best of every ``size`` neighbours, in a few passes: best of the rest of one block and the start of the next."""
    n = len(x) - size + 1
    padded = np.concatenate([x, np.repeat(x[-1:], -len(x) % size)]).reshape(-1, size)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[size - 1 : size - 1 + n])


def least_names(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start of 200 bytes the least name in it (0 where another text begins), and the positions of such names."""
    if len(name) < WINDOW:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    least = _sliding(name, WINDOW, np.minimum)
    least[row[: len(least)] != row[LENGTH - 1 : LENGTH - 1 + len(least)]] = 0
    none = np.zeros(WINDOW - 1, dtype=np.uint64)
    most = _sliding(np.concatenate([none, least, none]), WINDOW, np.maximum)
    return least, np.flatnonzero((most == name) & (name > 0))


def starts_of(data: np.ndarray, offsets: np.ndarray, repeated: arrays.Sorted) -> tuple[np.ndarray, np.ndarray]:
    """Starts of strings whose least name occurs again, and all names."""
    name = names(data)
    least, picked = least_names(name, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
    values = np.unique(name[picked])
    values = values[repeated.find(mix(values))[0] >= 0]
    if not len(values):
        return np.zeros(0, dtype=np.int64), name
    place = np.searchsorted(values, least)
    place[place == len(values)] = 0
    return np.flatnonzero((values[place] == least) & (least > 0)), name


def runs_of(start: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """Each row's starts as runs (first, number), counted from the row's own first byte; None for no starts."""
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])])) if len(start) else np.zeros(0, dtype=np.int64)
    runs = np.stack([start[first] - offsets[row[first]], np.diff(np.append(first, len(start)))], axis=1)
    bound = np.searchsorted(row[first], np.arange(len(offsets)))
    return [runs[a:b].tobytes() if b > a else None for a, b in zip(bound[:-1], bound[1:])]


def starts_from(runs: list[bytes | None], offsets: np.ndarray) -> np.ndarray:
    """The inverse of ``runs_of``."""
    own = [np.frombuffer(r or b"", dtype=np.int64).reshape(-1, 2) for r in runs]
    if not own:
        return np.zeros(0, dtype=np.int64)
    first = np.concatenate([r[:, 0] + o for r, o in zip(own, offsets)])
    size = np.concatenate([r[:, 1] for r in own])
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def long_names(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of 198 bytes."""
    return mix(_join(name[at], name[at + 81], name[at + 117]))


def keys_of(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, name: np.ndarray):
    """Places in ``start``, the long names and the keys, once for each shift into the sample."""
    row_start = offsets[np.searchsorted(offsets, start, side="right") - 1]
    residue = (start - row_start) % 3
    for r, shifts in enumerate(SHIFTS):
        own = np.flatnonzero(residue == r)
        for shift in shifts:
            p = start[own]
            long_name = long_names(name, p + shift)
            outer = [data[p + i] for i in range(shift)] + [data[p + i] for i in range(198 + shift, LENGTH)]
            edge = (outer[0].astype(np.uint64) << np.uint64(8)) | outer[1].astype(np.uint64) | np.uint64(shift << 16)
            yield own, long_name, chain([long_name, edge])


def _bits(df: DataFrame) -> int:
    return arrays.bits_for(df.rdd.getNumPartitions() * 1_000_000)


def _count(df: DataFrame, keys_in, name: str, bits: int) -> arrays.Sorted:
    """Sorted array of the keys that occur at least twice over all texts of ``df``'s first column; a second one has the runs of starts."""
    def work(batches):
        sums = arrays.Sums(bits, 1)
        for batch in batches:
            runs = batch.column(1).to_pylist() if batch.num_columns > 1 else []
            for first, data, offsets in text_slices(batch.column(0)):
                keys = keys_in(data, offsets, starts_from(runs[first : first + len(offsets) - 1], offsets))
                yield from sums.add(keys, [np.ones(len(keys), dtype=np.int64)])
        yield from sums.rest()

    return arrays.build(
        df.mapInArrow(work, arrays.BLOCKS), bits, arrays.shared_uri(df.sparkSession, name), ("<u8",), lambda k, v: [], keep=lambda v: v[0] > 1
    )[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` bytes (null: all of them)."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("text_key"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place"))
    id_type = rows.schema["id"].dataType.simpleString()

    copies = staged(rows.where(F.octet_length("text") >= LENGTH).groupBy("text_key").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n > 1"))
    copy_bits = arrays.bits_for(copies.count())

    def to_blocks(batches):
        sums = arrays.Sums(copy_bits, 1)
        for batch in batches:
            yield from sums.add(mix(batch.column(0).to_numpy().view(np.uint64)), [batch.column(1).to_numpy()])
        yield from sums.rest()

    copied, _ = arrays.build(
        copies.select("text_key", "place").mapInArrow(to_blocks, arrays.BLOCKS), copy_bits, arrays.shared_uri(spark, "suffix-copies"), ("<u8", "<i8"), lambda k, v: []
    )

    def roles(batch) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are copies, and which are sorted for themselves or for their copies."""
        found, (first,) = copied.find(mix(batch.column(1).to_numpy().view(np.uint64)), (1,))
        return found >= 0, (found < 0) | (first == batch.column(3).to_numpy())

    def once(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(roles(batch)[1]))], names=["text"])

    def pick(data, offsets, _):
        name = names(data)
        return mix(name[least_names(name, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))[1]])

    repeated = _count(rows.mapInArrow(once, "text string"), pick, "suffix-least", _bits(rows))

    # Rows without such a name are done; the others keep their text for the sorts.
    def divide(batches):
        for batch in batches:
            copy, sort = roles(batch)
            state = np.where(copy, np.where(sort, 2, 3), 0)
            runs: list[bytes | None] = []
            for _, data, offsets in text_slices(batch.column(0)):
                runs += runs_of(starts_of(data, offsets, repeated)[0], offsets)
            state[(state == 0) & np.array([r is not None for r in runs], dtype=bool)] = 1
            size = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64)
            sha = [b"" if s > 1 else None if s == 1 else t for s, t in zip(state, batch.column(0).cast(pa.binary()).to_pylist())]
            sha = [None if t is None else hashlib.sha256(t).hexdigest() for t in sha]
            needed = pc.if_else(pa.array((state == 1) | (state == 2)), batch.column(0), None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(size), pa.array(np.where(state > 1, size, 0)), pa.array((state > 1).astype(np.int64)), pa.array(sha, pa.string()), pa.array(state),
                 needed, pa.array([r if s in (1, 2) else None for s, r in zip(state, runs)], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "state", "text", "runs"],
            )

    result = f"id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    divided = staged(rows.mapInArrow(divide, f"{result}, state bigint, text string, runs binary"))
    # Whole rows are few or many, so they are dealt evenly.
    sorted_rows = staged(divided.where("state in (1, 2)").select("text", "runs", "id", "n_bytes", "state").repartition(max(rows.rdd.getNumPartitions(), 2)))
    texts, bits = sorted_rows.select("text", "runs"), _bits(rows)

    def sample(data, offsets, start):
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        name = names(data)
        residue = (start - offsets[np.searchsorted(offsets, start, side="right") - 1]) % 3
        return long_names(name, np.unique(np.concatenate([start[residue == r] + s for r in range(3) for s in SHIFTS[r]])))

    sampled = _count(texts, sample, "suffix-sample", bits)

    def merge(data, offsets, start):
        name = names(data) if len(start) else start
        found = [key[sampled.find(long_name)[0] >= 0] for _, long_name, key in keys_of(data, offsets, start, name)] if len(start) else []
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    merged = _count(texts, merge, "suffix-keys", bits + 1)

    def cut(batches):
        for batch in batches:
            n_removed, n_spans, sha, kept = [], [], [], []
            runs = batch.column(1).to_pylist()
            for first, data, offsets in text_slices(batch.column(0)):
                start = starts_from(runs[first : first + len(offsets) - 1], offsets)
                name = names(data) if len(start) else start
                again = np.zeros(len(start), dtype=bool)
                if len(start):
                    for own, _, key in keys_of(data, offsets, start, name):
                        again[own] |= merged.find(key)[0] >= 0
                step = np.zeros(len(data) + 1, dtype=np.int64)
                step[start[again]] += 1
                step[start[again] + LENGTH] -= 1
                gone = np.cumsum(step)[:-1] > 0
                for a, b in zip(offsets[:-1], offsets[1:]):
                    own = gone[a:b]
                    n_removed.append(int(own.sum()))
                    n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                    kept.append(data[a:b][~own].tobytes())
                    sha.append(hashlib.sha256(kept[-1]).hexdigest())
            if sha:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), batch.column(3), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    done = divided.where("state <> 1").withColumn("kept", F.when(F.col("state") > 1, F.lit(b"")))
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    own = sorted_rows.where("state = 1").select("text", "runs", "id", "n_bytes").mapInArrow(cut, f"{result}, kept binary")
    return done.select(*columns).unionByName(own.select(*columns)).withColumnRenamed("id", id_col)
