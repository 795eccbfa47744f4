"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and counts of a whole text. Training looks at a bounded sample of labelled rows
(``max_rows``, those with the smallest hash of the id), fits one shallow tree a feature and round in turn, adds the
trees up in one look-up table per feature, then does the same for the pairs whose best fourfold split explains
most of what is left. Scoring cuts each feature into bins and adds table entries.

Edge cases: a null text is an empty one, whose features are all 0; a null id has no label and is not held out;
an id with labels that disagree is not learned from; without labels every score is 0.5.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.llm.common import give_back, prepare
from firmweave.llm.words import NOT_SPACE, chain, hash_spans, spans, text_slices

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "stop_share", "mark_share", "symbol_share", "other_share",
    "newline_share", "distinct_words", "distinct_triples", "repeated_next", "symbol_words", "short_words",
)
MAX_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 60, 30, 6, 0.2, 1.0

_KIND = np.zeros((6, 256), dtype=bool)
_KIND[0, 65:91] = True
_KIND[1, 48:58] = True
_KIND[2, [*b".,"]] = True
_KIND[3, [*b"!?;:'\"()-"]] = True
_KIND[4, [c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,!?;:'\"()-"]] = True
_KIND[5, 128:] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[offsets])


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, dtype=bool)
    return np.bincount(r[new], minlength=rows)


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, data, offsets in text_slices(column):
        rows, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
        low, start, end = spans(data, offsets, NOT_SPACE)
        bound = np.searchsorted(start, offsets)
        n = np.diff(bound)
        some = np.maximum(n, 1)
        row = np.repeat(np.arange(rows), n)
        h = hash_spans(low, start, end)
        kinds = [_per_row(k[data], offsets) / size for k in _KIND]
        odd = np.concatenate([[0], np.cumsum(_KIND[4][data] | (data == 33), dtype=np.int64)])
        triple = np.flatnonzero(row[2:] == row[:-2]) if len(h) > 2 else np.zeros(0, dtype=np.int64)
        keys = chain([h[triple], h[triple + 1], h[triple + 2]])
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out.append(np.column_stack([
            np.log1p(n), _per_row(NOT_SPACE[data], offsets) / some, *kinds, _per_row(data == 10, offsets) / size,
            _distinct(h, row, rows) / some, _distinct(keys, row[triple], rows) / np.maximum(np.bincount(row[triple], minlength=rows), 1),
            np.bincount(row[1:][same], minlength=rows) / some, np.bincount(row[odd[end] > odd[start]], minlength=rows) / some,
            np.bincount(row[end - start <= 2], minlength=rows) / some,
        ]))
    return np.concatenate(out)


class Model(NamedTuple):
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            total += t[b]
        for a, b, t in self.pairs:
            total += t[_coarse(bins[a], self.edges[a]), _coarse(bins[b], self.edges[b])]
        return 1 / (1 + np.exp(-total))


def _coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(edges) + 1)


def _steps(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a tree of so many levels over ordered bins, given sums of gradients and curvatures."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    if depth and len(g) > 1:
        left, right = cg[:-1] ** 2 / (ch[:-1] + RIDGE), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE)
        cut = int(np.argmax(left + right)) + 1
        if left[cut - 1] + right[cut - 1] > cg[-1] ** 2 / (ch[-1] + RIDGE) + 1e-9:
            return np.concatenate([_steps(g[:cut], h[:cut], depth - 1), _steps(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), cg[-1] / (ch[-1] + RIDGE))


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best split of a grid into four by one cut of each side, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    gain = sum(p**2 / (q + RIDGE) for p, q in zip(parts(cg), parts(ch)))
    if not gain.size:
        return np.zeros(g.shape), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    a, b, d, e = (p[i, j] / (q[i, j] + RIDGE) for p, q in zip(parts(cg), parts(ch)))
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = a, b, d, e
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting; rows are the bounded sample."""
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(x):
        return Model(edges, base, tables, [])
    bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for b, t in zip(bins, tables):
            g, h = slopes()
            step = RATE * _steps(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), 2)
            t += step
            total += step[b]
    grids = [_coarse(b, e) for b, e in zip(bins, edges)]
    shape = [min(PAIR_BINS, len(t)) for t in tables]
    wide = [int(_coarse(np.array([len(e)]), e)[0]) + 1 for e in edges]

    def grid(a, b, v):
        return np.bincount(grids[a] * wide[b] + grids[b], v, wide[a] * wide[b]).reshape(wide[a], wide[b])

    g, h = slopes()
    gains = sorted(
        ((-_quarters(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(len(edges)) for b in range(a) if min(shape[a], shape[b]) > 1)
    )
    pairs = [(a, b, np.zeros((wide[a], wide[b]))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in pairs:
            g, h = slopes()
            step = RATE * _quarters(grid(a, b, g), grid(a, b, h))[0]
            t += step
            total += step[grids[a], grids[b]]
    return Model(edges, base, tables, pairs)


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows (``labels``: id and ``quality`` 0/1) for whose id ``use`` holds."""
    prepare(docs.sparkSession)
    known = (
        labels.where(use if use is not None else F.lit(True)).where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
        .orderBy(F.xxhash64(id_col), id_col).limit(max_rows).select(F.col(id_col).alias("_id"), F.col("quality").cast("double").alias("_y"))
    )
    # At most max_rows pairs of numbers are broadcast, and as many rows of features come back.
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("_id")).join(F.broadcast(known), "_id")

    def work(batches):
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])
        give_back()

    found = texts.select("text", F.col("_id").cast("string").alias("id"), "_y").mapInArrow(work, "id string, y double, x array<double>")
    found = found.orderBy(F.xxhash64("id"), "id", F.xxhash64("x")).limit(max_rows).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, found.column("y").to_numpy())


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: the carried columns, ``quality_score`` and ``quality_label`` (1: at or above the threshold)."""
    prepare(docs.sparkSession)
    # A text that is carried goes to the workers once.
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *[c for c in carry if c != text_col])
    kept = docs.select(*[F.col(c).cast("string") if c == text_col else F.col(c) for c in carry]).toDF(*carry).schema
    places = [0 if c == text_col else rows.columns.index(c) for c in carry]

    def work(batches):
        for batch in batches:
            p = model.score(features(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), pa.array(p), pa.array(p >= threshold).cast(pa.int32())], names=[*kept.names, "quality_score", "quality_label"]
            )
        give_back()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(work, f"{fields}quality_score double, quality_label int")
