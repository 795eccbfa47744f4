"""URL filters: rules first, else logistic regression on hashed character n-grams of host and path.

A rule is ``host/path``: it fits its host and all subdomains where the URL's path starts with the rule's; the longest
that fits wins. Rules are a parameter and stay few. The model learns from a small table of URLs with a verdict
(at most ``max_rows``, those with the smallest hash), and judges what no rule fits.

Edge cases: a URL that is null or has no ``://`` has an empty host and path, which no rule fits; a table without both
verdicts trains a model that gives the share of blocks seen, a quarter if none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.llm.common import lower_ascii, prepare
from firmweave.llm.words import mix, text_slices

RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}
BUCKET_BITS, GRAMS, EPOCHS, RATE, RIDGE, MAX_ROWS = 16, (2, 3, 4, 5), 60, 0.5, 1e-4, 5_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) up to ``/ ? #`` and the path up to ``? #``; empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.locate("://", text) > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def parsed(urls: DataFrame, url_col: str = "url", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    host, path = host_and_path(F.col("_u"))
    return urls.select(*carry, F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_u")).select(*carry, host.alias("host"), path.alias("path"))


def rule_for(rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, path = rule.partition("/")
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit("." + own))) & F.startswith(F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and bucket of every distinct character n-gram of each text, and the number of rows."""
    rows, buckets, n_rows = [], [], 0
    for first, data, offsets in text_slices(column):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        value = np.zeros(len(data), dtype=np.uint64)
        for k in range(1, max(GRAMS) + 1):
            with np.errstate(over="ignore"):
                value = value[: len(data) - k + 1] * np.uint64(257) + data[k - 1 :] if len(data) >= k else value[:0]
            if k in GRAMS:
                inside = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if len(data) >= k else np.zeros(0, dtype=np.int64)
                bucket = mix(value[inside] + np.uint64(k << 56)) >> np.uint64(64 - BUCKET_BITS)
                pair = np.unique((row[inside].astype(np.uint64) << np.uint64(BUCKET_BITS)) | bucket)
                rows.append((pair >> np.uint64(BUCKET_BITS)).astype(np.int64) + first)
                buckets.append((pair & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64))
        n_rows = first + n
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), n_rows
    return np.concatenate(rows), np.concatenate(buckets), n_rows


class Model(NamedTuple):
    weights: np.ndarray
    base: float

    def block_probability(self, column: pa.Array) -> np.ndarray:
        row, bucket, n = grams(column)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        return 1 / (1 + np.exp(-np.clip(self.base + np.bincount(row, self.weights[bucket], n) * scale, -30, 30)))


def fit(urls: pa.Array, blocked: np.ndarray) -> Model:
    """Full-batch gradient steps with a step size per weight; the table is small."""
    weights = np.zeros(1 << BUCKET_BITS)
    if len(urls) == 0:
        return Model(weights, float(np.log(0.25 / 0.75)))
    base = float(np.log((blocked.sum() + 0.5) / (len(blocked) - blocked.sum() + 0.5)))
    if blocked.min() == blocked.max():
        return Model(weights, base)
    row, bucket, n = grams(urls)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    squares, base_square = np.full(len(weights), 1e-8), 1e-8
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(base + np.bincount(row, weights[bucket], n) * scale, -30, 30)))
        slope = (p - blocked) / n
        step = np.bincount(bucket, (slope * scale)[row], len(weights)) + RIDGE * weights
        squares += step**2
        weights -= RATE * step / np.sqrt(squares)
        base_square += slope.sum() ** 2
        base -= RATE * slope.sum() / np.sqrt(base_square)
    return Model(weights, base)


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """``labelled``: ``host``, ``path`` and ``verdict``."""
    prepare(labelled.sparkSession)
    few = labelled.select(F.concat("host", "path").alias("u"), "verdict").where("verdict in ('allow', 'block')").distinct()
    few = few.orderBy(F.xxhash64("u", "verdict"), "u", "verdict").limit(max_rows).toArrow()
    return fit(few.column("u").combine_chunks(), np.array([v == "block" for v in few.column("verdict").to_pylist()], dtype=float))


def judge(pages: DataFrame, model: Model, rules: dict[str, str] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds ``rule``, ``p_block`` and ``verdict`` to ``parsed`` rows."""
    prepare(pages.sparkSession)
    kept = pages.schema
    rows = pages.select(F.concat("host", "path").alias("_u"), *pages.columns)

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.block_probability(batch.column(0)))], names=[*kept.names, "p_block"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    scored = rows.mapInArrow(work, f"{fields}p_block double").withColumn("rule", rule_for(rules))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, v) for r, v in rules.items())) if rules else F.lit(None).cast("string")
    return scored.withColumn("verdict", F.coalesce(by_rule, own))
