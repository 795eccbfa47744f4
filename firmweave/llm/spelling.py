"""Spelling variants: words one edit apart, found in the neighbourhoods of words over a reduced alphabet.

1. Words are counted over all texts; every task sums its own first.
2. Letters are hashed to ``SYMBOLS`` symbols, so that every word gets a reduced form. Words one edit apart have forms at
   most one edit apart.
3. Every distinct form generates its whole one-edit neighbourhood over the symbols. The relation is symmetric, so of two
   neighbouring forms the longer one, or the one with the smaller symbol where they differ, generates the other. Forms
   travel as 64-bit codes that are summed up from prefix sums, so a neighbour costs 16 bytes, whatever the word's length.
4. Neighbours are joined with the forms of the vocabulary, and the forms with their words.
5. Pairs are verified on the words themselves, so an equal code can only cost time.

A word's form is its most frequent near word where that is ``RATIO`` times as frequent, and roots follow forms by pointer
doubling: frequencies double at each step, so chains are short.

Edge cases: a null text is empty, a null id is the empty string in the drawing of deletions; repeated rows count as often as
they occur; an empty table gives no rows; a word of any length is a word. Only id and text are read, so other columns may
have any name. Ties of frequency go to the smallest word in code-point order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmweave.llm.common import prepare
from firmweave.llm.tally import Tally, edges
from firmweave.llm.words import LOWER, hash_spans, mix, text_slices
from firmweave.session import staged

SYMBOLS = 12
RATIO = 2
POSITIONS = 100_000  # letters whose neighbours are made at once

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8, and of no other code point

_POLY = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _POLY = np.where(_POLY & 1, (_POLY >> 1) ^ np.uint32(0xEDB88320), _POLY >> 1).astype(np.uint32)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SIZE = np.uint64(0xD6E8FEB86659FD93)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the runs of letters."""
    low = LOWER[data]
    lead = low == _LEAD
    is_word = _LETTER[low] | lead
    is_word[1:] |= lead[:-1]
    return (low, *edges(is_word, offsets))


def crc32_of(seed: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes after a prefix whose crc32 is ``seed``."""
    out, size = seed.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - start
    left, at = np.arange(len(start)), 0
    while len(left) and at < 64:
        out[left] = _POLY[(out[left] ^ low[start[left] + at]) & np.uint32(255)] ^ (out[left] >> np.uint32(8))
        at += 1
        left = left[size[left] > at]
    out ^= np.uint32(0xFFFFFFFF)
    for i in left.tolist():
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(seed[i]))
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, least_length: int = 5, every: int = 97) -> DataFrame:
    """``word``, ``n``: the runs of letters with at least ``least`` occurrences and ``least_length`` code points.

    Of the occurrences whose crc32 with the id is divisible by ``every`` one letter is left out (0: of none).
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        tally = Tally()
        for batch in batches:
            seeds = np.array([zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()], dtype=np.uint32)
            for first, data, offsets in text_slices(batch.column(1)):
                low, start, end = runs(data, offsets)
                if not len(start):
                    continue
                row = first + np.searchsorted(offsets, start, side="right") - 1
                drawn = np.zeros(len(start), dtype=bool)
                if every:
                    crc = crc32_of(seeds[row], low, start, end)
                    drawn = crc % np.uint32(every) == 0
                    for i in np.flatnonzero(drawn).tolist():
                        word = low[start[i] : end[i]].tobytes().decode()
                        at = int(crc[i]) % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            raw = word.encode()
                            tally.add_word(_name(raw), raw)
                leads = np.concatenate([[0], np.cumsum(low == _LEAD)])
                use = ~drawn & (end - start - (leads[end] - leads[start]) >= least_length)
                start, end = start[use], end[use]
                tally.add(hash_spans(low, start, end), low, start, end)
                if tally.full():
                    yield from tally.rows()
        yield from tally.rows()

    found = rows.mapInArrow(count, "label string, word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def _name(raw: bytes) -> int:
    return int(hash_spans(np.frombuffer(raw, dtype=np.uint8), np.array([0]), np.array([len(raw)]))[0])


class Reduced:
    """Reduced forms of a batch of words: symbols one after the other, and sums of prefixes for their codes."""

    def __init__(self, words: list[str], symbols: int) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.size = size
        with np.errstate(over="ignore"):
            self.symbol = (mix(letters.astype(np.uint64) * _BASE) % np.uint64(symbols)).astype(np.uint64)
            self.owner = np.repeat(np.arange(len(words)), size)
            self.place = np.arange(len(letters)) - self.first[self.owner]
            powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(int(size.max(initial=0)) + 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
            self.power = powers[self.place]
            self.term = (self.symbol + np.uint64(1)) * self.power
            self.before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.term, dtype=np.uint64)])
            self.sum = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def code(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(total + size.astype(np.uint64) * _SIZE)

    def codes(self) -> np.ndarray:
        return self.code(self.sum, self.size)

    def neighbours(self, symbols: int):
        """(own code, neighbour's code) of the half of each neighbourhood that this form generates, itself included."""
        own = self.codes()
        yield own, own
        for a in range(0, len(self.symbol), POSITIONS):
            b = min(a + POSITIONS, len(self.symbol))
            w, s, power = self.owner[a:b], self.symbol[a:b], self.power[a:b]
            with np.errstate(over="ignore"):
                head = self.before[a:b] - self.before[self.first[w]]
                tail = self.sum[w] - head - self.term[a:b]
                same = np.zeros(b - a, dtype=bool)  # a letter like the one before it leaves the same form behind
                same[1:] = (s[1:] == s[:-1]) & (w[1:] == w[:-1])
                yield own[w][~same], self.code(head + tail * _BACK, self.size[w] - 1)[~same]
                for step in range(1, symbols):
                    up = np.flatnonzero(s + np.uint64(step) < symbols)
                    yield own[w[up]], self.code(self.sum[w[up]] + np.uint64(step) * power[up], self.size[w[up]])


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``a``, ``b``: each pair of different words one inserted, deleted or replaced code point apart, once."""
    spark = words.sparkSession
    prepare(spark)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                codes = Reduced(batch.column(0).to_pylist(), symbols).codes()
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), batch.column(0)], names=["code", "word"])

    coded = staged(words.select("word").mapInArrow(encode, "code bigint, word string"))
    forms = coded.groupBy("code").agg(F.min("word").alias("word"))

    def generate(batches):
        for batch in batches:
            if batch.num_rows:
                for own, other in Reduced(batch.column(0).to_pylist(), symbols).neighbours(symbols):
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(other.view(np.int64))], names=["code", "other"])

    codes = forms.select(F.col("code").alias("other"))
    met = staged(forms.select("word").mapInArrow(generate, "code bigint, other bigint").join(codes, "other", "left_semi").distinct())
    one = coded.select("code", F.col("word").alias("a"))
    two = coded.select(F.col("code").alias("other"), F.col("word").alias("b"))
    pairs = met.join(one, "code").join(two, "other").where((F.col("code") != F.col("other")) | (F.col("a") < F.col("b")))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root`` for each of ``word``, ``form``: where following forms ends. Every round doubles the steps taken."""
    now = staged(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        made = staged(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = made.select("word", "root")
        if made.where("moved").isEmpty():
            return now


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, least_length: int = 5, every: int = 97, ratio: int = RATIO,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """One row for each word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = staged(vocabulary(docs, id_col, text_col, least, least_length, every))
    pairs = staged(near_pairs(words, symbols))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    ranked = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = ranked.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has_form = -F.col("best.less") >= ratio * F.col("n")
    formed = staged(words.join(best, "word", "left").select(
        "word", F.when(has_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, -F.col("best.less")).alias("form_n"),
    ))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
