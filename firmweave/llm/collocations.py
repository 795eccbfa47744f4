"""Phrase collocations from depth-truncated suffix trees, partitioned vertically by a memory budget.

1. Words are counted by language; every task sums its own first. Frequent ones get numbers from sorted arrays in the shared
   folder; every text becomes a sequence of numbers, 0 standing for a rare word or the end of a piece. No phrase
   with a rare word can be frequent.
2. A suffix is what starts at one place, cut at ``max_words`` and before a 0. Prefixes are grouped by memory budget: words are taken in
   the order of their arrays until their occurrences reach ``budget``. The prefix of a word that alone passes it
   is lengthened to two words, which are counted in one scan of the numbers and grouped in the same way; pairs that still
   pass it are lengthened to whole suffixes, which are leaves and dealt out by their hash.
3. Suffixes go to the task of their group, equal ones of a task summed up before. It sorts them, which lays out the truncated
   subtrees of its prefixes, and reads the count of every node from the totals of the leaves below it. No group needs another.
4. Cuts of phrases are scored in exact decimals, phrases inside a longer one of at least ``share`` their count go, and the first of each
   language are ranked.

Only ``max_words`` of up to 3 have prefixes of every needed length; a longer one is allowed, but pairs over the budget are then dealt
by their first three words.

Edge cases: a null text is empty, a null language is ``und``; repeated rows count as often as they occur; texts and words may have
any length; an empty table gives no rows; only language and text are read, so other columns may have any name. Equal scores
and counts are ranked by the phrase in UTF-8 byte order. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.llm import arrays
from firmweave.llm.common import prepare
from firmweave.llm.tally import Tally, edges
from firmweave.llm.words import LOWER, chain, hash_spans, mix, text_slices, unmix, word_hash
from firmweave.session import staged

BUDGET = 1_000_000  # suffixes of a group
HELD = 800_000  # suffixes a task sums up before it passes them on
UNKNOWN = "und"

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_U32 = np.uint64(32)
PHRASES = pa.schema([("ids", pa.list_(pa.int64())), ("a", pa.int64()), ("f_first", pa.int64()), ("f_last", pa.int64())])


def sliced(column: pa.Array, langs: list[str]):
    """For each slice of texts: lower-cased bytes, starts and ends of words, their pieces (numbers that grow) and rows, names of (language, word)."""
    known: dict[str, int] = {}
    for first, data, offsets in text_slices(column):
        low = LOWER[data]
        start, end = edges(_WORD[low], offsets)
        row = np.searchsorted(offsets, start, side="right") - 1
        piece = np.concatenate([[0], np.cumsum(_BREAK[low])])[start] + row
        lang = np.array([known.setdefault(x, word_hash(x)) for x in langs[first : first + len(offsets) - 1]], dtype=np.uint64)
        yield low, start, end, piece, first + row, chain([lang[row], hash_spans(low, start, end)])


class Prefixes(NamedTuple):
    """Sorted keys of prefixes with their counts and groups; places are numbers of prefixes."""

    sorted: arrays.Sorted

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, (count, group) = self.sorted.find(keys, (1, 2))
        return place, count, group

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and groups at places that exist."""
        shards = sorted(self.sorted.files)
        before = np.array([self.sorted.files[s][1] for s in shards] or [0])
        asked, back = np.unique(places, return_inverse=True)
        out = [np.zeros(len(asked), dtype=np.int64) for _ in range(2)]
        own = np.searchsorted(before, asked, side="right") - 1
        for i in np.unique(own).tolist():
            here = own == i
            for c in (0, 1):
                out[c][here] = self.sorted.column(shards[i], c + 1)[asked[here] - before[i]]
        return out[0][back], out[1][back]


def group_prefixes(prefixes: DataFrame, level: int, budget: int, name: str) -> tuple[Prefixes, DataFrame]:
    """Sorted arrays of (key, n) rows; and a row for each file: ``shard``, ``before`` (prefixes in earlier files).

    Within a file, prefixes are taken in order into a group until it holds the budget, so the sizes of groups are bounded and
    no group needs to be known to all.
    """
    spark = prefixes.sparkSession
    bits, uri = arrays.bits_for(prefixes.count()), arrays.shared_uri(spark, name)

    def task(rows: pa.Table) -> pa.Table:
        keys, counts = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        light = np.where(counts > budget, 0, counts)
        group = (np.int64(level) << 56) + (np.int64(rows.column("shard")[0].as_py()) << 32) + (np.cumsum(light) - light) // budget
        names = [arrays.save(uri, x.astype(d)) for x, d in zip((keys, counts, group), ("<u8", "<i8", "<i8"))]
        return pa.table({"shard": rows.column("shard").slice(0, 1), "names": pa.array([names], pa.list_(pa.string())), "n_keys": pa.array([len(keys)], pa.int64())})

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    made = staged(prefixes.select("key", "n", shard.alias("shard")).groupBy("shard").applyInArrow(task, "shard int, names array<string>, n_keys bigint"))
    files, before = {}, 0
    for r in made.orderBy("shard").toLocalIterator():
        files[r[0]] = (list(r[1]), before)
        before += r[2]
    if before >= 1 << 32:
        raise ValueError(f"{before} prefixes need more than 32 bits")
    return Prefixes(arrays.Sorted(uri, bits, ("<u8", "<i8", "<i8"), files, [before])), spark.createDataFrame([(s, f[1]) for s, f in files.items()], "shard int, before bigint")


class Suffixes:
    """Suffixes by group, equal ones summed, that a task passes on as one block a group."""

    def __init__(self, depth: int) -> None:
        self.depth, self.held = depth, 0
        self.parts: list[list[np.ndarray]] = []

    def add(self, group: np.ndarray, ids: list[np.ndarray]):
        self.parts.append([group, *ids])
        self.held += len(group)
        if self.held > HELD:
            yield from self.rows()

    def rows(self):
        if self.held:
            group, *ids = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.held = [], 0
            rows, counts = summed([group, *ids])
            for a, b in _runs(rows[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(rows[0][a])], pa.int64()), pa.array([[arrays.pack(x[a:b].astype("<u4")) for x in (*rows[1:], counts)]], pa.list_(pa.binary()))],
                    names=["group", "blob"],
                )


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(x)]))


def _first_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    packed = [*columns[:-2], (columns[-2].astype(np.uint64) << _U32) | columns[-1].astype(np.uint64)]
    order = np.lexsort(packed[::-1])
    columns = [c[order] for c in columns]
    counts = np.ones(len(order), dtype=np.int64) if counts is None else counts[order]
    first = _first_of(columns)
    return [c[first] for c in columns], np.add.reduceat(counts, first) if len(first) else counts


def nodes(ids: list[np.ndarray], counts: np.ndarray, least: int, shortest: int):
    """(words, counts) of every node of at least ``shortest`` words with ``least`` occurrences, given sorted distinct suffixes."""
    for m in range(max(2, shortest), len(ids) + 1):
        use = np.flatnonzero(ids[m - 1])
        if len(use):
            own = [c[use] for c in ids[:m]]
            first = _first_of(own)
            total = np.add.reduceat(counts[use], first)
            keep = total >= least
            yield [c[first[keep]] for c in own], total[keep]


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET):
    """Phrases of 2 to ``max_words`` words with at least ``least`` occurrences, the dictionary, and words of each language.

    Phrases: ``ids`` (numbers of words), ``a``, ``heads`` (counts of its first 1, 2, ... words), ``last`` (count of its last word).
    Dictionary: ``id``, ``lang``, ``word``, ``f``. Languages: ``lang``, ``n``.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        tally = Tally()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for low, start, end, _, row, names in sliced(batch.column(1), langs):
                tally.add(names, low, start, end, langs, row)
                if tally.full():
                    yield from tally.rows()
        yield from tally.rows()

    counted = staged(rows.mapInArrow(count, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")))
    languages = counted.groupBy(F.col("label").alias("lang")).agg(F.sum("n").alias("n"))

    def named(batches):
        for batch in batches:
            langs, found = batch.column(0).to_pylist(), []
            lang = np.array([word_hash(x) for x in langs], dtype=np.uint64)
            for first, data, offsets in text_slices(batch.column(1)):
                found.append(chain([lang[first : first + len(offsets) - 1], hash_spans(data, offsets[:-1], offsets[1:])]))
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found).view(np.int64))], names=["label", "word", "n", "key"])

    frequent = staged(counted.where(F.col("n") >= least).mapInArrow(named, "label string, word string, n bigint, key bigint"))
    words, files = group_prefixes(frequent, 1, budget, "phrase-words")

    def encode(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for _, _, _, piece, _, names in sliced(batch.column(1), langs):
                if len(names):
                    asked, back = np.unique(names, return_inverse=True)
                    ids = (words.find(asked)[0] + 1)[back].astype("<u4")  # 0: rare
                    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([arrays.pack(np.insert(ids, last, 0))], pa.binary())], names=["ids"])

    encoded = staged(rows.mapInArrow(encode, "ids binary"))

    def suffixes(blob: bytes) -> list[np.ndarray]:
        """Numbers of the words of every suffix of two words or more, 0 behind its end."""
        ids = np.append(arrays.unpack(blob, "<u4"), np.zeros(max_words, dtype="<u4"))
        n, out = len(ids) - max_words, []
        for k in range(max_words):
            out.append(ids[k : k + n].copy())
            if k:
                out[k][out[k - 1] == 0] = 0
        whole = out[1] > 0
        return [c[whole] for c in out]

    def pair_key(ids: list[np.ndarray]) -> np.ndarray:
        return mix((ids[0].astype(np.uint64) << _U32) | ids[1].astype(np.uint64))

    def heavy_pairs(batches):
        parts, held = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids = suffixes(blob)
                use = words.at(ids[0].astype(np.int64) - 1)[0] > budget
                parts.append(arrays.sum_by_key(pair_key([c[use] for c in ids[:2]]), [np.ones(int(use.sum()), dtype=np.int64)]))
                held += len(parts[-1][0])
                if held > HELD:
                    yield _pairs(parts)
                    parts, held = [], 0
        if held:
            yield _pairs(parts)

    pairs, over = None, None
    if not frequent.where(F.col("n") > budget).isEmpty():
        extended = staged(encoded.mapInArrow(heavy_pairs, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
        pairs, _ = group_prefixes(extended, 2, budget, "phrase-pairs")
        over = extended.where(F.col("n") > budget)
    leaf_groups = 1 + int(over.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // budget if over is not None else 1

    def route(batches):
        held = Suffixes(max_words)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids = suffixes(blob)
                if not len(ids[0]):
                    continue
                first, group = words.at(ids[0].astype(np.int64) - 1)
                heavy = np.flatnonzero(first > budget) if pairs else []
                if len(heavy):
                    some = [c[heavy] for c in ids]
                    _, n, own = pairs.find(pair_key(some))
                    leaf = chain([c.astype(np.uint64) for c in some[:3]]) % np.uint64(leaf_groups)
                    group[heavy] = np.where(n > budget, (np.int64(3) << 56) + leaf.astype(np.int64), own)
                yield from held.add(group, ids)
        yield from held.rows()

    def tree(found: pa.Table) -> pa.Table:
        blobs = found.column("blob").to_pylist()
        columns = [np.concatenate([arrays.unpack(b[i], "<u4") for b in blobs]) for i in range(max_words + 1)]
        ids, counts = summed(columns[:-1], columns[-1].astype(np.int64))
        return phrase_table(nodes(ids, counts, least, found.column("group")[0].as_py() >> 56))

    def phrase_table(found) -> pa.Table:
        parts = [PHRASES.empty_table()]
        for ids, total in found:
            columns = [pa.array(np.stack(ids, axis=1).astype(np.int64).tolist(), PHRASES.field("ids").type), pa.array(total)]
            ends = [pa.array(words.at(c.astype(np.int64) - 1)[0]) for c in (ids[0], ids[-1])]
            parts.append(pa.Table.from_arrays([*columns, *ends], schema=PHRASES))
        return pa.concat_tables(parts)

    def of_heavy(batches):
        for batch in batches:
            key = unmix(batch.column(0).to_numpy().view(np.uint64))
            ids = [(key >> _U32).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            yield from phrase_table([(ids, batch.column(1).to_numpy())]).to_batches()

    schema = "ids array<bigint>, a bigint, f_first bigint, f_last bigint"
    phrases = encoded.mapInArrow(route, "group bigint, blob array<binary>").groupBy("group").applyInArrow(tree, schema)
    if over is not None:
        phrases = phrases.unionByName(over.mapInArrow(of_heavy, schema))

    def numbered(batches):
        for batch in batches:
            if batch.num_rows:
                ids = words.find(batch.column(3).to_numpy().view(np.uint64))[0] + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns[:3]], names=["id", "lang", "word", "f"])

    return staged(phrases), staged(frequent.mapInArrow(numbered, "id bigint, lang string, word string, f bigint")), languages


def _pairs(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
    keys, (n,) = arrays.sum_by_key(np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][0] for p in parts])])
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def lowest_cut(phrases: DataFrame) -> DataFrame:
    """``ids``, ``a``, ``l``, ``r``, ``score`` of the cut of each phrase that scores lowest; of equal scores the first cut."""
    m, k = F.size("ids"), F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1))).select(
        "ids", "a", "k", F.when(k == 1, F.col("f_first")).alias("l"), F.when(k == m - 1, F.col("f_last")).alias("r"),
        F.slice("ids", 1, k).alias("head"), F.slice("ids", k + 1, m - k).alias("tail"),
    )
    for side, part in (("l", "head"), ("r", "tail")):  # parts of two words or more are phrases themselves
        known = phrases.select(F.col("ids").alias(part), F.col("a").alias(side))
        cuts = cuts.where(F.col(side).isNotNull()).unionByName(cuts.where(F.col(side).isNull()).drop(side).join(known, part))
    whole = F.expr("div(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))), cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = F.min(F.struct(whole.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("ids").agg(F.first("a").alias("a"), best).select("ids", "a", "best.l", "best.r", "best.score")


def without_parts(scored: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """Drops phrases inside a longer one that has at least ``share`` percent of their count."""
    m = F.size("ids")
    places = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: F.slice("ids", i, n))))
    inside = phrases.where(m > 2).select(F.explode(places).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    return scored.join(inside, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


SALTS = 64


def first_of(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each language with their ``rank``: first of each of many parts of a language, then of those."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(SALTS)))
    some = part.withColumn("_place", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= n).drop("_part", "_place")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= n)


def lowest_ranked(scored: DataFrame, n: int) -> DataFrame:
    """``lang``, ``cut``: the (score, a) at which a language has its first ``n`` phrases, ties counted; of fewer phrases the lowest."""
    kinds = first_of(scored.groupBy("lang", "score", "a").agg(F.count("*").alias("times")), [F.desc("score"), F.desc("a")], n)
    before = F.sum("times").over(W.partitionBy("lang").orderBy("rank")) - F.col("times")
    return kinds.withColumn("_before", before).where(F.col("_before") < n).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("cut"))


def mine(
    docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, first: int = 2000, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first phrases of each language."""
    phrases, dictionary, languages = phrase_counts(docs, max_words, least, lang_col, text_col, budget)
    kept = without_parts(lowest_cut(phrases), phrases, share)
    placed = kept.join(dictionary.select(F.col("id").alias("_first"), "lang"), F.col("ids")[0] == F.col("_first")).drop("_first")
    placed = staged(placed)
    # Ties stay until their phrases are known.
    some = staged(placed.join(lowest_ranked(placed, first), "lang").where(F.struct("score", "a") >= F.col("cut")).drop("cut"))
    spelled = some.select("ids", F.posexplode("ids").alias("at", "id")).join(dictionary.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first_of(some.join(spelled, "ids"), [F.desc("score"), F.desc("a"), "phrase"], first)
    return ranked.join(languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
