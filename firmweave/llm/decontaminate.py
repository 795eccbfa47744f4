"""Benchmark decontamination by a distributed positional inverted index.

1. Every benchmark item becomes windows of consecutive words (one shorter window if it has fewer).
2. One pass over the texts stores the postings of every word that some window holds: text, term, positions.
   Whether a word is such a term is looked up in a sorted hash array that workers map into memory, so neither the
   texts nor the benchmark need to be small.
3. Terms are counted over all postings. A match holds ``need`` = ceil(``share`` x length) of its window's places, so it holds
   at least two (all, if fewer are needed) of the window's length - ``need`` + 2 rarest places. Texts that have as many
   of these at all are looked at: they give the starts where as many stand close, and only those are compared whole.
4. An *exact* match has every term at its place. A *near* match has at least ``share`` of its terms within ``slop`` words of
   their places; starts within ``slop`` of an exact match of the same window are that match and not named again.

Terms, windows and texts are 64-bit hashes. Equal texts are matched once and share their result.

Edge cases: null or wordless texts have no postings, null or wordless items no window; repeated items and rows add
nothing; windows that several items hold count for each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.llm import arrays
from firmweave.llm.common import prepare
from firmweave.llm.words import ALNUM, chain, mix, words
from firmweave.session import staged


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item``, ``window``, ``terms``: every window of every item."""
    prepare(items.sparkSession)

    def work(batches):
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for found in words(batch.column(0), ALNUM):
                rows = []
                for r, (a, b) in enumerate(zip(found.bound[:-1], found.bound[1:])):
                    n = min(size, b - a)
                    if n:
                        for i in range(a, b - n + 1):
                            h = found.hash[i : i + n]
                            rows.append((ids[found.first_row + r], int(chain(list(h[:, None]))[0].view(np.int64)), h.view(np.int64).tolist()))
                if rows:
                    item, window, terms = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item, pa.string()), pa.array(window, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "window", "terms"]
                    )

    texts = items.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("item"))
    return texts.mapInArrow(work, "item string, window bigint, terms array<bigint>").distinct()


def postings(docs: DataFrame, terms: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per input row: the carried columns, ``text_key``, ``n_words`` and the positions of each of the ``terms``."""
    spark = docs.sparkSession
    prepare(spark)

    def to_blocks(batches):
        sums = arrays.Sums(0, 1)
        for batch in batches:
            keys = mix(batch.column(0).to_numpy().view(np.uint64))
            yield from sums.add(keys, [np.ones(len(keys), dtype=np.int64)])
        yield from sums.rest()

    known, _ = arrays.build(
        terms.select("term").distinct().mapInArrow(to_blocks, arrays.BLOCKS), 0, arrays.shared_uri(spark, "terms"), ("<u8", "<i8"), lambda k, v: []
    )
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("_text"), F.xxhash64(text).alias("text_key"), *carry)
    kept = rows.drop("_text").schema

    def work(batches):
        kind = pa.list_(pa.struct([("term", pa.int64()), ("positions", pa.list_(pa.int32()))]))
        for batch in batches:
            n_words, lists = [], []
            for found in words(batch.column(0), ALNUM):
                rows, h = len(found.bound) - 1, found.hash
                n_words.append(np.diff(found.bound))
                row = np.repeat(np.arange(rows), n_words[-1])
                at = np.flatnonzero(known.find(mix(h))[0] >= 0)
                at = at[np.lexsort((at, h[at], row[at]))]
                new = np.concatenate([[True], (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1])]) if len(at) else np.zeros(0, dtype=bool)
                first = np.flatnonzero(new)
                positions = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(at)), pa.int32()), pa.array(at - found.bound[row[at]], pa.int32())
                )
                terms = pa.StructArray.from_arrays([pa.array(h[at][first].view(np.int64)), positions], fields=list(kind.value_type))
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at][first], np.arange(rows + 1)), pa.int32()), terms))
            if lists:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(np.concatenate(n_words), pa.int64()), pa.concat_arrays(lists)], names=[*kept.names, "n_words", "postings"]
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(work, f"{fields}n_words bigint, postings array<struct<term:bigint,positions:array<int>>>")


def matches(index: DataFrame, wanted: DataFrame, slop: int = 2, share: float = 0.8) -> DataFrame:
    """``text_key``, ``window``, ``start``, ``length``, ``exact``, ``near``: every match of the windows in the index."""
    lists = index.select("text_key", F.explode("postings").alias("p")).select("text_key", "p.term", "p.positions")
    rarity = lists.groupBy("term").agg(F.sum(F.size("positions")).alias("uses"))
    places = wanted.select("window", "terms").distinct().select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    places = staged(places.join(rarity, "term"))  # a term no text holds is at no place, and its windows go where too few are left
    need = F.ceil(F.lit(share) * F.col("length")).cast("int")
    some = F.least(need, F.lit(2))
    rank = F.row_number().over(W.partitionBy("window").orderBy("uses", "term", "place"))
    held = F.count("*").over(W.partitionBy("window"))
    ranked = places.withColumn("rank", rank).withColumn("held", held).where((F.col("held") >= need) & (F.col("rank") <= F.col("held") - need + some))
    anchors = staged(ranked.select("window", "length", "term", "place", some.alias("some"), F.expr("shiftleft(1L, rank - 1)").alias("bit")))

    def enough(rows: DataFrame, *keys: str) -> DataFrame:
        found = rows.groupBy("window", "length", "some", *keys).agg(F.bit_or("bit").alias("bits"))
        return found.where(F.bit_count("bits") >= F.col("some")).select("window", "length", *keys)

    def close(place: str):
        expected = F.col("start") + F.col(place)
        return F.exists("positions", lambda x: F.abs(x - expected) <= slop)

    by_term = anchors.groupBy("term", "window", "length", "some").agg(F.bit_or("bit").alias("bit"))  # one row for the places of a repeated term
    pairs = staged(enough(lists.select("text_key", "term").join(by_term, "term"), "text_key"))
    # Copies of a text have one list of a term together.
    single = lists.join(by_term.select("term").distinct(), "term", "left_semi").groupBy("text_key", "term").agg(F.first("positions").alias("positions"))
    shifts = F.array(*(F.lit(d) for d in range(-slop, slop + 1)))
    starts = (
        pairs.select("text_key", "window").join(anchors, "window").join(single, ["text_key", "term"])
        .select("text_key", "window", "length", "some", "place", "bit", "positions").repartition("text_key", "window")  # before rows become many
        .withColumn("at", F.explode("positions")).withColumn("shift", F.explode(shifts))
        .withColumn("start", F.col("at") - F.col("place") + F.col("shift"))
    )
    left = staged(enough(starts, "text_key", "start"))
    # Only texts that are left are taken whole; their keys are written first, so that Spark knows their size.
    texts = staged(left.select("text_key").distinct())
    own = index.join(texts, "text_key", "left_semi").select("text_key", "postings").dropDuplicates(["text_key"])
    own = own.select("text_key", F.explode("postings").alias("p")).select("text_key", "p.term", "p.positions")
    each = left.join(places.select("window", "term", "place"), "window").join(own, ["text_key", "term"])
    counted = each.groupBy("text_key", "window", "length", "start").agg(
        F.sum(F.array_contains("positions", F.col("start") + F.col("place")).cast("int")).alias("exactly"), F.sum(close("place").cast("int")).alias("closely")
    ).where(F.col("closely") >= need)
    exact = F.col("exactly") == F.col("length")
    beside = F.max("exact").over(W.partitionBy("text_key", "window").orderBy("start").rangeBetween(-slop, slop))
    found = counted.withColumn("exact", exact).withColumn("_beside", beside).where(F.col("exact") | ~F.col("_beside"))
    return found.select("text_key", "window", "start", "length", "exact", F.lit(True).alias("near"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", near: bool = False) -> DataFrame:
    """One row per input row: the carried columns, ``n_words``, ``n_hit`` (words inside exact matches), ``items`` (sorted).

    With ``near`` also ``n_near`` (windows that have an exact or near match) and ``near_items`` (their items, sorted).
    """
    wanted = staged(windows(items, size))
    index = staged(postings(docs, wanted.select(F.explode("terms").alias("term")), carry, text_col))
    every = staged(matches(index, wanted) if near else matches(index, wanted, slop=0, share=1.0))
    found = every.where("exact")
    spans = found.select("text_key", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    before = F.max("stop").over(W.partitionBy("text_key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.select("text_key", (F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("fresh"))
    hits = fresh.groupBy("text_key").agg(F.sum(F.greatest("fresh", F.lit(0))).cast("bigint").alias("n_hit"))
    named = found.select("text_key", "window").distinct().join(wanted.select("window", "item"), "window")
    named = named.groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    out = index.drop("postings").join(hits.join(named, "text_key"), "text_key", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint"))).withColumn("items", F.coalesce("items", none))
    if near:
        close = every.select("text_key", "window").distinct().join(wanted.select("window", "item"), "window")
        close = close.groupBy("text_key").agg(F.count_distinct("window").alias("n_near"), F.array_sort(F.collect_set("item")).alias("near_items"))
        out = out.join(close, "text_key", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint"))).withColumn("near_items", F.coalesce("near_items", none))
    return out.drop("text_key")
