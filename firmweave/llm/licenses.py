"""Licence scans by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of a text is hashed. Pairs that no template holds are left out within the row (an IN
list); the rest are joined to template positions on hash and words. A hit at word p of the text and q of the template
votes for diagonal p - q. Votes are counted per diagonal, diagonals that follow each other closely are merged (words
put in or left out shift the diagonal), and a span counts if the distinct pairs it covers are ``share`` of the
template's. A phrase's places are its full diagonals. Templates are a parameter and stay few.

Edge cases: a null text is an empty one; equal texts are matched once; a phrase may stand at many places; phrases of one word are refused; a
text of any length is read whole; an empty table gives no rows; of other columns only the carried ones are read, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.llm.common import lower_ascii
from firmweave.session import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "subject to the terms of the mozilla public license": "mpl",
    "released into the public domain": "public-domain",
}


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, share: float = 0.8,
    drift: int = 2, gap: int = 6, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text",
) -> DataFrame:
    """One row per input row: the carried columns, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    plans = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in templates.items()]
    if short := [t for t, _, _ in plans if len(t.split()) < 2]:
        raise ValueError(f"phrases and templates need two words or more, unlike {short}")
    positions = [
        (i, label, base, len(t.split()) - 1, q, " ".join(pair))
        for i, (t, label, base) in enumerate(plans) for q, pair in enumerate(zip(t.split(), t.split()[1:]))
    ]
    template = spark.createDataFrame(positions, "template int, label string, base boolean, pairs int, q int, pair string")
    pairs = sorted({p[-1] for p in positions})
    hashes = [r[0] for r in spark.createDataFrame([tuple(p.split()) for p in pairs], "a string, b string").select(F.xxhash64("a", "b")).collect()]

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(*carry, F.xxhash64(text).alias("text_key"), F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)).alias("words"))
    rolled = F.transform("words", lambda w, p: F.xxhash64(w, F.get("words", p + 1)))
    known = F.filter(F.transform(rolled, lambda h, p: F.when(h.isin(hashes), p)), lambda p: p.isNotNull())
    hits = F.transform(known, lambda p: F.struct(p.alias("p"), F.concat_ws(" ", F.get("words", p), F.get("words", p + 1)).alias("pair")))
    found = staged(read.select(*carry, "text_key", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits")))

    votes = (
        found.where(F.size("hits") > 0).select("text_key", F.explode("hits").alias("h")).select("text_key", "h.p", "h.pair").distinct()
        .join(F.broadcast(template), "pair")  # as many rows as the templates have words
        .groupBy("text_key", "template", "label", "base", "pairs", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.collect_set("q").alias("q"), F.min("p").alias("first"), F.max("p").alias("last"))
    )
    votes = staged(votes)
    base = votes.where(F.col("base") & (F.size("q") == F.col("pairs"))).groupBy("text_key").agg(
        F.count("*").alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("base_list"),
    )
    order = W.partitionBy("text_key", "template").orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > drift) | (F.col("first") - F.lag("last").over(order) > gap)
    merged = (
        votes.where(~F.col("base")).withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order))
        .groupBy("text_key", "template", "label", "pairs", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("q")))).alias("covered"))
        .groupBy("text_key", "label").agg(F.max(F.col("covered") / F.col("pairs")).alias("share"))
    )
    spans = merged.groupBy("text_key").agg(
        F.max("share").alias("best"), F.array_compact(F.collect_list(F.when(F.col("share") >= share, F.col("label")))).alias("span_list")
    )
    empty = F.array().cast("array<string>")
    both = base.join(spans, "text_key", "full").select(
        "text_key", "n_base", "first_word", "last_word", F.coalesce("base_list", empty).alias("base_list"),
        F.array_sort(F.array_union(F.coalesce("base_list", empty), F.coalesce("span_list", empty))).alias("all_list"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"),
    )
    return found.drop("hits").join(both, "text_key", "left").select(
        *carry, "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"), F.coalesce(F.array_join("base_list", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all_list", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
