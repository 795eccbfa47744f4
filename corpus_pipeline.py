"""Corpus pipeline: ``documents`` in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder
and reads again. All but the last return the columns of ``documents``; the last returns tokens. Further input
columns are left out. No SQL can express the classifier and the tokens, so there is no oracle: the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmweave.llm import bpe, decontaminate, jaccard, linededup, quality
from firmweave.llm.common import fold, table
from firmweave.llm.queries import vocabulary_path
from firmweave.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LINE_RATIO = 0.1
SHINGLE, SIMILARITY = 5, (80, 100)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~fold("doc_id", 5, 0))
    return quality.score(docs, model, carry=tuple(COLUMNS)).where("quality_label = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that over a tenth of their source's different documents hold; a document that had nothing else goes.

    Copies count as one document here: which of them stays is for the next stage to say.
    """
    found = linededup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), linededup.text_lines("text"), LINE_RATIO, copies_once=True)
    text = F.array_join("kept", "\n")
    changed = F.coalesce(F.size("kept") < F.size("lines"), F.lit(False))
    rows = found.select("page.*", text.alias("_text"), changed.alias("_changed")).where(~F.col("_changed") | (F.btrim("_text", F.lit(" \t\r\n")) != ""))
    return rows.select(
        "doc_id", F.when(F.col("_changed"), F.col("_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(F.col("_changed"), F.length("_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are linked at a similarity of 0.8 or more."""
    docs = docs.select(*COLUMNS)
    return jaccard.keep_one(docs, jaccard.cluster(docs, *SIMILARITY, SHINGLE))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten words of a benchmark item."""
    docs = docs.select(*COLUMNS).withColumn("_whole", F.struct(*COLUMNS))
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=("_whole",))
    return found.where("n_hit = 0").select("_whole.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    done = bpe.encode(docs, vocabulary_path(), decoded=True)
    return done.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
