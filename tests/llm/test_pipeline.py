"""Twins of the registered corpus queries and the stages of the pipeline on the smallest driver tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from firmweave.llm import queries
from firmweave.session import staged

SMALL = os.environ.get("FIRMWEAVE_TEST_DIR", entry_point.SMALLEST)
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


def test_all_are_registered():
    names = entry_point.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names and set(queries.ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    done = con.execute(queries.ORACLES[name])
    names = [d[0] for d in done.description]
    cols = sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in done.fetchall())
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == cols
    assert sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect()) == want


def brute_lines(rows, ratio=0.1):
    hosts = {}
    for r in rows:
        hosts.setdefault(r.source, []).append({x.strip(" \t\r\n") for x in (r.text or "").split("\n")} - {""})
    gone = {h: {x for s in sets for x in s if sum(x in o for o in sets) >= 3 and sum(x in o for o in sets) > ratio * len(sets)} for h, sets in hosts.items()}
    return {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\r\n") not in gone[r.source]) for r in rows}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.withColumn("n_hit", F.lit("clash"))
    kept = staged(corpus_pipeline.quality_filter(spark, extra, SMALL))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = labels.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    right = judged.where((F.col("quality") == 1) == F.col("kept").isNotNull()).count()
    assert kept.columns == corpus_pipeline.COLUMNS and right >= 0.95 * labels.count()

    lines = staged(corpus_pipeline.line_dedup(spark, kept, SMALL))
    want = {i: t for i, t in brute_lines(kept.collect()).items()}
    got = {r.doc_id: r.text for r in lines.collect()}
    assert got == {i: t for i, t in want.items() if t.strip() or i in got} and lines.columns == corpus_pipeline.COLUMNS

    near = staged(corpus_pipeline.near_dedup(spark, lines, SMALL))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.encode().lower().split()) for i, t in got.items())}
    left = {r.doc_id for r in near.collect()}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    assert not any(alike(sets[a], sets[b]) for a in left for b in left if a < b)
    for i in set(got) - left:
        assert any(alike(sets[i], sets[j]) for j in got if j != i)

    clean = staged(corpus_pipeline.drop_contaminated(spark, near, SMALL))
    assert 0 < clean.count() <= near.count() and clean.columns == corpus_pipeline.COLUMNS

    tokens = corpus_pipeline.tokens(spark, clean, SMALL)
    assert tokens.count() == clean.count() and tokens.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_empty_and_null_rows_pass_every_stage(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string"
    rows = [(None, None, None, None, None, "x"), (None, "a b", "en", None, 3, "x"), (-1, "", "en", "s", 0, "x"), (-2, "x" * 50_000, "en", "s", 50_000, "x")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SMALL))
            assert docs.count() <= len(rows), name


def test_copies_do_not_make_their_lines_boilerplate(spark):
    page = lambda i: f"menu\nfirst line of {i}\nsecond line of {i}"
    copied = "clean one\nclean two\nclean three"
    texts = [page(i) for i in range(20)] + [copied] * 9 + [copied.replace("\n", " \n\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert got == {i: t.removeprefix("menu\n") for i, t in enumerate(texts)}
    small = docs.where("doc_id < 24")  # four copies beside twenty others
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, small, SMALL).collect()} == set(range(24))
    left = corpus_pipeline.near_dedup(spark, staged(corpus_pipeline.line_dedup(spark, docs, SMALL)), SMALL)
    assert [r.text for r in left.where("doc_id >= 20").collect()] == [copied]
