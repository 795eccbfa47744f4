"""The registered queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmweave.llm import (
    bm25, bpe, collocations, decontaminate, jaccard, langmodel, licenses, linededup, mixing, quality, spelling, suffixes, urlfilter,
)
from firmweave.llm.common import fold, lower_ascii, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small labelled table is what rules decide; the model judges the rest."""
    pages = urlfilter.parsed(table(spark, sf_dir, "pages"))
    verdicts = {v: [r for r, own in urlfilter.RULES.items() if own == v] for v in ("allow", "block")}
    rule = urlfilter.rule_for()
    labelled = pages.withColumn("verdict", F.coalesce(*(F.when(rule.isin(rules), v) for v, rules in verdicts.items())))
    return urlfilter.judge(pages, urlfilter.train(labelled)).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5_decontaminate``, whose twin knows exact matches only, and those of near matches."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near", F.size("near_items").cast("bigint").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7, 2))
    model = langmodel.train(docs, ~F.col("held_out"))
    return langmodel.score(docs, model, carry=("held_out",))


def vocabulary_path() -> str:
    """Where the installed package of public tokenizers keeps the vocabulary that the query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, taken whole as a query."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(bm25.build_index(docs), docs.where(bm25.every_twentieth()))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True)
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of ``pages`` by host."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract(lower_ascii(F.col("url")), "://([^/?#]*)", 1)
    found = linededup.drop_boilerplate(pages, host, linededup.page_lines("html"))
    return found.select(
        "page.page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), F.size("kept").cast("bigint").alias("n_kept"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, ~fold("doc_id", 5, 0))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", fold("doc_id", 5, 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted")
    )


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the repeating weights 5, 2, 1 of their sources, which get alike in the shape of their texts."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), match=mixing.shape())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_url_filter, op3_jaccard_join, op4_suffix_dedup, op5_decontaminate, op5_decontaminate_near, op6_lm_score, op7_topk_search,
        op8_bpe, op9_line_dedup, op10_quality, op11_mix_sources, op12_collocations, op13_spelling_variants,
    )
}


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op3_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 90 * (nx.n + ny.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""

ORACLES["op5_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS ws FROM benchmark),
k AS (SELECT item, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS words
      FROM b WHERE len(ws) > 0),
p AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, (SELECT DISTINCT n FROM k) WHERE len(ws) >= n),
q AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS words FROM p),
h AS (SELECT doc_id, i, n, item FROM q JOIN (SELECT DISTINCT item, n, words FROM k) USING (n, words)),
c AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

ORACLES["op9_line_dedup"] = rf"""
WITH p AS (SELECT page_id, {_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host,
  list_filter(list_transform(regexp_split_to_array(html, '{linededup.BREAKS}'), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS lines FROM pages),
c AS (SELECT host, line, count(*) AS uses FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
g AS (SELECT host, list(line) AS gone FROM c JOIN t USING (host) WHERE uses >= 3 AND uses > 0.2 * pages GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM p LEFT JOIN g USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""

ORACLES["op7_topk_search"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS ws FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, len(ws) AS dl, t, count(*) AS f FROM (SELECT doc_id, ws, unnest(ws) AS t FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS n, greatest(sum(len(ws)), 1) / count(*) AS mean FROM d),
df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
q AS (SELECT doc_id AS query_id, t FROM f WHERE doc_id % 20 = 0),
s AS (SELECT query_id, f.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
      FROM q JOIN f USING (t) JOIN df USING (t), g GROUP BY query_id, f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES["op12_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, list_value(ws[i], CASE WHEN m > 1 THEN ws[i + 1] END, CASE WHEN m > 2 THEN ws[i + 2] END)[1:m] AS g
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT c.*, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
d AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE m = 3),
e AS (SELECT lang, g, max(a) AS longer FROM d GROUP BY ALL),
s AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN e ON e.lang = b.lang AND e.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
