"""Registered queries: page signals, classification, finding sites, filings.

The word lists below stand in for the Swedish defaults, so that the driver's invented pages hit every branch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.operators import classify, filings, pages as pg
from firmweave.plans.adapters import adapter, ctes, sql
from firmweave.plans.finance_queries import keyed
from firmweave.session import staged

QUALITY = pg.QualityWords(
    cta=("the ", "of ", "que ", "der ", "thth"), services=("/the", "/in", "/de", "/que", "/der"), address=("adress", "thth"),
    platforms=("track(1)", "track(2", "wp-content"), contact="kontakt",
)
PARKED_STRONG, PARKED_WEAK = ("spam-farm", "theshth"), ("thth", "ththe", "eaux", "zuein")
TECH = pg.TechWords(
    categories=(("thth", "ouou"), (" und ",), (" que ",), ("nderst",)), mail=("eaux",), cloud=("losón", "ththe"),
    support_strong=("ndthe",), support_medium=("erer",),
)
LINKS = pg.LinkWords(hints=("/the", "/de", "/in", "/un"), job_paths=("/de", "/que"), job_queries=("page=",), job_domains=("example.net",))
HIRING = pg.HiringWords(
    keywords=("thth", "quequ", " und "), triggers=(r"of\s+", r"that\s+"), fillers=("the", "la", "and"), generic=("a", "it"), links=LINKS
)
DICTIONARY = (
    classify.Category("english", "Eng", ("the ", "that ", "with ", "from ", "this ")),
    classify.Category("french", "Fra", (" les ", " une ", " dans ", " pour ", "eaux")),
    classify.Category("german", "Deu", (" und ", " der ", " nicht ", "für ", "ung")),
    classify.Category("spanish", "Spa", (" los ", " las ", " por ", " que ", "ción")),
    classify.Category("short", "Sho", ("ti", "on", "ou")),
    classify.Category("accent", "Acc", ("é", "ü", "ó", "ñ", "ß")),
)
def _pick(values, number: str) -> str:
    """One of the values by number, in SQL of both engines."""
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# Pages with the default words, in text, tags, addresses, scripts and comments.
_WORDS = (
    *fv.CTA_WORDS, *fv.SERVICE_HINTS, *fv.PLATFORM_MARKS, *fv.PARKED_STRONG, *fv.PARKED_WEAK, *(w for ws in fv.PRODUCT_CATEGORIES.values() for w in ws), *fv.MAIL_WORDS,
    *fv.CLOUD_RESOURCE_HINTS, *fv.IT_SUPPORT_STRONG, *fv.IT_SUPPORT_MEDIUM,
)
_PATHS = tuple(f"/{h.strip('/')}/a" for h in (*fv.CAREER_PATH_HINTS, *fv.JOB_PATHS, "spontan", "jobb/spontan", "om-oss", "tjanst", "vara-tjanster"))
SWEDISH_PAGES = f"""
SELECT concat('s', cast(cast(floor(k / 2) AS bigint) AS string), '.se') AS site_key, k AS page_order,
  concat(CASE WHEN k % 3 = 0 THEN 'http' ELSE 'https' END, '://s', cast(cast(floor(k / 2) AS bigint) AS string), '.se/p') AS url,
  concat('<HTML><body>', {_pick(_WORDS, 'k')}, ' <b class="', {_pick(_WORDS, 'k * 7 + 3')}, '">', upper({_pick(_WORDS, 'k * 13 + 5')}), '</b> ', {_pick(_WORDS, 'k * 17 + 1')},
    '<script>teams azure ', {_pick(_WORDS, 'k * 3')}, '</script><!-- ', {_pick(_WORDS, 'k * 5')}, ' -->', CASE WHEN k % 4 = 0 THEN repeat('ord ', 260) ELSE ' < ' END,
    CASE WHEN k % 5 = 0 THEN '<img src="a"><IMG><img>' WHEN k % 5 = 1 THEN ' ring 08-123 45 67 ' ELSE '' END, CASE WHEN k % 6 = 0 THEN ' 556677-8899 ' ELSE '' END,
    '<a href="', {_pick(_PATHS, 'k')}, '">x</a> <a HREF="', {_pick(_PATHS, 'k * 11 + 2')}, '">', {_pick(_WORDS, 'k * 29')}, '</a> <a href="#', {_pick(_PATHS, 'k')}, '">') AS html
FROM (SELECT c_custkey AS k FROM customer) c"""
# A dictionary table of 28 categories: passages of the texts themselves, of 1 to 12 letters; some are in two categories.
KEYWORDS = """
SELECT DISTINCT cast(c % 28 AS int) AS position, concat('category_', cast(c % 28 AS string)) AS label, concat('Category ', cast(c % 28 AS string)) AS raw, keyword
FROM (SELECT doc_id AS c, substring(lower(text), cast(1 + doc_id % 50 AS int), cast(5 + doc_id % 8 AS int)) AS keyword FROM documents
  UNION ALL SELECT doc_id + 1, substring(lower(text), cast(1 + doc_id % 50 AS int), cast(5 + doc_id % 8 AS int)) FROM documents WHERE doc_id % 9 = 0
  UNION ALL SELECT doc_id, substring(lower(text), 30, cast(1 + doc_id % 3 AS int)) FROM documents WHERE doc_id % 40 = 0) k
WHERE keyword <> ''"""
SECTORS = {"english": "it_sector", "french": "construction_sector", "german": "finance_sector", "spanish": "retail_sector"}
TEXTS = """
SELECT doc_id, lower(text) AS text, CASE doc_id % 6 WHEN 0 THEN 'Byggentreprenad' WHEN 1 THEN '__NO_SNI__' WHEN 2 THEN 'IT-drift' WHEN 3 THEN '' WHEN 4 THEN 'Handel' END AS register_text
FROM documents"""
SEGMENT_ROWS = """
SELECT cast(5500000000 + c_custkey AS string) AS orgnr,
  CASE c_custkey % 7 WHEN 0 THEN 'Software ' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL WHEN 3 THEN 'legal' WHEN 4 THEN 'dental' WHEN 5 THEN 'real_estate' ELSE 'brewing' END AS line_of_work,
  CASE c_custkey % 5 WHEN 0 THEN 'Bygg och VVS' WHEN 1 THEN '__NO_SNI__' WHEN 2 THEN 'Programvara, it' WHEN 3 THEN NULL ELSE 'Detaljhandel i butik' END AS sni_text,
  CASE c_custkey % 4 WHEN 0 THEN 'zebra, it_sector' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'agri_sector' END AS segment_groups
FROM customer"""
ROLES = """
SELECT c_custkey AS role_id, concat(CASE c_custkey % 8 WHEN 0 THEN 'DevOps engineer ' WHEN 1 THEN 'Ekonomi- och lön ' WHEN 2 THEN 'Säljare, marketing ' WHEN 3 THEN 'Support developer python '
  WHEN 4 THEN 'Snickare ' WHEN 5 THEN 'Poet ' WHEN 6 THEN 'HR ' ELSE 'Security risk tekniker ' END, lower(c_mktsegment)) AS role_text FROM customer"""
NAMES = """
SELECT cast(5500000000 + c_custkey AS string) AS orgnr, CASE c_custkey % 6 WHEN 0 THEN concat(c_name, ' AB') WHEN 1 THEN concat('Å', lower(c_mktsegment), ' & Söner Bygg Aktiebolag')
  WHEN 2 THEN concat(c_mktsegment, ' Konsult Group HB AB') WHEN 3 THEN 'X1' WHEN 4 THEN concat('  Nya ', n_name, ' ', r_name, ' Holding Öst KB') ELSE NULL END AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _pages(spark, sf_dir):
    return adapter(spark, sf_dir, "site_pages")


def page_text_extract(spark, sf_dir):
    return pg.page_text_extract(_pages(spark, sf_dir)).select("page_order", "text", "n_words")


def link_extract(spark, sf_dir):
    return pg.link_extract(_pages(spark, sf_dir), LINKS).withColumn("rank", F.coalesce("rank", F.lit(0)))


def contact_extract(spark, sf_dir):
    return pg.contact_extract(_pages(spark, sf_dir)).withColumn("emails", F.array_join("emails", ","))


def site_quality_score(spark, sf_dir):
    out = pg.site_quality_score(_pages(spark, sf_dir), QUALITY)
    return out.select("page_order", "site_score", F.array_join("site_flags", ",").alias("site_flags"))


def _swedish(spark, sf_dir):
    return sql(spark, sf_dir, SWEDISH_PAGES)


def link_extract_default(spark, sf_dir):
    return pg.link_extract(_swedish(spark, sf_dir)).withColumn("rank", F.coalesce("rank", F.lit(0)))


def site_quality_default(spark, sf_dir):
    return pg.site_quality_score(_swedish(spark, sf_dir)).select("page_order", "site_score", F.array_join("site_flags", ",").alias("site_flags"))


def parked_site_default(spark, sf_dir):
    return pg.parked_site_flag(_swedish(spark, sf_dir)).select("page_order", "parked")


def _tech(df, words):
    df = df.withColumn("fetch_error", F.when(F.col("page_order") % 41 == 0, "timeout").when(F.col("page_order") % 13 == 0, "403").otherwise(""))
    dns = df.select("site_key", (F.substring(F.md5("site_key"), 1, 1) < "6").alias("cloud_mail")).distinct()
    return pg.tech_signal(df, dns, words)


def tech_signal_default(spark, sf_dir):
    return _tech(_swedish(spark, sf_dir), pg.TechWords())


def parked_site_flag(spark, sf_dir):
    return pg.parked_site_flag(_pages(spark, sf_dir), PARKED_STRONG, PARKED_WEAK).select("page_order", "parked")


def tech_signal(spark, sf_dir):
    return _tech(_pages(spark, sf_dir), TECH)


HOME = "substr(md5(site_key), 1, 1) < '8' AND page_order % 3 = 0"
ERROR = "CASE WHEN page_order % 41 = 0 THEN 'timeout' WHEN page_order % 13 = 0 THEN '403' ELSE '' END"


def hiring_signal(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumns({"is_home": F.expr(HOME), "fetch_error": F.expr(ERROR)})
    out = pg.hiring_signal(pages, HIRING)
    return out.withColumns({"external_job_urls": F.array_join("external_job_urls", ","), "hiring_count": F.coalesce("hiring_count", F.lit(-1))})


def _classified(spark, sf_dir):
    return classify.industry_text_classify(sql(spark, sf_dir, TEXTS), DICTIONARY)


def industry_text_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "w_label", "w_raw", F.round("w_conf", 6).alias("w_conf"))


def industry_dictionary_classify(spark, sf_dir):
    out = classify.industry_dictionary_classify(sql(spark, sf_dir, TEXTS), sql(spark, sf_dir, KEYWORDS))
    return out.select("doc_id", "w_label", "w_raw", F.round("w_conf", 6).alias("w_conf"))


def industry_label_reconcile(spark, sf_dir):
    out = classify.industry_label_reconcile(_classified(spark, sf_dir), sectors=SECTORS)
    return out.select("doc_id", "final_label", "final_conf", "source", "w_bucket", "final_bucket", "conflict")


def segment_assign(spark, sf_dir):
    return classify.segment_assign(sql(spark, sf_dir, SEGMENT_ROWS)).select("orgnr", "segment_groups_after", "status")


def role_category_tag(spark, sf_dir):
    return classify.role_category_tag(sql(spark, sf_dir, ROLES)).select("role_id", "category", "weight")


def domain_candidates(spark, sf_dir):
    return pg.domain_candidates(sql(spark, sf_dir, NAMES))


def probe_result_pick(spark, sf_dir):
    candidates = staged(pg.domain_candidates(sql(spark, sf_dir, NAMES)))  # read by the probes, the measuring and the join
    digit = F.substring(F.md5("domain"), 1, 1)
    probes = candidates.select("domain").distinct().select(
        "domain", digit.isin("0", "1", "2").alias("ok"), digit.isin("1", "2").alias("parked"),
        F.when(digit == "3", "403").when(digit == "4", "gone").when((digit == "5") & F.substring(F.md5("domain"), 2, 1).isin("0", "1"), "timeout").otherwise("").alias("err"),
    )
    return pg.probe_result_pick(candidates, probes)


# ---- filings ----

_N = """concat('<ix:nonFraction contextRef="', CASE WHEN {k} % 7 = 0 THEN 'c>1' ELSE 'c1' END, '" name="{name}" unitRef="{unit}"', CASE WHEN {k} % 3 = 0 THEN ' scale="3"' WHEN {k} % 3 = 1 THEN ' scale="0"' ELSE '' END, '>', {body}, '</ix:nonFraction>')"""
_FACT_COLUMNS = [c for c in fv.FILING_FACTS if c != "solidity_pct"]


def _fact_sql(col: str) -> str:
    body = (
        f"CASE WHEN k % 5 = 0 THEN concat('<b>', cast({col} AS string), '</b>') WHEN k % 5 = 1 THEN concat(' ', cast({col} AS string), ',50') "
        f"WHEN k % 5 = 2 THEN concat(left(cast({col} AS string), 1), '<ix:nonFraction name=\"x:part\">', substr(cast({col} AS string), 2), '</ix:nonFraction>') ELSE cast({col} AS string) END"
    )
    return _N.format(name=fv.FILING_FACTS[col], unit="SEK", k="k", body=body)


FILINGS = f"""
SELECT CASE WHEN k % 50 = 7 THEN '' ELSE orgnr END AS orgnr, end_date, concat('container/', cast(k % 2 AS string), '_', orgnr, '_', end_date, '.xhtml') AS source_file,
  concat('<html', CASE WHEN k % 40 = 9 THEN '' ELSE ' xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"' END, '><body><ix:nonNumeric name="{fv.FILING_ORGNR}" contextRef="c">',
    CASE WHEN k % 31 = 3 THEN '5599999999' WHEN k % 2 = 0 THEN concat(substr(orgnr, 1, 6), '-', substr(orgnr, 7, 4)) ELSE orgnr END, '</ix:nonNumeric>',
    CASE WHEN k % 37 = 5 THEN '<ix:nonNumeric name="{fv.FILING_END}">1990-01-01</ix:nonNumeric>' ELSE '' END,
    CASE WHEN k % 6 = 0 THEN '<!-- <ix:nonFraction name="{fv.FILING_FACTS['revenue_sek']}">1</ix:nonFraction> -->' ELSE '' END,
    {', '.join(_fact_sql(c) for c in _FACT_COLUMNS if c != 'result_after_fin_sek')},
    CASE WHEN result_after_fin_sek IS NULL THEN '<ix:nonFraction name="{fv.FILING_FACTS['result_after_fin_sek']}" xsi:nil="true"/>' ELSE {_fact_sql('result_after_fin_sek')} END,
    CASE WHEN solidity_pct IS NULL THEN '' ELSE concat('<ix:nonFraction name="{fv.FILING_FACTS['solidity_pct']}" unitRef="procent" scale="-2">', cast(cast(solidity_pct AS int) AS string), '</ix:nonFraction>') END,
    '<br></body>') AS xhtml
FROM (SELECT *, cast(fiscal_year_end_date AS string) AS end_date, cast(orgnr AS bigint) * 7 + fiscal_year_end_year AS k FROM company_financials) f"""


def _filings(spark, sf_dir):
    # The documents are made up from narrow rows; spread those as a scan of real documents would be.
    rows = adapter(spark, sf_dir, "company_financials").repartition(spark.sparkContext.defaultParallelism)
    return sql(spark, sf_dir, FILINGS, company_financials=rows)


def filing_fact_extract(spark, sf_dir):
    out = filings.filing_fact_extract(_filings(spark, sf_dir))
    return keyed(out).withColumn("solidity_pct", F.round("solidity_pct", 6))


def _validated(spark, sf_dir):
    docs = _filings(spark, sf_dir)
    known = adapter(spark, sf_dir, "companies").where("orgnr NOT LIKE '%8'")
    loaded = docs.where("end_date = '1995-12-31' AND orgnr LIKE '%4'")
    broken = F.substring("end_date", 1, 4).cast("int") % 2 == 0
    again = docs.where("orgnr LIKE '%5'").withColumns({"source_file": F.concat(F.lit("z/"), "source_file"), "xhtml": F.when(broken, "<html>").otherwise(F.col("xhtml"))})
    twice = docs.unionByName(again)
    return filings.filing_validate(twice, known, loaded)


def filing_validate(spark, sf_dir):
    accepted, rejects, _, _ = _validated(spark, sf_dir)
    shown = ["orgnr", "end_date", "source_file"]
    return (
        accepted.select(*shown, F.lit("accepted").alias("reason"), "revenue_sek")
        .unionByName(rejects.withColumn("revenue_sek", F.lit(0).cast("bigint")))
    )


def filing_validate_counts(spark, sf_dir):
    return _validated(spark, sf_dir)[2]


QUERIES = {
    f.__name__: f
    for f in (
        page_text_extract, link_extract, contact_extract, site_quality_score, parked_site_flag, tech_signal, hiring_signal,
        link_extract_default, site_quality_default, parked_site_default, tech_signal_default,
        industry_text_classify, industry_dictionary_classify, industry_label_reconcile, segment_assign, role_category_tag, domain_candidates, probe_result_pick,
        filing_fact_extract, filing_validate, filing_validate_counts,
    )
}

# ---- SQL twins ----

_P = ctes("site_pages")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _visible(col: str, comments: bool = True) -> str:
    steps = ["(?s)<script.*?</script>", "(?s)<style.*?</style>"] + (["(?s)<!--.*?-->"] if comments else []) + ["<[^>]+>"]
    for p in steps:
        col = f"regexp_replace({col}, {q(p)}, ' ', 'g')"
    return f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"


def _count_words(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE len(string_split({text}, ' ')) END::INTEGER"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def _hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {q(w)})::INT" for w in words) + ")"


_HREFS = "regexp_extract_all(h, 'href=[\"'']([^\"'']+)[\"'']', 1)"


def _low(pages: str) -> str:
    return f"{pages}, low AS (SELECT *, lower(html) AS h FROM site_pages), txt AS (SELECT *, {_visible('h')} AS t FROM low)"


def _links(low: str) -> str:
    """The pages hold site-relative links only; other forms are covered by unit tests."""
    return f"""{low}, l AS (SELECT site_key, page_order, url, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) AS pos FROM low),
a AS (SELECT site_key, page_order, url AS page_url, pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link, href, regexp_extract(href, '^([^?#]*)', 1) AS path, site_key AS host FROM l WHERE starts_with(href, '/'))"""


def _kinds(words: pg.LinkWords) -> str:
    return " UNION ALL ".join(
        f"SELECT site_key, page_order, pos, link, '{k}' AS kind FROM a WHERE {cond}"
        for k, cond in (
            ("internal_hint", _any("path", words.hints)),
            ("internal_job", f"({_any('path', words.job_paths)} AND NOT contains(path, 'spontan'))"),
            ("external_job", _any("host", words.job_domains)),
        )
    )


_LOW = _low(_P)
_LINKS, _KINDS = _links(_LOW), _kinds(LINKS)
_LOW_SWEDISH = _low(f"site_pages AS ({SWEDISH_PAGES})")
# The trigger words follow ASCII characters only, so the ASCII word boundary is enough here.
_TRIGGERS = " || ".join(f"regexp_extract_all(t, {q(chr(92) + 'b' + tr + '(.{0,90})')}, 1)" for tr in HIRING.triggers)
_FILL = q("(^|[^\\p{L}\\p{N}_])(?:" + "|".join(HIRING.fillers) + ")($|[^\\p{L}\\p{N}_])")


_EMAIL = q(fv.EMAIL_PATTERN)
_SPELL = q(fv.SPELLED_ADDRESS_PATTERN)


def _found(text: str) -> str:
    parts = ", ".join(f"regexp_extract_all({text}, {_SPELL}, {i})" for i in (1, 2, 3))
    return (
        f"(regexp_extract_all({text}, {_EMAIL}) || list_transform(list_zip({parts}), lambda z: z[1] || '@' || trim(z[2], '.') || '.' || z[3]))"
    )


def _entities(text: str) -> str:
    for name, value in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, {q(name)}, {q(value)})"
    return text


_CAT = [f"{_hits('text', c.keywords)}" for c in DICTIONARY]
_CLASSIFY = f"""tx AS ({TEXTS}), s AS (SELECT doc_id, text, register_text, unnest([{', '.join(_CAT)}]) AS score, unnest(range(0, {len(DICTIONARY)})) AS i FROM tx),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM s),
b AS (SELECT doc_id, any_value(length(text)) AS len, any_value(register_text) AS register_text, max(score) FILTER (rn = 1) AS top, max(i) FILTER (rn = 1) AS i, max(score) FILTER (rn = 2) AS second FROM r GROUP BY 1),
cl AS (SELECT doc_id, register_text, CASE WHEN len >= 200 AND top > 0 THEN [{', '.join(q(c.label) for c in DICTIONARY)}][i + 1] ELSE '' END AS w_label, CASE WHEN len >= 200 AND top > 0 THEN [{', '.join(q(c.raw) for c in DICTIONARY)}][i + 1] ELSE '' END AS w_raw,
  CASE WHEN len < 200 THEN 0.0::DOUBLE WHEN top = 0 THEN 0.15::DOUBLE ELSE least(1.0::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * top + 0.10::DOUBLE * (top / (second + 0.5::DOUBLE))) END AS w_conf FROM b)"""
_SECTOR_CASE = "CASE w_label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SECTORS.items()) + " END"
_KEYWORD_CASE = "CASE " + " ".join(f"WHEN contains(t, {q(w)}) THEN {q(s)}" for s, w in fv.SECTOR_KEYWORDS) + " END"


def _bucket(c: str) -> str:
    return f"CASE WHEN {c} >= 0.80 THEN 'HIGH' WHEN {c} >= 0.50 THEN 'MID' ELSE 'LOW' END"


_SUFFIXED = "lower(trim(coalesce(name, '')))"
for _s in fv.NAME_SUFFIXES:
    _SUFFIXED = f"trim(regexp_replace({_SUFFIXED}, {q(_s + '$')}, ''))"
_STOP = ", ".join(q(w) for w in fv.NAME_STOP_WORDS)
_SLUGS = "[CASE WHEN length(replace(n, ' ', '')) >= 4 THEN replace(n, ' ', '') END, CASE WHEN length(n) >= 4 THEN replace(n, ' ', '-') END, " + ", ".join(
    f"CASE WHEN length(array_to_string({w}, {q(sep)})) >= 3 THEN array_to_string({w}, {q(sep)}) END" for w in ("f", "f[1:1]", "f[1:2]", "f[1:3]") for sep in ("", "-")
) + ", " + ", ".join(f"CASE WHEN len(ini) >= 3 THEN array_to_string(ini, {q(sep)}) END" for sep in ("", "-")) + "]"
_DOMAINS = f"""nm AS ({NAMES}), c1 AS (SELECT orgnr, trim(regexp_replace(regexp_replace(translate(replace({_SUFFIXED}, '&', ' och '), 'åäöé', 'aaoe'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM nm),
c2 AS (SELECT orgnr, n, list_filter(string_split(n, ' '), lambda w: w <> '' AND w NOT IN ({_STOP})) AS f FROM c1),
c3 AS (SELECT *, list_transform(list_filter(f, lambda w: length(w) >= 2), lambda w: w[1:1]) AS ini FROM c2),
c4 AS (SELECT orgnr, unnest(sl) AS s, generate_subscripts(sl, 1) AS p FROM (SELECT orgnr, {_SLUGS} AS sl FROM c3)),
c5 AS (SELECT orgnr, s, min(p) AS p FROM c4 WHERE s IS NOT NULL AND length(s) <= 40 GROUP BY 1, 2), c6 AS (SELECT *, row_number() OVER (PARTITION BY orgnr ORDER BY p) - 1 AS k FROM c5),
c7 AS (SELECT orgnr, k, s, unnest([0, 1, 2, 3]) AS j FROM c6 WHERE k < 12), cand AS (SELECT orgnr, (k * 4 + j)::INTEGER AS rank, CASE WHEN j % 2 = 1 THEN 'www.' ELSE '' END || s || CASE WHEN j < 2 THEN '.se' ELSE '.com' END AS domain FROM c7)"""
_SEG_HITS = "list_filter([" + ", ".join(f"CASE WHEN contains(t, {q(w)}) THEN {q(s)} END" for s, w in fv.SEGMENT_KEYWORDS) + "], lambda x: x IS NOT NULL)"
_SEG_LABEL = "CASE k " + " ".join(f"WHEN {q(k)} THEN [{', '.join(q(x) for x in v)}]" for k, v in fv.SEGMENTS_OF_LABEL.items()) + " ELSE [] END"
_ROLE_WEIGHTS = ", ".join(
    "(" + " + ".join(f"contains(t, {q(w)})::INT" for w in words) + ")" for words in fv.ROLE_CATEGORIES.values()
)


def _filing_value(col: str) -> str:
    """The fact as written into the document, scaled and rounded half to even."""
    scale = "CASE WHEN k % 3 = 0 THEN 1000 ELSE 1 END"
    return f"round_even(({col}::DOUBLE + CASE WHEN k % 5 = 1 THEN CASE WHEN {col} < 0 THEN -0.5 ELSE 0.5 END ELSE 0 END) * {scale}, 0)::BIGINT AS {col}"


_K = f"{ctes('company_financials')}, f AS (SELECT *, fiscal_year_end_date::VARCHAR AS end_date, orgnr::BIGINT * 7 + fiscal_year_end_year AS k FROM company_financials), d AS (SELECT *, 'container/' || (k % 2)::VARCHAR || '_' || orgnr || '_' || end_date || '.xhtml' AS source_file, CASE WHEN k % 50 = 7 THEN '' ELSE orgnr END AS o FROM f)"
_JUDGED = f"""{_K}, u AS (SELECT *, false AS again FROM d UNION ALL SELECT * REPLACE ('z/' || source_file AS source_file), true FROM d WHERE o LIKE '%5'),
v AS (SELECT o AS orgnr, end_date, source_file, CASE WHEN o = '' THEN 'bad_key' WHEN o LIKE '%8' THEN 'unknown_company' WHEN end_date = '1995-12-31' AND o LIKE '%4' THEN 'already_loaded' WHEN again AND NOT (k % 40 = 9 OR k % 31 = 3 OR k % 37 = 5) THEN 'already_loaded'
  WHEN k % 40 = 9 OR (again AND substr(end_date, 1, 4)::INT % 2 = 0) THEN 'parse_error'
  WHEN k % 31 = 3 THEN 'key_mismatch' WHEN k % 37 = 5 THEN 'date_mismatch' ELSE 'accepted' END AS reason, {_filing_value('revenue_sek')} FROM u)"""

def _links_sql(links: str, kinds: str) -> str:
    return f"""WITH {links}, k AS ({kinds}), s AS (SELECT site_key, kind, link AS url, min((page_order, pos)) AS first FROM k GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY site_key, kind ORDER BY first)::INTEGER AS rank FROM s)
SELECT site_key, kind, CASE WHEN kind = 'internal_job' THEN 0 ELSE rank END AS rank, url FROM r WHERE kind = 'internal_job' OR rank <= CASE kind WHEN 'internal_hint' THEN 25 ELSE 5 END"""


def _quality_sql(low: str, words: pg.QualityWords) -> str:
    return f"""WITH {low}, w AS (SELECT *, {_visible('h', comments=False)} AS t2 FROM low),
c AS (SELECT page_order, starts_with(url, 'https://') AS c1, regexp_matches(h, {_EMAIL}) OR regexp_matches(h, '(\\+46|0)\\s?[0-9][0-9\\s\\-]{{6,}}') OR contains(h, '<form') OR contains(h, 'kontakt') AS c2, {_hits('h', words.cta)} >= 2 AS c3,
  len(list_filter({_HREFS}, lambda x: NOT regexp_matches(x, '^(#|mailto:|tel:)') AND {_any('x', words.services)})) >= 2 AS c4,
  regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}_])[0-9]{{6}}-[0-9]{{4}}($|[^\\p{{L}}\\p{{N}}_])') OR {_any('h', words.address)} AS c5, len(regexp_extract_all(h, '<img')) >= 3 OR contains(h, 'og:image') AS c6, {_count_words('t2')} >= 250 AS c7, {_any('h', words.platforms)} AS c8 FROM w)
SELECT page_order, greatest(1, least(10, c1::INT * 2 + c2::INT * 2 + c3::INT + c4::INT + c5::INT + c6::INT + c7::INT + c8::INT))::INTEGER AS site_score,
  concat_ws(',', CASE WHEN NOT c1 THEN 'no_https' END, CASE WHEN NOT c2 THEN 'no_contact' END, CASE WHEN NOT c3 THEN 'low_cta' END, CASE WHEN NOT c4 THEN 'few_service_links' END, CASE WHEN NOT c5 THEN 'no_orgnr_or_address' END, CASE WHEN NOT c6 THEN 'few_images' END, CASE WHEN NOT c7 THEN 'thin_content' END, CASE WHEN NOT c8 THEN 'unknown_tech' END) AS site_flags FROM c"""


def _tech_sql(low: str, words: pg.TechWords) -> str:
    columns = {f"c{i}": w for i, w in enumerate(words.categories)} | {
        "mail": words.mail, "cloud": words.cloud, "strong": words.support_strong, "medium": words.support_medium
    }
    return f"""WITH {low}, e AS (SELECT *, CASE WHEN page_order % 41 = 0 THEN 'timeout' WHEN page_order % 13 = 0 THEN '403' ELSE '' END AS err FROM txt),
s AS (SELECT site_key, {', '.join(f"bool_or(err = '' AND {_any('t', w)}) AS {k}" for k, w in columns.items())}, bool_or(err = 'timeout') AS tm, arg_min(err, page_order) AS he, substr(md5(site_key), 1, 1) < '6' AS dns FROM e GROUP BY 1),
n AS (SELECT *, {' + '.join(f'c{i}::INT' for i in range(4))} AS n, he <> '' AS bad FROM s WHERE NOT tm)
SELECT site_key, he AS err_reason, CASE WHEN bad THEN 'unknown' WHEN n >= 2 OR dns OR mail OR n = 1 THEN 'yes' ELSE 'no' END AS microsoft_status, CASE WHEN bad THEN NULL WHEN n >= 2 THEN 'strong' WHEN dns OR mail OR n = 1 THEN 'weak' END AS microsoft_strength,
  CASE WHEN bad THEN 'low' WHEN n >= 2 THEN CASE WHEN cloud OR n >= 3 THEN 'high' ELSE 'medium' END WHEN dns THEN 'high' WHEN mail THEN 'medium' ELSE 'low' END AS microsoft_confidence,
  CASE WHEN bad THEN 'unknown' WHEN strong OR medium THEN 'yes' ELSE 'no' END AS it_support_signal, CASE WHEN bad THEN 'low' WHEN strong THEN 'high' WHEN medium THEN 'medium' ELSE 'low' END AS it_support_confidence FROM n"""


ORACLES = {
    "page_text_extract": f"WITH {_LOW} SELECT page_order, t AS text, {_count_words('t')} AS n_words FROM txt",
    "link_extract": _links_sql(_LINKS, _KINDS),
    "link_extract_default": _links_sql(_links(_LOW_SWEDISH), _kinds(pg.LinkWords())),
    "contact_extract": f"""WITH {_P}, v AS (SELECT site_key, page_order, {_entities("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))")} AS t,
  {_entities('html')} AS raw, list_transform(regexp_extract_all(html, '(?is)\\s(?:{'|'.join(fv.ADDRESS_ATTRIBUTES)})\\s*=\\s*("[^"]*"|''[^'']*'')', 1), lambda x: {_entities('x')}) AS att FROM site_pages),
w AS (SELECT site_key, page_order, flatten(list_transform(att, lambda x: {_found('x')})) || {_found('t')} || {_found('raw')} AS e FROM v),
x AS (SELECT site_key, page_order, lower(regexp_replace(unnest(e), '^[.,;:()\\[\\]{{}}<>"'']+|[.,;:()\\[\\]{{}}<>"'']+$', '', 'g')) AS email, generate_subscripts(e, 1) AS pos FROM w),
y AS (SELECT site_key, email, min((page_order, pos)) AS first, split_part(email, '@', 1) AS loc FROM x WHERE contains(email, '@') AND split_part(email, '@', 1) NOT IN ('noreply','no-reply','donotreply','do-not-reply','example','test')
  AND NOT contains(email, '@example.') AND NOT contains(email, '@test.') AND NOT contains(email, '@email.com') AND NOT regexp_matches(email, '\\.(png|jpg|jpeg|svg|webp|gif|css|js)$') GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN regexp_matches(loc, '^(it|support|helpdesk|servicedesk)') THEN 100 WHEN regexp_matches(loc, '^(info|kontakt|contact|hello|sales)') THEN 80 WHEN regexp_matches(loc, '^(admin|office|hr|ekonomi|finance)') THEN 60 ELSE 10 END AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY score DESC, first) AS rn FROM z) SELECT site_key, string_agg(email, ',' ORDER BY rn) AS emails FROM o WHERE rn <= 3 GROUP BY 1""",
    "site_quality_score": _quality_sql(_LOW, QUALITY),
    "site_quality_default": _quality_sql(_LOW_SWEDISH, pg.QualityWords()),
    "parked_site_default": f"WITH {_LOW_SWEDISH} SELECT page_order, {_any('h', fv.PARKED_STRONG)} OR {_hits('h', fv.PARKED_WEAK)} >= 2 AS parked FROM low",
    "parked_site_flag": f"WITH {_LOW} SELECT page_order, {_any('h', PARKED_STRONG)} OR {_hits('h', PARKED_WEAK)} >= 2 AS parked FROM low",
    "tech_signal": _tech_sql(_LOW, TECH),
    "tech_signal_default": _tech_sql(_LOW_SWEDISH, pg.TechWords()),
    "hiring_signal": f"""WITH {_LINKS}, er AS (SELECT site_key, page_order, {HOME} AS home, {ERROR} AS err FROM site_pages),
h0 AS (SELECT site_key, coalesce(min(page_order) FILTER (home), min(page_order)) AS page_order FROM er GROUP BY 1), h AS (SELECT h0.*, er.err FROM h0 JOIN er USING (site_key, page_order)),
tm AS (SELECT er.site_key, min(er.page_order) AS late FROM er JOIN h ON h.site_key = er.site_key AND h.page_order <> er.page_order WHERE er.err = 'timeout' GROUP BY 1),
rel AS (SELECT txt.site_key, txt.page_order, txt.url, t FROM txt JOIN er USING (page_order) JOIN h ON h.site_key = txt.site_key WHERE er.err = '' AND txt.page_order <> h.page_order AND {_any('t', HIRING.keywords)}),
ro AS (SELECT page_order, unnest(x) AS c, generate_subscripts(x, 1) AS p FROM (SELECT page_order, {_TRIGGERS} AS x FROM rel)),
rc AS (SELECT page_order, p, trim(regexp_replace(' ' || replace(trim(regexp_replace(regexp_extract(trim(c), '^([^.!?|;:()\\[\\]{{\\\\/]*)', 1), '\\s+', ' ', 'g')), ' ', '  ') || ' ', {_FILL}, '\\1\\2', 'g')) AS c FROM ro),
rd AS (SELECT page_order, min(p) AS p, c FROM (SELECT page_order, p, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS c FROM rc) WHERE length(c) BETWEEN 3 AND 60 AND regexp_matches(c, '[a-zåäö]') AND NOT regexp_matches(c, {_EMAIL}) AND NOT {_any('c', ('cookie', 'integritet', 'privacy'))} GROUP BY page_order, c),
rr AS (SELECT page_order, count(*) AS n, list(c ORDER BY p) AS l FROM rd GROUP BY 1),
jb AS (SELECT page_order, count(DISTINCT link) AS n FROM a WHERE {_any('path', LINKS.job_paths)} AND NOT contains(path, 'spontan') GROUP BY 1),
y AS (SELECT rel.site_key, rel.page_order, rel.url, substr(array_to_string(rr.l[1:12], '; '), 1, 500) AS what, CASE WHEN rr.n > 0 THEN rr.n ELSE jb.n END AS n FROM rel LEFT JOIN rr USING (page_order) LEFT JOIN jb USING (page_order) WHERE rr.n > 0 OR jb.n > 0),
d AS (SELECT site_key, min(page_order) AS at, arg_min(url, page_order) AS url, arg_min(coalesce(what, ''), page_order) AS what, arg_min(n, page_order) AS n FROM y GROUP BY 1),
x0 AS (SELECT h.site_key, a.link, min(pos) AS p FROM h JOIN a ON a.page_order = h.page_order WHERE h.err = '' AND {_any('host', LINKS.job_domains)} GROUP BY 1, 2), x1 AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY p) AS rn FROM x0),
x AS (SELECT site_key, string_agg(link, ',' ORDER BY rn) AS ext, max(link) FILTER (rn = 1) AS one FROM x1 WHERE rn <= 5 GROUP BY 1)
SELECT h.site_key, h.err AS err_reason, CASE WHEN h.err <> '' THEN 'unknown' WHEN d.url IS NOT NULL THEN 'yes' WHEN x.ext IS NOT NULL THEN 'maybe_external' ELSE 'no' END AS hiring_status, CASE WHEN h.err = '' THEN coalesce(d.what, '') ELSE '' END AS hiring_what_text,
  CASE WHEN h.err <> '' THEN -1 WHEN d.url IS NOT NULL THEN d.n WHEN x.ext IS NOT NULL THEN -1 ELSE 0 END::INTEGER AS hiring_count, CASE WHEN h.err <> '' THEN '' WHEN d.url IS NOT NULL THEN d.url ELSE coalesce(x.one, '') END AS evidence_url, coalesce(x.ext, '') AS external_job_urls
FROM h LEFT JOIN d USING (site_key) LEFT JOIN x USING (site_key) LEFT JOIN tm USING (site_key) WHERE h.err <> 'timeout' AND (h.err <> '' OR tm.late IS NULL OR coalesce(d.at < tm.late, false))""",
    "industry_text_classify": f"WITH {_CLASSIFY} SELECT doc_id, w_label, w_raw, round(w_conf, 6) AS w_conf FROM cl",
    "industry_dictionary_classify": f"""WITH t AS ({TEXTS}), k AS ({KEYWORDS}),
s AS (SELECT doc_id, text, position, label, raw, count(*) AS n FROM t JOIN k ON contains(text, keyword) WHERE length(text) >= 200 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(n) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, position))
SELECT t.doc_id, coalesce(label, '') AS w_label, coalesce(raw, '') AS w_raw,
  CASE WHEN n > 0 THEN round(least(1.0, 0.35 + 0.15 * n::DOUBLE + 0.10 * (n::DOUBLE / (second + 0.5))), 6) WHEN length(coalesce(t.text, '')) >= 200 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS w_conf
FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND rn = 1""",
    "industry_label_reconcile": f"""WITH {_CLASSIFY}, k AS (SELECT *, lower(trim(coalesce(register_text, ''))) AS t FROM cl), m AS (SELECT *, t NOT IN ('', '__no_sni__', 'okänd', '""') AS known, coalesce({_SECTOR_CASE} = {_KEYWORD_CASE}, false) AS same FROM k),
f AS (SELECT *, CASE WHEN w_label = '' THEN CASE WHEN known THEN 0.30 ELSE 0.10 END WHEN w_conf >= 0.80 THEN w_conf WHEN w_conf >= 0.50 AND known THEN CASE WHEN same THEN w_conf ELSE 0.35 END WHEN w_conf < 0.50 AND known THEN 0.25 ELSE w_conf END::DOUBLE AS fc,
  CASE WHEN w_label = '' THEN 'sni' WHEN w_conf >= 0.80 THEN 'website' WHEN w_conf >= 0.50 AND known THEN CASE WHEN same THEN 'blend' ELSE 'sni' END WHEN w_conf < 0.50 AND known THEN 'sni' ELSE 'website' END AS source FROM m)
SELECT doc_id, CASE WHEN source = 'sni' THEN 'unknown' ELSE w_label END AS final_label, round(fc, 4) AS final_conf, source, {_bucket('w_conf')} AS w_bucket, {_bucket('fc')} AS final_bucket, w_label <> '' AND source = 'sni' AND w_conf >= 0.50 AS conflict FROM f""",
    "segment_assign": f"""WITH x AS ({SEGMENT_ROWS}), y AS (SELECT orgnr, lower(trim(coalesce(line_of_work, ''))) AS k, lower(trim(coalesce(sni_text, ''))) AS t, list_filter(list_transform(string_split(coalesce(segment_groups, ''), ','), lambda s: trim(s)), lambda s: s <> '') AS old FROM x),
z AS (SELECT *, {_SEG_LABEL} AS lab, CASE WHEN t IN ('', '__no_sni__', 'okänd', '""') THEN [] ELSE {_SEG_HITS} END AS hit FROM y),
m AS (SELECT orgnr, unnest(list_distinct(old || CASE WHEN len(lab) > 0 THEN lab ELSE hit || CASE WHEN list_has_any(hit, ['it_sector', 'finance_sector']) THEN ['office_b2b'] ELSE [] END END)) AS s FROM z),
g AS (SELECT orgnr, string_agg(s, ',' ORDER BY coalesce(nullif(list_position([{', '.join(q(s) for s in fv.SEGMENTS)}], s), 0), 10001), s) AS after FROM m GROUP BY 1)
SELECT orgnr, coalesce(after, '') AS segment_groups_after, CASE WHEN coalesce(after, '') <> '' THEN 'found' ELSE 'not_found' END AS status FROM x LEFT JOIN g USING (orgnr)""",
    "role_category_tag": f"""WITH x AS ({ROLES}), y AS (SELECT role_id, unnest([{_ROLE_WEIGHTS}]) AS w, unnest(range(0, {len(fv.ROLE_CATEGORIES)})) AS i FROM (SELECT role_id, lower(trim(role_text)) AS t FROM x)),
z AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY w DESC, i) AS rn FROM y) SELECT role_id, CASE WHEN w > 0 THEN [{', '.join(q(c) for c in fv.ROLE_CATEGORIES)}][i + 1] END AS category, w::INTEGER AS weight FROM z WHERE rn = 1""",
    "domain_candidates": f"WITH {_DOMAINS} SELECT orgnr, rank, domain FROM cand",
    "probe_result_pick": f"""WITH {_DOMAINS}, pr AS (SELECT *, substr(md5(domain), 1, 1) AS g, substr(md5(domain), 2, 1) AS g2 FROM cand), e AS (SELECT *, g = '0' AS good, g IN ('1', '2') AS pk, CASE WHEN g = '3' THEN '403' WHEN g = '4' THEN 'other' WHEN g = '5' AND g2 IN ('0', '1') THEN 'timeout' END AS err FROM pr),
s AS (SELECT orgnr, arg_min('https://' || domain, rank) FILTER (good) AS url, bool_or(pk) AS pk, bool_or(coalesce(err = 'timeout', false)) AS tm, arg_max(err, rank) FILTER (err IS NOT NULL) AS le FROM e GROUP BY 1)
SELECT orgnr, coalesce(url, '') AS found_website, CASE WHEN url IS NOT NULL THEN 'found' WHEN pk THEN 'parked' ELSE 'not_found' END AS status, CASE WHEN url IS NOT NULL THEN '' ELSE coalesce(le, '') END AS err_reason FROM s WHERE url IS NOT NULL OR NOT tm""",
    "filing_fact_extract": f"""WITH {_K} SELECT o AS orgnr, end_date AS fiscal_year_end_date, fiscal_year_end_year, {', '.join(_filing_value(c) for c in _FACT_COLUMNS)}, round(solidity_pct * 0.01 * 100.0, 6) AS solidity_pct, source_file FROM d""",
    "filing_validate": f"WITH {_JUDGED} SELECT orgnr, end_date, source_file, reason, CASE WHEN reason = 'accepted' THEN revenue_sek ELSE 0 END AS revenue_sek FROM v",
    "filing_validate_counts": f"WITH {_JUDGED} SELECT reason, count(*) AS n FROM v GROUP BY 1",
}
