"""Signals from web pages (site_key, page_order, url, html and, if known, fetch_error and is_home).

Each page is read once, whole, and turned into a narrow row before anything is shuffled; per-site decisions
are aggregates with map-side combine, so a site with a third of all pages is not a bottleneck.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.functions import html as H
from firmweave.functions.text import any_contains, full_strip, hit_count, string_array
from firmweave.session import lookup_join, staged

# The address pattern in linear time: a run of address characters is entered at its start (or where the last match
# ended) and never given back.
_EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))" + fv.EMAIL_PATTERN.replace("+@", "++@", 1)


def _lower(pages: DataFrame) -> Column:
    return F.lower(F.coalesce(F.col("html"), F.lit("")))


def page_text_extract(pages: DataFrame) -> DataFrame:
    """Adds ``text`` and ``n_words``."""
    with_text = pages.withColumn("text", H.visible_text(_lower(pages)))
    return with_text.withColumn("n_words", H.word_count(F.col("text")))


@dataclass(frozen=True)
class LinkWords:
    hints: tuple[str, ...] = fv.CAREER_PATH_HINTS
    job_paths: tuple[str, ...] = fv.JOB_PATHS
    job_queries: tuple[str, ...] = fv.JOB_QUERIES
    job_domains: tuple[str, ...] = fv.EXTERNAL_JOB_DOMAINS
    max_hints: int = 25
    max_external: int = 5


def _is_job(u: Column, words: LinkWords) -> Column:
    path, query = F.lower(H.url_path(u)), F.lower(H.url_query(u))
    return (any_contains(path, words.job_paths) | any_contains(query, words.job_queries)) & ~(
        path.contains("spontan") | query.contains("spontan")
    )


def _is_web(u: Column) -> Column:
    return H.url_scheme(u).isin("http", "https")


def _absolute_links(url: Column, lower_html: Column) -> Column:
    return F.transform(H.hrefs(lower_html), lambda h: H.resolve(url, h))


def link_extract(pages: DataFrame, words: LinkWords = LinkWords()) -> DataFrame:
    """site_key, kind (internal_hint, internal_job, external_job), rank, url: first-seen order, no repeats.

    The hint and external lists are top-n reports; job links are complete.
    """
    links = pages.select(
        "site_key", "page_order", H.url_host(F.col("url")).alias("_host"),
        # The outer form: the plain one would also compute the links in an inferred filter.
        F.posexplode_outer(_absolute_links(F.col("url"), _lower(pages))).alias("pos", "link"),
    ).where(F.col("pos").isNotNull())
    links = links.withColumn("link_host", H.url_host(F.col("link")))
    same = F.col("link_host") == F.col("_host")
    hint = same & _is_web(F.col("link")) & any_contains(F.lower(H.url_path(F.col("link"))), words.hints)
    job = same & _is_job(F.col("link"), words)
    external = (F.col("link_host") != "") & any_contains(F.col("link_host"), words.job_domains)
    kinds = F.filter(
        F.array(F.when(hint, "internal_hint"), F.when(job, "internal_job"), F.when(external, "external_job")),
        lambda k: k.isNotNull(),
    )
    seen = (
        links.select("site_key", "page_order", "pos", "link", F.explode(kinds).alias("kind"))
        .groupBy("site_key", "kind", F.col("link").alias("url"))
        .agg(F.min(F.struct("page_order", "pos")).alias("first"))
    )
    # Both lists below come from the deduplicated links; the pages are read once.
    seen = staged(seen)
    jobs = seen.where("kind = 'internal_job'").select("site_key", "kind", F.lit(None).cast("int").alias("rank"), "url")
    # A rank filter on row_number: each task keeps its own first n per group before the shuffle.
    ranked = seen.where("kind <> 'internal_job'").withColumn(
        "rank", F.row_number().over(W.partitionBy("site_key", "kind").orderBy("first"))
    )
    most = max(words.max_hints, words.max_external)
    listed = ranked.where(F.col("rank") <= most).where(
        F.col("rank") <= F.when(F.col("kind") == "internal_hint", words.max_hints).otherwise(words.max_external)
    )
    return listed.select("site_key", "kind", "rank", "url").unionByName(jobs)


# ---- contact addresses ----

_EDGE = r"""^[.,;:()\[\]{}<>"']+|[.,;:()\[\]{}<>"']+$"""


def _clean_address(raw: Column) -> Column:
    decoded = H.unquote(H.unescape(full_strip(raw)))
    return F.lower(F.regexp_replace(full_strip(decoded), _EDGE, ""))


def _allowed(address: Column) -> Column:
    prefix = F.element_at(F.split(address, "@", -1), 1)
    bad_end = reduce(lambda a, b: a | b, [address.endswith(x) for x in fv.ADDRESS_BLOCKED_ENDINGS])
    return (
        address.contains("@")
        & ~prefix.isin(*fv.ADDRESS_BLOCKED_PREFIXES)
        & ~any_contains(address, fv.ADDRESS_BLOCKED_PARTS)
        & ~bad_end
    )


def _addresses(text: Column) -> Column:
    """Plain addresses, then spelled-out ones, each in order."""
    plain = F.regexp_extract_all(text, F.lit(_EMAIL), F.lit(0))
    spelled = F.regexp_extract_all(text, F.lit(fv.SPELLED_ADDRESS_PATTERN), F.lit(0))

    def join(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, fv.SPELLED_ADDRESS_PATTERN, i)
        return F.concat(part(1), F.lit("@"), F.regexp_replace(part(2), r"^\.+|\.+$", ""), F.lit("."), part(3))

    return F.concat(plain, F.transform(spelled, join))


def _unmask(code: Column) -> Column:
    """XOR-masked hex text: the first byte is the key."""
    byte = lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("int")
    usable = (F.length(code) >= 4) & (F.length(code) % 2 == 0)
    places = F.sequence(F.lit(3), F.when(usable, F.length(code) - 1).otherwise(3), F.lit(2))
    chars = F.transform(places, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1)))))
    return F.when(usable, F.array_join(chars, ""))


def _first_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def mail_links(html: Column) -> Column:
    """Addresses of mail links in order.

    A start without such a link takes all up to the next ">" with it: no later start in there could find one.
    """
    links = _first_matches(html, r"""(?is)<a\s(?:[^>]*?href\s*=\s*("\s*mailto:[^"]*"|'\s*mailto:[^']*')|[^>]*+)""")
    return F.transform(F.filter(links, lambda a: a != ""), lambda a: F.regexp_extract(a, r"""(?is)mailto:([^"'?]*)""", 1))


def address_sources(df: DataFrame) -> DataFrame:
    """Adds ``_sources``: the raw addresses of each page in order of trust."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = H.without_markup(html, any_case=True)
    names = "|".join(fv.ADDRESS_ATTRIBUTES)
    attributes = _first_matches(html, rf"""(?is)\s(?:{names})\s*=\s*("[^"]*"|'[^']*')""")
    # Decoded once each, as columns of their own.
    step = df.withColumns(
        {
            "_text": H.unescape(H.squeeze(text)),
            "_decoded": H.unquote(H.unescape(html)),
            "_attributes": F.transform(attributes, lambda v: H.unquote(H.unescape(v))),
        }
    )
    masked = F.concat(
        _first_matches(html, r"""data-cfemail=['"]([0-9a-fA-F]+)['"]"""),
        _first_matches(html, r"/cdn-cgi/l/email-protection#([0-9a-fA-F]+)"),
    )
    sources = F.concat(
        F.transform(masked, _unmask),
        mail_links(html),
        F.flatten(F.transform("_attributes", _addresses)),
        _addresses(F.col("_text")),
        _addresses(F.col("_decoded")),
    )
    return step.withColumn("_sources", sources).drop("_text", "_decoded", "_attributes")


def _priority(address: Column) -> Column:
    local = F.element_at(F.split(address, "@", -1), 1)
    chain = None
    for score, prefixes in fv.ADDRESS_PRIORITY:
        hit = reduce(lambda a, b: a | b, [local.startswith(p) for p in prefixes])
        chain = F.when(hit, score) if chain is None else chain.when(hit, score)
    return chain.otherwise(fv.ADDRESS_PRIORITY_OTHER)


def contact_extract(pages: DataFrame, keep: int = 3) -> DataFrame:
    """site_key, emails: the best ``keep`` addresses by priority, then first seen."""
    # The outer form: the plain one would also compute the sources in an inferred filter.
    found = address_sources(pages).select("site_key", "page_order", F.posexplode_outer("_sources").alias("pos", "raw"))
    found = found.where(F.col("raw").isNotNull())
    clean = found.select("site_key", "page_order", "pos", _clean_address(F.col("raw")).alias("email"))
    first = (
        clean.where(_allowed(F.col("email")))
        .groupBy("site_key", "email")
        .agg(F.min(F.struct("page_order", "pos")).alias("first"))
        .withColumn("score", _priority(F.col("email")))
    )
    order = W.partitionBy("site_key").orderBy(F.desc("score"), F.asc("first"))
    top = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    # At most ``keep`` rows per site reach the list.
    return top.groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("rank", "email"))).alias("l")).select(
        "site_key", F.col("l.email").alias("emails")
    )


# ---- site quality and parking ----


@dataclass(frozen=True)
class QualityWords:
    cta: tuple[str, ...] = fv.CTA_WORDS
    services: tuple[str, ...] = fv.SERVICE_HINTS
    address: tuple[str, ...] = ("besöksadress", "adress", "postadress")
    platforms: tuple[str, ...] = fv.PLATFORM_MARKS
    contact: str = "kontakt"
    min_words: int = 250


def site_quality_score(pages: DataFrame, words: QualityWords = QualityWords()) -> DataFrame:
    """Adds ``site_score`` (1 to 10) and ``site_flags`` (failed checks, in check order)."""
    low = _lower(pages)
    has_contact = (
        low.rlike(_EMAIL) | low.rlike(fv.PHONE_PATTERN) | low.contains("<form") | low.contains(words.contact)
    )
    service_links = F.size(F.filter(H.hrefs(low), lambda h: any_contains(h, words.services)))
    has_number = low.rlike(rf"{H.NOT_BEFORE}[0-9]{{6}}-[0-9]{{4}}{H.NOT_AFTER}")
    n_words = H.word_count(H.visible_text(low, comments=False))
    checks = [
        ("no_https", 2, F.col("url").startswith("https://")),
        ("no_contact", 2, has_contact),
        ("low_cta", 1, hit_count(low, words.cta) >= 2),
        ("few_service_links", 1, service_links >= 2),
        ("no_orgnr_or_address", 1, has_number | any_contains(low, words.address)),
        ("few_images", 1, (F.regexp_count(low, F.lit("<img")) >= 3) | low.contains("og:image")),
        ("thin_content", 1, n_words >= words.min_words),
        ("unknown_tech", 1, any_contains(low, words.platforms)),
    ]
    ok = pages.withColumn("_ok", F.array(*[c for _, _, c in checks]))
    points = reduce(lambda a, b: a + b, [F.when(F.col("_ok")[i], p).otherwise(0) for i, (_, p, _) in enumerate(checks)])
    failed = F.filter(
        F.zip_with("_ok", string_array([n for n, _, _ in checks]), lambda o, n: F.when(~o, n)), lambda x: x.isNotNull()
    )
    return ok.withColumns({"site_score": F.greatest(F.lit(1), F.least(F.lit(10), points)), "site_flags": failed}).drop("_ok")


def parked_site_flag(pages: DataFrame, strong: Sequence[str] = fv.PARKED_STRONG, weak: Sequence[str] = fv.PARKED_WEAK) -> DataFrame:
    """Adds ``parked``: a strong phrase, or at least two weak ones."""
    low = _lower(pages)
    return pages.withColumn("parked", any_contains(low, strong) | (hit_count(low, weak) >= 2))


# ---- technology ----


@dataclass(frozen=True)
class TechWords:
    categories: tuple[tuple[str, ...], ...] = tuple(fv.PRODUCT_CATEGORIES.values())
    mail: tuple[str, ...] = fv.MAIL_WORDS
    cloud: tuple[str, ...] = fv.CLOUD_RESOURCE_HINTS
    support_strong: tuple[str, ...] = fv.IT_SUPPORT_STRONG
    support_medium: tuple[str, ...] = fv.IT_SUPPORT_MEDIUM


def _error(pages: DataFrame) -> Column:
    return F.col("fetch_error") if "fetch_error" in pages.columns else F.lit("")


def _read_pages(pages: DataFrame) -> DataFrame:
    """site_key, page_order, url, html, err ('' when read), home (NULL when unknown)."""
    home = F.col("is_home") if "is_home" in pages.columns else F.lit(None).cast("boolean")
    return pages.select(
        "site_key", "page_order", "url", "html", F.coalesce(_error(pages), F.lit("")).alias("err"), home.alias("home")
    )


def _home_error() -> Column:
    """Aggregate: the error of the home page (the first page when none is marked)."""
    return F.coalesce(F.min_by("err", F.when(F.col("home"), F.col("page_order"))), F.min_by("err", "page_order"))


def tech_signal(pages: DataFrame, dns_facts: DataFrame, words: TechWords = TechWords()) -> DataFrame:
    """Per site: Microsoft status, strength, confidence; IT-support signal and confidence.

    ``dns_facts``: site_key, cloud_mail. Sites with a timeout give no row; an unreadable home page gives unknown.
    """
    read = _read_pages(pages)
    text = F.when(F.col("err") == "", H.visible_text(_lower(read))).otherwise("")
    groups = {f"c{i}": w for i, w in enumerate(words.categories)}
    groups.update(mail=words.mail, cloud=words.cloud, strong=words.support_strong, medium=words.support_medium)
    narrow = read.withColumn("text", text).select(
        "site_key", "page_order", "err", "home", *[any_contains(F.col("text"), w).alias(k) for k, w in groups.items()]
    )
    site = narrow.groupBy("site_key").agg(
        *[F.bool_or(k).alias(k) for k in groups], F.bool_or(F.col("err") == "timeout").alias("timeout"),
        _home_error().alias("home_err"),
    )
    dns = dns_facts.groupBy("site_key").agg(F.bool_or("cloud_mail").alias("cloud_mail"))
    n = reduce(lambda a, b: a + b, [F.col(f"c{i}").cast("int") for i in range(len(words.categories))])
    unreadable = F.col("home_err") != ""
    strong, dns_hit = F.col("n") >= 2, F.coalesce(F.col("cloud_mail"), F.lit(False))
    weak = F.col("mail") | (F.col("n") == 1)
    status = F.when(unreadable, "unknown").when(strong | dns_hit | weak, "yes").otherwise("no")
    strength = F.when(unreadable, F.lit(None)).when(strong, "strong").when(dns_hit | weak, "weak")
    confidence = (
        F.when(unreadable, "low")
        .when(strong, F.when(F.col("cloud") | (F.col("n") >= 3), "high").otherwise("medium"))
        .when(dns_hit, "high")
        .when(F.col("mail"), "medium")
        .otherwise("low")
    )
    support = F.when(unreadable, "unknown").when(F.col("strong") | F.col("medium"), "yes").otherwise("no")
    support_conf = F.when(unreadable, "low").when(F.col("strong"), "high").when(F.col("medium"), "medium").otherwise("low")
    error = F.when(F.col("home_err").isin("", "403", "429", "not_html"), F.col("home_err")).otherwise("other")
    return (
        site.where(~F.col("timeout"))
        .withColumn("n", n)
        .join(dns, "site_key", "left")
        .select(
            "site_key", error.alias("err_reason"), status.alias("microsoft_status"), strength.alias("microsoft_strength"),
            confidence.alias("microsoft_confidence"), support.alias("it_support_signal"), support_conf.alias("it_support_confidence"),
        )
    )


# ---- hiring ----


@dataclass(frozen=True)
class HiringWords:
    keywords: tuple[str, ...] = fv.HIRING_KEYWORDS
    triggers: tuple[str, ...] = fv.ROLE_TRIGGERS
    fillers: tuple[str, ...] = fv.ROLE_FILLERS
    generic: tuple[str, ...] = fv.GENERIC_NOT_ROLES
    links: LinkWords = LinkWords()


def role_phrases(text: Column, words: HiringWords = HiringWords()) -> Column:
    """Role names after the trigger words: up to 90 characters, cut at punctuation, fillers removed."""
    raw = F.concat(*[
        F.regexp_extract_all(text, F.lit(f"{H.NOT_BEFORE}{t}(.{{0,90}})"), F.lit(1)) for t in words.triggers
    ])
    fillers = f"{H.NOT_BEFORE}({'|'.join(words.fillers)}){H.NOT_AFTER}"

    def clean(c: Column) -> Column:
        head = F.regexp_extract(full_strip(c), r"^([^.!?|;:()\[\]{\\/]*)", 1)
        return H.squeeze(F.regexp_replace(H.squeeze(head), fillers, ""))

    def role(c: Column) -> Column:
        return (
            F.length(c).between(3, 60) & ~c.isin(*words.generic) & ~any_contains(c, ("cookie", "integritet", "privacy"))
            & ~c.rlike(_EMAIL) & c.rlike("[a-zåäö]")
        )

    return F.array_distinct(F.filter(F.transform(raw, clean), role))


def hiring_signal(pages: DataFrame, words: HiringWords = HiringWords()) -> DataFrame:
    """Per site: hiring_status yes / maybe_external / no / unknown, roles, count, evidence, external links.

    The first page (in order, the home page excepted) with a hiring keyword and either role phrases or an internal
    job link decides. The home page is the first one marked, else the first of the site; it supplies the external
    links. A site gives no row if its home page timed out, or a page before the deciding one (any, when none decides).
    """
    read = _read_pages(pages)
    low = F.when(F.col("err") == "", _lower(read)).otherwise("")
    step = read.withColumn("low", low).withColumn("text", H.visible_text(F.col("low")))
    relevant = any_contains(F.col("text"), words.keywords)
    step = step.withColumn("links", _absolute_links(F.col("url"), F.col("low"))).select(
        "site_key", "page_order", "url", "err", "home",
        F.when(relevant, role_phrases(F.col("text"), words)).alias("roles"),
        F.when(
            relevant,
            F.size(F.array_distinct(F.filter(
                "links", lambda u: (H.url_host(u) == H.url_host(F.col("url"))) & _is_job(u, words.links)
            ))),
        ).alias("jobs"),
        F.slice(
            F.array_distinct(F.filter("links", lambda u: any_contains(H.url_host(u), words.links.job_domains))),
            1, words.links.max_external,
        ).alias("ext"),
    )
    homes = read.groupBy("site_key").agg(F.coalesce(F.min(F.when(F.col("home"), F.col("page_order"))), F.min("page_order")).alias("home_order"))
    step = lookup_join(step.drop("home"), homes, ["site_key"], ["page_order"])
    at_home = F.col("page_order") == F.col("home_order")
    yes = ~at_home & ((F.size("roles") > 0) | (F.col("jobs") > 0))
    of_home = lambda c: F.min_by(c, F.when(at_home, F.col("page_order")))
    decision = F.struct(
        "page_order", "url",
        F.substring(F.array_join(F.slice("roles", 1, 12), "; "), 1, 500).alias("what"),
        F.when(F.size("roles") > 0, F.size("roles")).otherwise(F.col("jobs")).alias("n"),
    )
    site = step.groupBy("site_key").agg(
        F.min_by(decision, F.when(yes, F.col("page_order"))).alias("d"),
        of_home("ext").alias("ext"), of_home("err").alias("home_err"),
        F.min(F.when(~at_home & (F.col("err") == "timeout"), F.col("page_order"))).alias("late"),
    )
    unreadable, hit, external = F.col("home_err") != "", F.col("d").isNotNull(), F.size("ext") > 0
    error = F.when(F.col("home_err").isin("", "403", "429", "not_html"), F.col("home_err")).otherwise("other")
    in_time = F.col("late").isNull() | (hit & (F.col("d.page_order") < F.col("late")))
    return site.where((F.col("home_err") != "timeout") & (unreadable | in_time)).select(
        "site_key", error.alias("err_reason"),
        F.when(unreadable, "unknown").when(hit, "yes").when(external, "maybe_external").otherwise("no").alias("hiring_status"),
        F.when(~unreadable & hit, F.col("d.what")).otherwise("").alias("hiring_what_text"),
        F.when(unreadable, F.lit(None)).when(hit, F.col("d.n")).when(external, F.lit(None)).otherwise(0).cast("int").alias("hiring_count"),
        F.when(unreadable, "").when(hit, F.col("d.url")).when(external, F.get("ext", F.lit(0))).otherwise("").alias("evidence_url"),
        F.when(unreadable, F.array().cast("array<string>")).otherwise(F.col("ext")).alias("external_job_urls"),
    )


# ---- finding a company's site ----


def clean_company_name(name: Column, suffixes: Sequence[str] = fv.NAME_SUFFIXES) -> Column:
    s = full_strip(F.lower(F.coalesce(name, F.lit(""))))
    for suffix in suffixes:  # each at most once, in this order
        s = F.trim(F.regexp_replace(s, f"{suffix}$", ""))
    s = F.translate(F.replace(s, F.lit("&"), F.lit(" och ")), "åäöé", "aaoe")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), r"\s+", " "))


def domain_candidates(companies: DataFrame, tlds: Sequence[str] = fv.TLDS, stop_words: Sequence[str] = fv.NAME_STOP_WORDS,
                      max_slugs: int = 12) -> DataFrame:
    """orgnr, rank, domain: name variants x top-level domains x bare/www, in order, without repeats."""
    step = companies.select("orgnr", clean_company_name(F.col("name")).alias("n"))
    step = step.withColumn("w", F.filter(F.split("n", " "), lambda w: w != ""))
    step = step.withColumn("f", F.filter("w", lambda w: ~w.isin(*stop_words)))
    at_least = lambda s, n: F.when(F.length(s) >= n, s)
    heads = [F.col("f")] + [F.slice("f", 1, k) for k in (1, 2, 3)]
    slugs = [at_least(F.replace("n", F.lit(" ")), 4), at_least(F.replace("n", F.lit(" "), F.lit("-")), 4)]
    for words in heads:
        slugs += [at_least(F.array_join(words, ""), 3), at_least(F.array_join(words, "-"), 3)]
    letters = F.transform(F.filter("f", lambda w: F.length(w) >= 2), lambda w: F.left(w, F.lit(1)))
    slugs += [F.when(F.size(letters) >= 3, F.array_join(letters, sep)) for sep in ("", "-")]
    usable = F.filter(F.array(*slugs), lambda s: s.isNotNull() & (F.length(s) <= 40))
    chosen = F.slice(F.array_distinct(usable), 1, max_slugs)
    forms = F.flatten(F.transform(chosen, lambda s: F.array(
        *[F.concat(F.lit(www), s, F.lit(f".{t}")) for t in tlds for www in ("", "www.")]
    )))
    return step.select("orgnr", F.posexplode(F.array_distinct(forms)).alias("rank", "domain"))


def probe_result_pick(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """orgnr, found_website, status found / parked / not_found, err_reason from (domain, ok, parked, err).

    The first reachable, non-parked candidate wins. Nothing found after a timeout gives no row (retried later).
    ``candidates`` is read twice: hand in a stored table.
    """
    # A common name part makes one domain a candidate of very many companies.
    rows = lookup_join(candidates, staged(probes), ["domain"], ["orgnr"]).where(F.col("ok").isNotNull())
    failed = ~F.col("ok") & F.coalesce(F.col("err") != "", F.lit(False))
    word = F.when(F.col("err").isin("403", "429", "timeout"), F.col("err")).otherwise("other")
    good = F.col("ok") & ~F.col("parked")
    site = rows.groupBy("orgnr").agg(
        F.min_by(F.concat(F.lit("https://"), F.col("domain")), F.when(good, F.col("rank"))).alias("url"),
        F.bool_or(F.col("ok") & F.col("parked")).alias("any_parked"),
        F.bool_or(failed & (word == "timeout")).alias("any_timeout"),
        F.max_by(word, F.when(failed, F.col("rank"))).alias("last_err"),
    )
    found = F.col("url").isNotNull()
    return site.where(found | ~F.col("any_timeout")).select(
        "orgnr", F.coalesce("url", F.lit("")).alias("found_website"),
        F.when(found, "found").when(F.col("any_parked"), "parked").otherwise("not_found").alias("status"),
        F.when(found, "").otherwise(F.coalesce("last_err", F.lit(""))).alias("err_reason"),
    )
