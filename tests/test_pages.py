import random
import re
import time

import pytest
from pyspark.sql import functions as F

from firmweave.functions import html as H
from firmweave.operators import pages as pg


def pages(spark, *items):
    """(site, order, url, html)"""
    return spark.createDataFrame(list(items), "site_key string, page_order int, url string, html string")


def test_links_first_seen_order_and_caps(spark, rows):
    many = "".join(f'<a href="/jobb/x{i}">' for i in range(30))
    ext = "".join(f'<a href="https://{d}/a">' for d in ("www.linkedin.com", "x.teamtailor.com", "jobs.lever.co", "se.indeed.com", "a.stepstone.se", "b.varbi.com"))
    home = f'<a href="#top"><a href="mailto:a@b.se"><a HREF="/KARRIAR"><a href="/karriar">{ext}<a href="/jobb/spontan"><a href="https://other.se/jobs/1">'
    df = pages(spark, ("s.se", 2, "https://s.se/p", many), ("s.se", 1, "https://S.se/", home))
    got = pg.link_extract(df)
    hints = rows(got.where("kind = 'internal_hint'"), "rank", "url")
    assert len(hints) == 25 and (1, "https://S.se/karriar") in hints and (2, "https://S.se/jobb/spontan") in hints
    assert got.where("kind = 'internal_job'").count() == 30
    assert [r.url for r in got.where("kind = 'external_job'").orderBy("rank").collect()] == [
        "https://www.linkedin.com/a", "https://x.teamtailor.com/a", "https://jobs.lever.co/a", "https://se.indeed.com/a", "https://a.stepstone.se/a"]


def mask(text, key=0x5A):
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)


def contacts(spark, *htmls):
    df = pages(spark, *[("s", i, "https://s.se", h) for i, h in enumerate(htmls)])
    r = pg.contact_extract(df).first()
    return r.emails if r else []


def test_contact_sources(spark):
    assert contacts(spark, f'<a data-cfemail="{mask("zoe@s.se")}">x</a>') == ["zoe@s.se"]
    assert contacts(spark, f'<a href="/cdn-cgi/l/email-protection#{mask("amy@s.se")}">x</a>') == ["amy@s.se"]
    assert contacts(spark, '<a class="x" href="mailto:Bob%40s.se?subject=hi">x</a>') == ["bob@s.se"]
    assert contacts(spark, '<p data-email="eve&#64;s.se">x</p>') == ["eve@s.se"]
    assert contacts(spark, "<p>joe [at] firm [dot] se</p>") == ["joe@firm.se"]
    assert contacts(spark, "<p>joe(at)firm.se</p>") == ["joe@firm.se"]
    assert contacts(spark, "<p>Mail: Kim@S.SE.</p>") == ["kim@s.se"]
    assert contacts(spark, "<p>nothing here</p>") == []


def test_contact_blocklist_priority_and_cap(spark):
    assert contacts(spark, "<p>noreply@s.se test@s.se x@example.com y@email.com logo@2x.png</p>") == []
    got = contacts(spark, "<p>anna@s.se hr@s.se info@s.se</p>", "<p>support@s.se info@s.se bo@s.se</p>")
    assert got == ["support@s.se", "info@s.se", "hr@s.se"]
    assert contacts(spark, "<p>cee@s.se</p>", "<p>aaa@s.se</p>") == ["cee@s.se", "aaa@s.se"]


def test_site_quality(spark):
    good = (
        '<a href="/tjanster"><a href="/service"> kontakta oss, boka en tid. Org 556677-8899 <img><img><img> wp-content ' + "ord " * 260
    )
    bad = "<p>hej</p>"
    df = pages(spark, ("a", 1, "https://a.se", good), ("b", 1, "http://b.se", bad), ("c", 1, "https://c.se", None))
    got = {r.site_key: (r.site_score, r.site_flags) for r in pg.site_quality_score(df).collect()}
    assert got["a"] == (10, [])
    assert got["b"] == (1, ["no_https", "no_contact", "low_cta", "few_service_links", "no_orgnr_or_address", "few_images", "thin_content", "unknown_tech"])
    assert got["c"][0] == 2


def test_parked(spark):
    df = pages(spark, ("a", 1, "", "Buy this DOMAIN"), ("b", 1, "", "sedo"), ("c", 1, "", "sedo and godaddy"))
    assert {r.site_key: r.parked for r in pg.parked_site_flag(df).collect()} == {"a": True, "b": False, "c": True}


def test_tech_signal(spark):
    dns = spark.createDataFrame([("mail", True), ("weak", False)], "site_key string, cloud_mail boolean")
    df = pages(
        spark, ("two", 1, "", "teams"), ("two", 2, "", "intune"), ("three", 1, "", "teams intune defender"), ("azure", 1, "", "teams <b>azure</b> x.azurewebsites.net"),
        ("mail", 1, "", "office 365"), ("weak", 1, "", "outlook"), ("one", 1, "", "sharepoint helpdesk"), ("none", 1, "", "it-drift <!-- teams azure -->"),
        ("err", 1, "", None), ("late", 1, "", "x"), ("late", 2, "", None),
    ).withColumn("fetch_error", F.when(F.col("site_key") == "err", "500").when((F.col("site_key") == "late") & (F.col("page_order") == 2), "timeout"))
    got = {r.site_key: tuple(r)[1:] for r in pg.tech_signal(df, dns).collect()}
    assert got == {
        "two": ("", "yes", "strong", "medium", "no", "low"), "three": ("", "yes", "strong", "high", "no", "low"),
        "azure": ("", "yes", "strong", "high", "no", "low"), "mail": ("", "yes", "weak", "high", "no", "low"),
        "weak": ("", "yes", "weak", "medium", "no", "low"), "one": ("", "yes", "weak", "low", "yes", "high"),
        "none": ("", "no", None, "low", "yes", "medium"), "err": ("other", "unknown", None, "low", "unknown", "low"),
    }


def test_role_phrases(spark):
    cases = {
        "vi söker en erfaren elektriker till vårt team! ring": ["en erfaren elektriker"],
        "vi söker  ekonom nu. vi söker ekonom. we're hiring nurses (oslo)": ["ekonom", "nurses"],
        "vi söker karriär": [], "vi söker ab": [], "vi söker 123 456": [], "vi söker cookie ansvarig": [], "navi söker x y z": [],
        # A trigger within the 90 characters after another belongs to it; an address is cut at its dot first.
        "vi söker svetsare. vi söker rörmokare": ["svetsare"], "vi söker a@b.se": ["a@b"],
    }
    for text, want in cases.items():
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(pg.role_phrases(F.col("t"))).first()[0] == want, text


def test_hiring_signal(spark):
    ext = '<a href="https://x.teamtailor.com/1">'
    df = spark.createDataFrame(
        [
            ("yes", 1, "https://yes.se/", "vi söker kockar." + ext, True, ""), ("yes", 3, "https://yes.se/c", "vi söker svetsare." + " -" * 50 + "vi söker rörmokare.", False, ""),
            ("yes", 2, "https://yes.se/b", "karriär", False, ""),
            ("links", 1, "https://links.se/", "hem", True, ""), ("links", 2, "https://links.se/jobs/", 'jobs <a href="/jobs/1"><a href="/jobs/1"><a href="/jobs/2"><a href="/jobs/spontan">', False, ""),
            ("maybe", 1, "https://maybe.se/", ext, True, ""), ("no", 1, "https://no.se/", "hem", True, ""), ("wall", 1, "https://w.se/", None, True, "403"),
            ("late", 1, "https://l.se/", "x", True, ""), ("late", 2, "https://l.se/", None, False, "timeout"), ("late", 3, "https://l.se/c", "vi söker kockar.", False, ""),
            ("soon", 1, "https://s.se/", "x", True, ""), ("soon", 2, "https://s.se/c", "vi söker kockar.", False, ""), ("soon", 3, "https://s.se/d", None, False, "timeout"),
            ("first", 1, "https://f.se/", "vi söker kockar.", None, ""), ("first", 2, "https://f.se/c", "hem", None, ""), ("gone", 1, "https://g.se/", None, None, "timeout"),
            ("wall2", 1, "https://v.se/", None, None, "429"), ("wall2", 2, "https://v.se/", None, None, "timeout"),
        ],
        "site_key string, page_order int, url string, html string, is_home boolean, fetch_error string",
    )
    got = {r.site_key: tuple(r)[1:] for r in pg.hiring_signal(df).collect()}
    assert got == {
        "yes": ("", "yes", "svetsare; rörmokare", 2, "https://yes.se/c", ["https://x.teamtailor.com/1"]),
        "links": ("", "yes", "", 2, "https://links.se/jobs/", []),
        "maybe": ("", "maybe_external", "", None, "https://x.teamtailor.com/1", ["https://x.teamtailor.com/1"]),
        "soon": ("", "yes", "kockar", 1, "https://s.se/c", []), "first": ("", "no", "", 0, "", []), "wall2": ("429", "unknown", "", None, "", []),
        "no": ("", "no", "", 0, "", []), "wall": ("403", "unknown", "", None, "", []),
    }


def test_domain_candidates(spark):
    df = spark.createDataFrame([("1", "Åkes Bygg & Måleri AB"), ("2", "X AB"), ("3", None), ("4", "Holding AB"), ("5", "Al Be Ce De")], "orgnr string, name string")
    got = {}
    for r in pg.domain_candidates(df).orderBy("orgnr", "rank").collect():
        got.setdefault(r.orgnr, []).append(r.domain)
    assert got["1"][:4] == ["akesbyggochmaleri.se", "www.akesbyggochmaleri.se", "akesbyggochmaleri.com", "www.akesbyggochmaleri.com"]
    slugs = [d[:-3] for d in got["1"] if d.endswith(".se") and not d.startswith("www.")]
    assert slugs == ["akesbyggochmaleri", "akes-bygg-och-maleri", "akesochmaleri", "akes-och-maleri", "akes", "akesoch", "akes-och", "aom", "a-o-m"]
    assert "2" not in got and "3" not in got
    assert [d for d in got["4"] if d.endswith(".se")] == ["holding.se", "www.holding.se"]
    assert "a-b-c-d.com" in got["5"] and len(got["5"]) <= 48


def test_probe_pick(spark):
    c = spark.createDataFrame([(o, i, f"{o}{i}.se") for o in "abcde" for i in range(3)], "orgnr string, rank int, domain string")
    answers = {
        "a0": (False, False, "403"), "a1": (True, False, ""), "a2": (True, False, ""), "b0": (True, True, ""), "b1": (False, False, "dns"), "b2": (False, False, ""),
        "c0": (False, False, "timeout"), "c1": (True, True, ""), "d0": (False, False, "403"), "d1": (False, False, "429"), "d2": (False, False, ""), "e0": (False, False, "timeout"), "e1": (True, False, ""),
    }
    p = spark.createDataFrame([(k + ".se", *v) for k, v in answers.items()], "domain string, ok boolean, parked boolean, err string")
    got = {r.orgnr: tuple(r)[1:] for r in pg.probe_result_pick(c, p).collect()}
    assert got == {"a": ("https://a1.se", "found", ""), "b": ("", "parked", "other"), "d": ("", "not_found", "429"), "e": ("https://e1.se", "found", "")}


# Broken pages: linear in their length, with the result of the plain patterns.


def test_markup_is_removed_as_plain_patterns_do(spark):
    rng = random.Random(7)
    bits = ["<", ">", "<script", "</script>", "<style>", "</style>", "<!--", "-->", "<!-->", "a", " ", "<b x='>'>", "<>", "é", "<SCRIPT>", "</Script>", "\n", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", H.without_markup(F.col("t")).alias("a"), H.without_markup(F.col("t"), False).alias("b"), H.without_markup(F.col("t"), any_case=True).alias("c")).collect()
    for r in got:
        for found, comments, flags in ((r.a, True, re.S), (r.b, False, re.S), (r.c, True, re.S | re.I)):
            want = r.t
            for p in ("<script.*?</script>", "<style.*?</style>"):
                want = re.sub(p, " ", want, flags=flags | re.A)
            want = re.sub("<!--.*?-->", " ", want, flags=re.S) if comments else want
            assert found == re.sub("<[^>]+>", " ", want), r.t


def test_mail_links_are_found_as_before(spark):
    rng = random.Random(8)
    bits = ["<a ", "<A\n", "href=", "HREF =", '"mailto:x@y.se"', "' mailto:b@c.se?s=1'", '"', "'", ">", "class=", "<a", " ", "mailto:q@r.se"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    pages_of = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "html string, page_order int")
    plain = re.compile(r"""<a\s[^>]*?href\s*=\s*("\s*mailto:[^"]*"|'\s*mailto:[^']*')""", re.I | re.S)
    got = {r.page_order: r.found for r in pages_of.select("page_order", pg.mail_links(F.col("html")).alias("found")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [re.search(r"""mailto:([^"'?]*)""", m[1], re.I)[1] for m in plain.finditer(t)], t


@pytest.mark.parametrize("piece", ["<", "<script", "<!--", "<style ", "<a ", "<a href=", "<!-->", "<script></script", "x@", "&#1"])
def test_a_broken_page_of_a_megabyte_takes_seconds(spark, piece):
    html = piece * (1_000_000 // len(piece))
    page = spark.createDataFrame([("s", 1, "https://s.se/", html, "")], "site_key string, page_order int, url string, html string, fetch_error string")
    start = time.time()
    assert pg.page_text_extract(page).count() == 1
    pg.page_text_extract(page).select(F.length("text")).collect()
    pg.address_sources(page).select(F.size("_sources")).collect()
    assert time.time() - start < 40


def test_probes_are_stored_before_they_are_measured_and_joined(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(pg, "staged", lambda df: seen.append(df.columns) or df, raising=False)
    candidates = spark.createDataFrame([("1", 0, "a.se"), ("1", 1, "b.se"), ("2", 0, "a.se")], "orgnr string, rank int, domain string")
    probes = spark.createDataFrame([("a.se", False, False, "403"), ("b.se", True, False, "")], "domain string, ok boolean, parked boolean, err string")
    got = rows(pg.probe_result_pick(candidates, probes))
    assert got == [("1", "https://b.se", "found", ""), ("2", "", "not_found", "403")]
    assert seen == [["domain", "ok", "parked", "err"]]
