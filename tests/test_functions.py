from html import unescape
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from firmweave.functions import html as H
from firmweave.functions import text as T
from firmweave.functions import times


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v"))).first()[0]


def test_blank_rules(spark):
    assert [one(spark, v, T.is_blank) for v in (None, "", "  ", "\t", "x")] == [True, True, True, False, False]
    assert [one(spark, v, T.blank_to_null) for v in (None, " \t ", " a ")] == [None, None, "a"]
    assert one(spark, "__NO_SNI__", T.blank_to_null) == "__NO_SNI__"


def test_strip_is_the_unicode_one(spark):
    import sys

    spaces = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
    assert sorted(T.SPACE_CHARS) == sorted(spaces)
    assert one(spark, spaces + " a\u00a0b " + spaces, T.full_strip) == "a\u00a0b"
    assert one(spark, "a" + spaces + "b" + spaces, T.squeeze) == "a b"


def test_int_or_null(spark):
    assert [one(spark, v, T.int_or_null) for v in (" 12 ", "-3", "4.0", "", None, "many")] == [12, None, None, None, None, None]


def test_list_items(spark):
    cases = {
        '["a@x.se", " b@x.se ", ""]': ["a@x.se", "b@x.se"], "a@x.se, b@x.se,": ["a@x.se", "b@x.se"], "a@x.se": ["a@x.se"],
        "": [], "[broken, x": ["[broken", "x"],
    }
    for text, want in cases.items():
        assert one(spark, text, T.list_items) == want, text
    assert one(spark, None, T.list_items) == []


def test_hosts_and_schemes(spark):
    good = ["a.se", "x-y.example.com", "A.SE."]
    bad = ["", "localhost", "a..se", "-a.se", "a-.se", "å.se", "a b.se", "x" * 64 + ".se", ".".join(["abcdefgh"] * 30)]
    assert all(one(spark, h, T.valid_host) for h in good)
    assert not any(one(spark, h, T.valid_host) for h in bad)
    assert one(spark, None, T.valid_host) is False
    assert [one(spark, u, T.with_scheme) for u in ("a.se", "http://a.se", " ")] == ["https://a.se", "http://a.se", ""]


def test_instants(spark):
    same = ["2026-01-10T15:52:58Z", "2026-01-10T17:52:58+02:00", "2026-01-10 15:52:58", "2026-01-10T15:52:58"]
    assert {one(spark, s, lambda c: times.iso_z(times.instant(c))) for s in same} == {"2026-01-10T15:52:58Z"}
    for s in ("", "soon", None, "15:52", "2026"):
        assert one(spark, s, times.instant) is None


def test_resolve_like_a_browser(spark):
    base = "https://Site.se/a/b/page.html?x=1#f"
    links = [
        "https://other.se/p", "//cdn.se/x", "/root", "rel", "rel/sub?q=1", "?only=query", "../up", "./same", "../../../top", "a/./b/../c",
        "ftp://f.se/z", "/a/../b/", "..", "/x/..", "rel#frag",
    ]
    for link in links:
        df = spark.createDataFrame([(base, link)], "b string, l string")
        assert df.select(H.resolve(F.col("b"), F.col("l"))).first()[0] == urljoin(base, link), link
    assert one(spark, "rel", lambda c: H.resolve(F.lit("https://site.se"), c)) == urljoin("https://site.se", "rel")


def test_url_parts(spark):
    for u in ("https://U:p@Host.se:80/p/a?q=1#f", "http://h.se", "h.se/x", "mailto:a@b.se"):
        parts = urlsplit(u)
        assert one(spark, u, H.url_host) == (parts.hostname or "")
        assert one(spark, u, H.url_query) == parts.query
        if parts.scheme != "mailto":
            assert one(spark, u, H.url_path) == parts.path


def test_unescape_and_unquote(spark):
    assert one(spark, "a&#64;b&#x2E;se &amp;amp; &commat;", H.unescape) == "a@b.se &amp; @"
    for raw in ("&#128512;", "&#x1F600;&#x41;", "&#0;", "&#xD800;", "&#00000000065;", "&#99999999999999999999;", "&#x110000;"):
        assert one(spark, raw, H.unescape) == unescape(raw), raw
    assert one(spark, "100% a%40b.se c+d %zz", H.unquote) == "100% a@b.se c+d %zz"


def test_visible_text(spark):
    page = "<html><style>p{}</style><p>a  b</p><script>x<y</script><!-- c --><b> d</b>"
    assert one(spark, page, H.visible_text) == "a b d"
    assert one(spark, "", lambda c: H.word_count(H.visible_text(c))) == 0
