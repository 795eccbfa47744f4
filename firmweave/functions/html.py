"""HTML and web address expressions. All patterns use explicit classes, so every regex engine agrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmweave.functions.text import full_strip, squeeze

WORD = r"\p{L}\p{N}_"
NOT_BEFORE = rf"(?<![{WORD}])"
NOT_AFTER = rf"(?![{WORD}])"
HREF = r"""href=["']([^"']+)["']"""

# Named characters that occur next to or inside addresses.
ENTITIES = (
    ("&nbsp;", " "), ("&commat;", "@"), ("&period;", "."), ("&lowbar;", "_"), ("&hyphen;", "‐"), ("&plus;", "+"),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(text: Column, pattern: str, closing: str, by: str = " ", any_case: bool = False) -> Column:
    """Replace the matches of a pattern that runs from an opening to the next ``closing``, in one pass whatever the text.

    Behind the last ``closing`` nothing can match, so that part isn't searched: in the rest every opening finds its end, and
    no place is read twice. The result is that of replacing in the whole text.
    """
    def cut(t: Column) -> Column:
        behind = F.length(F.substring_index(_lower_ascii(t) if any_case else t, closing, -1))
        return F.concat(F.regexp_replace(F.left(t, F.length(t) - behind), pattern, by), F.right(t, behind))

    return bound(text, cut)


def without_comments(text: Column, by: str = " ") -> Column:
    return without(text, "(?s)<!--.*?-->", "-->", by)


def without_markup(text: Column, comments: bool = True, any_case: bool = False) -> Column:
    """Scripts, styles, (comments) and tags become one space each. Unclosed ones stay."""
    flags = "(?is)" if any_case else "(?s)"
    for name in ("script", "style"):
        text = without(text, f"{flags}<{name}.*?</{name}>", f"</{name}>", any_case=any_case)
    return without(without_comments(text) if comments else text, "<[^>]+>", ">")


def visible_text(lower_html: Column, comments: bool = True) -> Column:
    """Lower-case HTML without scripts, styles, (comments) and tags; white space squeezed."""
    return squeeze(without_markup(lower_html, comments))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ", -1)))


def hrefs(lower_html: Column) -> Column:
    """Link targets in order, without fragments, mail and phone links."""
    found = F.transform(F.regexp_extract_all(lower_html, F.lit(HREF), F.lit(1)), full_strip)
    return F.filter(found, lambda h: (h != "") & ~h.rlike("^(#|mailto:|tel:)"))


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def url_host(u: Column) -> Column:
    """Host without user and port, lower case; empty if there is none."""
    place = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[0-9]*$", ""))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(joined == "/", joined).otherwise(F.concat(joined, tail))


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link on a page."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(url_path(base), r"^(.*/)", 1)
    own_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(own_path) + 1, F.length(href))
    full = F.when(href.startswith("/"), own_path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own_path)
    )
    plain = F.when(full.rlike(r"/\.\.?(/|$)"), _without_dots(full)).otherwise(full)
    return (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(url_scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(origin, plain, rest))
    )


def unescape(text: Column) -> Column:
    """Numeric characters and the named ones that matter for addresses."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([xX][0-9a-fA-F]+|[0-9]+);"), F.lit(1)))

    def units(*values: Column) -> Column:
        return F.decode(F.unhex(F.concat(*[F.lpad(F.hex(v), 4, "0") for v in values])), "UTF-16BE")

    def char(code: Column) -> Column:
        hexa = F.conv(F.substring(code, F.lit(2), F.length(code)), 16, 10)
        n = F.when(code.rlike("^[xX]"), hexa).otherwise(code).try_cast("int")
        rest = n - 65536
        pair = units(F.lit(0xD800) + F.shiftright(rest, 10), F.lit(0xDC00) + rest.bitwiseAND(0x3FF))
        return (
            F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0xFFFF), units(n))
            .when(n.between(0x10000, 0x10FFFF), pair).otherwise("\ufffd")
        )

    out = F.aggregate(
        numbers, text, lambda acc, m: F.replace(acc, F.concat(F.lit("&#"), m, F.lit(";")), char(m))
    )
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def unquote(text: Column) -> Column:
    """%XX decoding that leaves stray percent and plus signs alone."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)
