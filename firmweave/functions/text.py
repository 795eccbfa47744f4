"""Text expressions."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in a full (Unicode) strip, as class and as list.
SPACES = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
SPACE_CHARS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_strip(c: Column | str) -> Column:
    """Strip all Unicode white space on both sides."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{SPACES}]+", " "))


def is_blank(c: Column | str) -> Column:
    """NULL, empty or spaces only (spaces, not all white space: the store-side rule)."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) == ""


def blank_to_null(c: Column | str) -> Column:
    """Fully stripped text, NULL when nothing is left."""
    s = full_strip(c)
    return F.when(s != "", s)


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def int_or_null(c: Column | str) -> Column:
    """Text of digits only -> bigint, else NULL."""
    s = full_strip(col(c).cast("string"))
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))


def any_contains(text: Column, words: Iterable[str]) -> Column:
    """Does the text contain any of the words (as substrings)?"""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def hit_count(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in the text at least once."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def string_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def csv_items(c: Column | str) -> Column:
    """Comma list -> array of stripped, non-empty items."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ",", -1), full_strip)
    return F.filter(parts, lambda x: x != "")


def list_items(c: Column | str) -> Column:
    """JSON array, comma list or single value -> array of stripped, non-empty items."""
    s = full_strip(F.coalesce(col(c), F.lit("")))
    parsed = F.filter(F.transform(F.from_json(s, "array<string>"), full_strip), lambda x: x != "")
    return F.when(s.startswith("[") & parsed.isNotNull(), parsed).otherwise(csv_items(s))


def valid_host(c: Column | str) -> Column:
    """At most 253 characters, at least two labels of letters, digits and inner hyphens."""
    host = F.rtrim(F.lower(F.trim(col(c))), F.lit("."))
    label = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    return F.coalesce((F.length(host) <= 253) & host.rlike(rf"^{label}(\.{label})+$"), F.lit(False))


def with_scheme(c: Column | str) -> Column:
    """A web address without http(s) scheme gets https."""
    s = full_strip(F.coalesce(col(c), F.lit("")))
    return F.when(s == "", s).when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def percent(n: Column, total: Column) -> Column:
    """Share in percent with one decimal; 0 for an empty total."""
    return F.when(total > 0, F.round(n * 100.0 / total, 1)).otherwise(F.lit(0.0))
