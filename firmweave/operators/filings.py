"""Annual-report documents: facts and validation.

Tags are found by pattern and paired by depth, not by an XML parser: it tolerates broken markup, stays inside the
JVM and reads each document whole. Comments do not count; CDATA is text.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.functions.html import unescape, without_comments
from firmweave.functions.text import SPACES, digits_only, full_strip
from firmweave.session import lookup_join, staged


# Attribute values may hold ">"; possessive, so a broken tag costs one pass.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TAG = rf"</?ix:non(?:Fraction|Numeric)(?:\s{_ATTRIBUTES})?/?>"
_ANY_TAG = rf"</?[a-zA-Z_]{_ATTRIBUTES}>"
_ROOT = r"""^(?:[^<]++|<[?!][^>]*+>)*+<[a-zA-Z_](?:[^>"']|"[^"]*"|'[^']*')*?\sxmlns:ix\s*="""


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute; other values that look like it do not count. Empty when there is none."""
    pattern = rf"""^<[^\s>]+(?:\s+[^\s=>"']+\s*=\s*(?:"[^"]*"|'[^']*'))*?\s+{name}\s*=\s*("[^"]*"|'[^']*')"""
    quoted = F.regexp_extract(tag, pattern, 1)
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _plain_markup(doc: Column) -> Column:
    """Documents without comments, and with CDATA sections as the escaped text they stand for. Whichever begins first counts."""
    sections = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"

    def text_of(section: Column) -> Column:
        inner = F.substring(section, F.lit(10), F.length(section) - 12)
        for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(raw), F.lit(named))
        return F.when(section.startswith("<!--"), "").otherwise(inner)

    texts = F.transform(F.regexp_extract_all(doc, F.lit(sections), F.lit(0)), text_of)
    unwrapped = F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(doc, sections, -1).alias("a"), texts.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")
    return F.when(doc.contains("<![CDATA["), unwrapped).when(doc.contains("<!--"), without_comments(doc, "")).otherwise(doc)


def _with_tags(filings: DataFrame) -> DataFrame:
    """Adds the fact tags in document order (_tags), the text around them (_parts, one more), names and depth steps."""
    step = filings.withColumn("_doc", _plain_markup(F.col("xhtml"))).withColumns(
        {"_tags": F.regexp_extract_all("_doc", F.lit(_TAG), F.lit(0)), "_parts": F.split("_doc", _TAG, -1)}
    )
    named = lambda kind, t: F.concat(F.lit(f"{kind} "), _attribute(t, "name"))
    return step.withColumns(
        {
            "_names": F.transform("_tags", lambda t: F.when(t.startswith("</"), "").when(
                t.startswith("<ix:nonFraction"), named("nonFraction", t)).otherwise(named("nonNumeric", t))),
            "_steps": F.transform("_tags", lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)),
        }
    )


def _first(kind: str, name: str) -> Column:
    """The first element of that kind and name as struct(scale, text); NULL when there is none.

    The end tag is the one at which the depth falls below that of the start, so the text of nested elements
    belongs to it. An element that is never closed has no text.
    """
    at = F.array_position("_names", f"{kind} {name}").cast("int")
    after = F.slice("_steps", at + 1, F.size("_steps"))
    counted = F.aggregate(
        after, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
        lambda acc, s: F.when(acc["depth"] == 0, acc).otherwise(F.struct((acc["depth"] + s).alias("depth"), (acc["n"] + 1).alias("n"))),
        lambda acc: F.when(acc["depth"] == 0, acc["n"]),
    )
    n = F.when(F.get("_steps", at - 1) == 0, 0).when(F.get("_steps", at) == -1, 1).otherwise(counted)
    tag = F.get("_tags", at - 1)
    body = F.regexp_replace(F.array_join(F.slice("_parts", at + 1, n), ""), _ANY_TAG, "")
    text = full_strip(F.when(body.contains("&"), unescape(body)).otherwise(body))
    return F.when(at > 0, F.struct(_attribute(tag, "scale").alias("scale"), text.alias("text")))


def compact_number(raw: Column) -> Column:
    """Number text without blanks, with a decimal point."""
    return F.replace(F.regexp_replace(raw, f"[{SPACES}]+", ""), F.lit(","), F.lit("."))


def plain_number(compact: Column) -> Column:
    return F.when(compact.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), compact.try_cast("double"))


def power_of_ten(scale: Column) -> Column:
    """10 to the scale; 1 when the scale is no whole number."""
    power = F.when(scale.rlike("^[+-]?[0-9]+$"), scale.try_cast("int"))
    return F.pow(F.lit(10.0), F.coalesce(power, F.lit(0)))


def filing_read(filings: DataFrame, facts: Mapping[str, str] = fv.FILING_FACTS) -> DataFrame:
    """One pass over the documents: each becomes a narrow row of its facts and of what it says about itself.

    Whole kronor by half-even rounding, the equity ratio in percent. Nothing after this touches document text.
    """
    step = _with_tags(filings).withColumns({f"_t_{c}": _first("nonFraction", tag) for c, tag in facts.items()})
    # One projection per step, so that no pattern runs twice for a value.
    step = step.withColumns({f"_s_{c}": compact_number(F.col(f"_t_{c}.text")) for c in facts})
    step = step.withColumns(
        {f"_v_{c}": plain_number(F.col(f"_s_{c}")) * power_of_ten(F.trim(f"_t_{c}.scale")) for c in facts}
    )
    cols = {
        c: F.col(f"_v_{c}") * 100.0 if c == "solidity_pct" else F.rint(f"_v_{c}").cast("bigint") for c in facts
    }
    says = lambda name: F.coalesce(_first("nonNumeric", name)["text"], F.lit(""))
    return step.select(
        "orgnr", "end_date", "source_file",
        digits_only(says(fv.FILING_ORGNR)).alias("doc_orgnr"), says(fv.FILING_END).alias("doc_end"),
        F.col("_doc").rlike(_ROOT).alias("has_tags"),
        *[v.alias(k) for k, v in cols.items()],
    )


def filing_fact_extract(filings: DataFrame, facts: Mapping[str, str] = fv.FILING_FACTS) -> DataFrame:
    """Documents (or rows already read) -> financial rows."""
    rows = filing_read(filings, facts) if "xhtml" in filings.columns else filings
    return rows.select(
        "orgnr", F.col("end_date").try_cast("date").alias("fiscal_year_end_date"),
        F.left("end_date", F.lit(4)).try_cast("int").alias("fiscal_year_end_year"), *facts, "source_file",
    )


def filing_validate(
    filings: DataFrame, companies: DataFrame, loaded: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(accepted rows with their facts, rejects with reason, counts per reason, unknown companies in order).

    ``loaded``: orgnr, end_date. Of several documents with one key the first by source file is accepted.
    """
    rows = staged(filing_read(filings)) if "xhtml" in filings.columns else filings
    known = companies.select("orgnr").distinct().withColumn("_known", F.lit(True))
    done = loaded.select("orgnr", "end_date").distinct().withColumn("_done", F.lit(True))
    before_reading = (
        F.when(~F.col("orgnr").rlike("^[0-9]{10}$"), "bad_key")
        .when(F.col("_known").isNull(), "unknown_company")
        .when(F.col("_done").isNotNull(), "already_loaded")
    )
    own = (
        F.when(~F.col("has_tags"), "parse_error")
        .when((F.col("doc_orgnr") != "") & (F.col("doc_orgnr") != F.col("orgnr")), "key_mismatch")
        .when((F.col("doc_end") != "") & (F.col("doc_end") != F.col("end_date")), "date_mismatch")
    )
    # One company, or copies of one document, may be a large part of all documents.
    checked = lookup_join(rows, known, ["orgnr"], ["source_file"])
    checked = lookup_join(checked, done, ["orgnr", "end_date"], ["source_file"])
    checked = staged(checked.withColumn("reason", F.coalesce(before_reading, own)).withColumn("_early", before_reading.isNotNull()).drop("_known", "_done"))
    key = ["orgnr", "end_date", "source_file"]
    # Documents after the first accepted one of their key are not read, whatever they hold.
    first = checked.where(F.col("reason").isNull()).groupBy("orgnr", "end_date").agg(F.min("source_file").alias("_first"))
    late = ~F.col("_early") & (F.col("source_file") > F.col("_first"))
    judged = lookup_join(checked, first, ["orgnr", "end_date"], ["source_file"]).withColumn(
        "reason", F.when(late, "already_loaded").otherwise(F.coalesce("reason", F.lit("accepted")))
    ).drop("_first", "_early")
    accepted = judged.where("reason = 'accepted'").drop("reason")
    rejects = judged.where("reason <> 'accepted'").select(*key, "reason")
    counts = judged.groupBy("reason").agg(F.count("*").alias("n"))
    unknown = judged.where("reason = 'unknown_company'").select("orgnr").distinct().orderBy("orgnr")
    return accepted, rejects, counts, unknown
