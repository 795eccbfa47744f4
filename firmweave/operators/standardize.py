"""Projections and standardisation of register rows, dates, size classes and payloads."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.functions.text import blank_to_null, col, digits_only, full_strip, int_or_null
from firmweave.functions.times import instant, iso_z
from firmweave.session import lookup_join


def _cell(name: str) -> Column:
    """A register cell without outer spaces and quotes."""
    return F.regexp_replace(full_strip(F.coalesce(F.col(name), F.lit(""))), '^"+|"+$', "")


def _sub_field(cell: Column, index: int) -> Column:
    return F.get(F.split(cell, r"\$", -1), F.lit(index))


def legal_form(text: Column, rules=fv.LEGAL_FORMS, other: str = fv.LEGAL_FORM_OTHER) -> Column:
    """First matching rule wins; NULL for no text."""
    s = F.upper(text)
    chain = F.when(text.isNull(), F.lit(None).cast("string"))
    for result, parts, prefixes in rules:
        hit = reduce(
            lambda a, b: a | b, [s.contains(p) for p in parts] + [s.startswith(p) for p in prefixes]
        )
        chain = chain.when(hit, F.lit(result))
    return chain.otherwise(F.lit(other))


def register_standardize(bulk: DataFrame) -> DataFrame:
    """Bulk register rows -> orgnr, name, postort, registration_date, legal_form, company_status."""
    ident = _cell("organisationsidentitet")
    orgnr = digits_only(_sub_field(ident, 0))
    first = lambda name: blank_to_null(_sub_field(_cell(name), 0))
    name = blank_to_null(_sub_field(F.get(F.split(_cell("organisationsnamn"), r"\|", -1), F.lit(0)), 0))
    extra = [c for c in ("row_order",) if c in bulk.columns]
    return bulk.where((_sub_field(ident, 1) == "ORGNR-IDORG") & (F.length(orgnr) == 10)).select(
        orgnr.alias("orgnr"),
        name.alias("name"),
        blank_to_null(_sub_field(_cell("postadress"), 3)).alias("postort"),
        first("registreringsdatum").alias("registration_date"),
        legal_form(first("organisationsform")).alias("legal_form"),
        F.when(first("avregistreringsdatum").isNotNull(), "inactive").otherwise("active").alias("company_status"),
        *extra,
    )


# Clean column -> (candidate source columns in order of preference, kind).
MASTER_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "orgnr": (("orgnr",), "key"),
    "name": (("name",), "key"),
    "kommun": (("scb_municipality", "city"), "text"),
    "region": (("scb_region",), "text"),
    "postort": (("scb_postort",), "text"),
    "employees": (("employees",), "int"),
    "employees_class": (("scb_employees_class",), "text"),
    "workplaces_count": (("scb_workplaces_count",), "int"),
    "sni_codes": (("sni_codes",), "text"),
    "sni_text": (("sni_text",), "text"),
    "sni_groups": (("sni_groups",), "text"),
    "website": (("website",), "text"),
    "emails": (("emails",), "text"),
    "site_score": (("site_score",), "int"),
    "site_flags": (("site_flags",), "text"),
    "hiring_status": (("hiring_status",), "text"),
    "hiring_what_text": (("hiring_what_text",), "text"),
    "hiring_count": (("hiring_count",), "int"),
    "hiring_category": (("hiring_category",), "text"),
    "hiring_external_urls": (("hiring_external_urls",), "text"),
    "microsoft_status": (("microsoft_status",), "text"),
    "microsoft_strength": (("microsoft_strength",), "text"),
    "microsoft_confidence": (("microsoft_confidence",), "text"),
    "it_support_signal": (("it_support_signal",), "text"),
    "it_support_confidence": (("it_support_confidence",), "text"),
    "registration_date": (("scb_registration_date",), "text"),
    "legal_form": (("scb_legal_form",), "text"),
    "company_status": (("scb_company_status",), "text"),
    "sector": (("scb_sector",), "text"),
    "private_public": (("scb_private_public",), "text"),
    "line_of_work": (("line_of_work",), "text"),
    "line_of_work_raw": (("line_of_work_raw",), "text"),
    "line_of_work_conf": (("line_of_work_conf",), "double"),
    "line_of_work_bucket": (("line_of_work_bucket",), "text"),
    "line_of_work_source": (("line_of_work_source",), "text"),
    "line_of_work_updated_at": (("line_of_work_updated_at",), "text"),
    "last_seen_at": (("last_seen_at",), "text"),
    "created_at": (("created_at",), "text"),
    "updated_at": (("updated_at",), "text"),
}


def master_projection(old: DataFrame, columns: Mapping[str, tuple] = MASTER_COLUMNS) -> DataFrame:
    """Any older company layout -> the clean one. Missing columns and blanks become NULL, markers survive."""
    kinds = {"text": "string", "key": "string", "int": "bigint", "double": "double"}

    def pick(sources: Sequence[str], kind: str) -> Column:
        there = [c for c in sources if c in old.columns]
        if not there:
            return F.lit("") if kind == "key" else F.lit(None).cast(kinds[kind])
        if kind == "int":
            return F.coalesce(*[int_or_null(c) for c in there])
        if kind == "double":
            return F.coalesce(*[F.col(c).try_cast("double") for c in there])
        text = F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in there])
        return F.coalesce(text, F.lit("")) if kind == "key" else text

    return old.select(*[pick(*spec).alias(name) for name, spec in columns.items()])


def timestamp_standardize(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns as ``...Z`` text, one row of counts). Unparsable values stay as they are."""
    out, counts = {}, []
    for c in cols:
        text = F.col(c).cast("string")
        moment = instant(text)
        filled = ~(full_strip(F.coalesce(text, F.lit(""))) == "")
        out[c] = F.when(filled & moment.isNotNull(), iso_z(moment)).otherwise(text)
        counts += [
            F.count_if(filled & moment.isNull()).alias(f"{c}_skipped"),
            F.count_if(filled & moment.isNotNull() & (full_strip(text) != iso_z(moment))).alias(f"{c}_changed"),
        ]
    return df.withColumns(out), df.agg(*counts)


def span_of_code(code: Column, classes=fv.SIZE_CLASSES) -> Column:
    """First number in a size class code -> struct(lo, hi); NULL for an unknown one."""
    number = F.regexp_extract(F.coalesce(code, F.lit("")), "[0-9]+", 0).try_cast("int")
    chain = None
    for n, lo, hi in classes:
        pair = F.struct(F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi"))
        chain = F.when(number == n, pair) if chain is None else chain.when(number == n, pair)
    return chain


def span_of_text(text: Column) -> Column:
    """``0...`` -> (0, 0); ``a-b``; ``n+``; else NULL."""
    s = F.regexp_replace(F.lower(full_strip(F.coalesce(text, F.lit("")))), "–", "-")
    grab = lambda pattern, group: F.regexp_extract(s, pattern, group).try_cast("int")
    span, plus = r"([0-9]+)\s*-\s*([0-9]+)", r"([0-9]+)\s*\+"
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.cast("int").alias("hi"))
    return (
        F.when(s.startswith("0"), pair(F.lit(0), F.lit(0)))
        .when(s.rlike(span), pair(grab(span, 1), grab(span, 2)))
        .when(s.rlike(plus), pair(grab(plus, 1), F.lit(None)))
    )


def size_class_span(
    df: DataFrame,
    code: str = "employees_class_code",
    text: str = "employees_class",
    lo: str = "employees_min",
    hi: str = "employees_max",
) -> DataFrame:
    """Fill the employee span from code, else text, where both ends are missing."""
    span = F.coalesce(span_of_code(F.col(code).cast("string")), span_of_text(F.col(text)))
    both_missing = F.col(lo).isNull() & F.col(hi).isNull()
    return (
        df.withColumn("_span", F.when(both_missing, span))
        .withColumns(
            {
                lo: F.when(both_missing, F.col("_span.lo")).otherwise(F.col(lo)).cast("int"),
                hi: F.when(both_missing, F.col("_span.hi")).otherwise(F.col(hi)).cast("int"),
            }
        )
        .drop("_span")
    )


def code_table_fill(df: DataFrame, codes: DataFrame, code: str, text: str) -> DataFrame:
    """Fill a blank text column from its code. ``codes``: (code, label), one row per code."""
    lookup = codes.groupBy(full_strip("code").alias("_code")).agg(F.max("label").alias("_label"))
    keyed = df.withColumn("_code", full_strip(F.col(code).cast("string")))
    spread = [c for c in df.columns if c != code]
    filled = F.coalesce(blank_to_null(text), blank_to_null("_label"))
    return lookup_join(keyed, lookup, ["_code"], spread).withColumn(text, filled).select(*df.columns)


_CODE_ITEM = "struct<kod:string,code:string,klartext:string,text:string,beskrivning:string>"
_HOLDER = f"struct<sni:array<{_CODE_ITEM}>>"
INDUSTRY_PAYLOAD = (
    f"struct<naringsgrenOrganisation:{_HOLDER},naringsgrenar:{_HOLDER},sni:array<{_CODE_ITEM}>,naringsgren:{_HOLDER}>"
)


def industry_code_extract(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """orgnr, JSON answer with ``organisationer`` -> codes, texts, status; the first filled list of four."""
    answer = F.from_json(payload, f"struct<organisationer:array<{INDUSTRY_PAYLOAD}>>")
    org = F.get(F.col("_answer.organisationer"), F.lit(0))
    lists = [
        F.col("_org.naringsgrenOrganisation.sni"),
        F.col("_org.naringsgrenar.sni"),
        F.col("_org.sni"),
        F.col("_org.naringsgren.sni"),
    ]
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    first_filled = lambda *cs: F.coalesce(*[F.when(c != "", full_strip(c)) for c in cs], F.lit(""))
    pairs = F.filter(
        F.transform(
            chosen,
            lambda x: F.struct(
                first_filled(x["kod"], x["code"]).alias("k"),
                first_filled(x["klartext"], x["text"], x["beskrivning"]).alias("t"),
            ),
        ),
        lambda x: x["k"] != "",
    )
    step = payloads.withColumn("_answer", answer).withColumn("_org", org).withColumn("_pairs", pairs)
    none_found = F.col("_org").isNull()
    no_code = F.coalesce(F.size("_pairs"), F.lit(0)) < 1
    texts = F.filter(F.transform("_pairs", lambda x: x["t"]), lambda t: t != "")
    return step.select(
        "orgnr",
        F.when(none_found, F.lit(""))
        .when(no_code, F.lit(fv.NO_SNI))
        .otherwise(F.array_join(F.transform("_pairs", lambda x: x["k"]), ","))
        .alias("sni_codes"),
        F.when(none_found | no_code, F.lit("")).otherwise(F.array_join(texts, " | ")).alias("sni_text"),
        F.when(none_found, "not_found").when(no_code, "ok_no_sni").otherwise("ok").alias("status"),
    )


def region_name(county: Column) -> Column:
    s = F.regexp_replace(full_strip(county), " län| Län", "")
    return full_strip(F.regexp_replace(s, "Götalands", "Götaland"))


def payload_flatten(
    payloads: DataFrame, payload: str = "payload", keys: Mapping[str, Sequence[str]] = fv.PAYLOAD_KEYS,
    holders: Sequence[str] = ("", "foretag", "data", "result"),
) -> DataFrame:
    """JSON with unstable key spellings (at the top or in one of the declared holders) -> five facts."""
    doc = F.try_parse_json(payload)

    def first(fact: str) -> Column:
        paths = [f"$['{h}']['{k}']" if h else f"$['{k}']" for h in holders for k in keys[fact]]
        return F.coalesce(*[F.try_variant_get("_doc", p, "string") for p in paths])

    step = payloads.withColumn("_doc", doc).withColumns(
        {
            "_cls": blank_to_null(first("employees_class")),
            "_wp": int_or_null(first("workplaces_count")),
            "_ort": blank_to_null(first("postort")),
            "_mun": blank_to_null(first("municipality")),
            "_reg": blank_to_null(region_name(first("region"))),
        }
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(fv.UNKNOWN))
    any_fact = F.coalesce(F.col("_cls"), F.col("_wp").cast("string"), F.col("_ort"), F.col("_mun"), F.col("_reg"))
    return step.select(
        "orgnr",
        text("_cls").alias("employees_class"),
        F.col("_wp").alias("workplaces_count"),
        text("_ort").alias("postort"),
        text("_mun").alias("municipality"),
        text("_reg").alias("region"),
        F.when(any_fact.isNotNull(), "ok").otherwise(fv.UNKNOWN).alias("status"),
    )


def ownership_bucket(private_public: Column | str, sector: Column | str) -> Column:
    """public / private / unknown, from two texts."""
    part = lambda c: F.lower(full_strip(F.coalesce(col(c), F.lit(""))))
    blob = full_strip(F.concat_ws(" ", part(private_public), part(sector)))
    has = lambda words: reduce(lambda a, b: a | b, [blob.contains(w) for w in words])
    return F.when(has(fv.PUBLIC_WORDS), "offentlig").when(has(fv.PRIVATE_WORDS), "privat").otherwise(fv.UNKNOWN)
