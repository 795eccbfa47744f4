from firmweave.functions import fixed_values as fv
from firmweave.operators import filings as fl

HEAD = '<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"><body>'


def fact(col, body, attrs=""):
    return f'<ix:nonFraction contextRef="c" name="{fv.FILING_FACTS[col]}" {attrs}>{body}</ix:nonFraction>'


def docs(spark, *items):
    return spark.createDataFrame(list(items), "orgnr string, end_date string, source_file string, xhtml string")


def test_facts(spark):
    body = HEAD + (
        fact("revenue_sek", "1 234 567,5", 'scale="0"') + fact("revenue_sek", "999") + fact("profit_sek", "-<b>12</b>", "scale='3'")
        + fact("assets_total_sek", "2,5") + fact("equity_total_sek", "3,5") + fact("solidity_pct", "91,5", 'unitRef="procent" scale="-2"')
        + fact("cash_sek", "n/a") + fact("liabilities_short_sek", "1&nbsp;000", 'scale="x"')
        + f'<ix:nonFraction name="{fv.FILING_FACTS["liabilities_long_sek"]}" xsi:nil="true"/>' + fact("result_after_fin_sek", "7")
        + '<ix:nonNumeric name="note"><p>' + fact("cash_sek", "5") + "</p></ix:nonNumeric><br><unclosed"
    )
    r = fl.filing_fact_extract(docs(spark, ("1", "2023-12-31", "f", body))).first()
    assert (r.revenue_sek, r.profit_sek, r.assets_total_sek, r.equity_total_sek) == (1234568, -12000, 2, 4)
    assert (r.solidity_pct, r.cash_sek, r.liabilities_short_sek, r.liabilities_long_sek, r.result_after_fin_sek) == (91.5, None, 1000, None, 7)
    assert str(r.fiscal_year_end_date) == "2023-12-31" and r.fiscal_year_end_year == 2023


def test_facts_of_legal_documents(spark):
    tag = fv.FILING_FACTS
    body = "<?xml version='1.0'?><!DOCTYPE html>" + HEAD + (
        f'<!-- <ix:nonFraction name="{tag["revenue_sek"]}">1</ix:nonFraction> -->'
        f'<ix:nonFraction name="{tag["revenue_sek"]}">12<ix:nonFraction name="{tag["profit_sek"]}" sign="a>b">3</ix:nonFraction>4</ix:nonFraction>'
        f"""<ix:nonFraction contextRef='x>y "' title="name='{tag["cash_sek"]}'" name='{tag["assets_total_sek"]}'>5<br title="a>b"/>6</ix:nonFraction>"""
        f'<ix:nonNumeric name="{fv.FILING_ORGNR}"><span>55<ix:nonNumeric name="o">66</ix:nonNumeric></span>77-8899</ix:nonNumeric>'
        f'<ix:nonFraction name="{tag["equity_total_sek"]}">7'
    )
    r = fl.filing_read(docs(spark, ("1", "2023-12-31", "f", body))).first()
    assert (r.revenue_sek, r.profit_sek, r.assets_total_sek, r.cash_sek, r.equity_total_sek) == (1234, 3, 56, None, None)
    assert r.doc_orgnr == "5566778899" and r.has_tags
    late = "<html><body><p xmlns:ix='u'>" + fact("revenue_sek", "5")
    none = [fl.filing_read(docs(spark, ("1", "2023-12-31", "f", d))).first() for d in (late, "", None)]
    assert [bool(x.has_tags) for x in none] == [False] * 3 and none[1].revenue_sek is None


def test_many_facts_in_one_document(spark):
    filler = '<ix:nonFraction name="x">1</ix:nonFraction>'
    body = HEAD + f'<ix:nonNumeric name="{fv.FILING_END}">' + filler * 50_000 + "</ix:nonNumeric>" + fact("revenue_sek", "8") + "</body>"
    r = fl.filing_read(docs(spark, ("1", "2023-12-31", "f", body))).first()
    assert r.revenue_sek == 8 and len(r.doc_end) == 50_000


def test_documents_after_the_accepted_one_are_not_read(spark):
    key, end = "5566778899", "2023-12-31"
    good = HEAD + fact("revenue_sek", "5")
    df = docs(spark, (key, end, "a", "<html>"), (key, end, "b", good), (key, end, "c", "<html>"), (key, end, "d", good))
    _, rejects, _, _ = fl.filing_validate(df, spark.createDataFrame([(key,)], "orgnr string"), df.select("orgnr", "end_date").limit(0))
    assert {r.source_file: r.reason for r in rejects.collect()} == {"a": "parse_error", "c": "already_loaded", "d": "already_loaded"}


def test_validation(spark):
    key, end = "5566778899", "2023-12-31"
    says = lambda k="", e="": HEAD + "".join(
        f'<ix:nonNumeric name="{n}" contextRef="c">{v}</ix:nonNumeric>' for n, v in ((fv.FILING_ORGNR, k), (fv.FILING_END, e)) if v
    ) + fact("revenue_sek", "5")
    df = docs(
        spark, ("", "", "a", says()), ("5500000000", end, "b", says()), ("5500000001", end, "b2", says()), (key, "2020-12-31", "c", says()), (key, end, "d", "<html>"),
        (key, end, "e", says("556677-0000")), (key, end, "f", says(key, "2022-12-31")), (key, end, "h", says("556677-8899", end)), (key, end, "g", says()), ("5566778800", end, "i", says()),
    )
    companies = spark.createDataFrame([(key,), (key,), ("5566778800",)], "orgnr string")
    loaded = spark.createDataFrame([(key, "2020-12-31")], "orgnr string, end_date string")
    accepted, rejects, counts, unknown = fl.filing_validate(df, companies, loaded)
    assert sorted(r.source_file for r in accepted.collect()) == ["g", "i"]
    assert {r.source_file: r.reason for r in rejects.collect()} == {
        "a": "bad_key", "b": "unknown_company", "b2": "unknown_company", "c": "already_loaded", "d": "parse_error", "e": "key_mismatch", "f": "date_mismatch", "h": "already_loaded"}
    assert {r.reason: r.n for r in counts.collect()}["accepted"] == 2
    assert [r.orgnr for r in unknown.collect()] == ["5500000000", "5500000001"]
    assert {r.revenue_sek for r in fl.filing_fact_extract(accepted).collect()} == {5}


def test_cdata_is_text_and_hides_markup(spark):
    fact = lambda body: f'<html xmlns:ix="x"><ix:nonFraction name="se-gen-base:Nettoomsattning" scale="0">{body}</ix:nonFraction></html>'
    bodies = {
        "1": "<![CDATA[12]]>", "2": "1<!-- x --><![CDATA[2]]><b>3</b>", "3": "<!-- <![CDATA[9]]> -->7", "4": "<![CDATA[4<!--]]>", "5": "<![CDATA[ 5 ]]><![CDATA[6]]>",
        "6": '<![CDATA[<ix:nonFraction name="q">]]>8', "7": "<![CDATA[7", "8": "<![CDATA[&amp;]]>",
    }
    names = [c for c, tag in fv.FILING_FACTS.items() if tag == "se-gen-base:Nettoomsattning"]
    df = spark.createDataFrame([(k, "2023-12-31", "f", fact(b)) for k, b in bodies.items()], "orgnr string, end_date string, source_file string, xhtml string")
    texts = {r.orgnr: r.t for r in fl._with_tags(df).select("orgnr", fl._first("nonFraction", "se-gen-base:Nettoomsattning")["text"].alias("t")).collect()}
    assert texts == {"1": "12", "2": "123", "3": "7", "4": "4<!--", "5": "5 6", "6": '<ix:nonFraction name="q">8', "7": texts["7"], "8": "&amp;"}
    if names:
        got = {r.orgnr: r[names[0]] for r in fl.filing_fact_extract(df).collect()}
        assert got["1"] == 12 and got["2"] == 123 and got["3"] == 7 and got["8"] is None
