from pyspark.sql import functions as F

from firmweave.operators import standardize as std


def test_legal_forms_in_order(spark):
    cases = {
        "Aktiebolag": "OTHER", "publikt ab": "AB", "Labor förening": "AB", "Kommanditbolag": "KB", "kb-x": "KB", "Handelsbolag": "HB", "HB": "HB",
        "Enskild näringsverksamhet": "EF", "EF": "EF", "Bostadsrättsförening": "BRF", "Ekonomisk förening": "EK", "Stiftelse": "ST",
        "Ideell förening": "IDEELL", "FL": "OTHER",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", std.legal_form(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t
    none = spark.createDataFrame([(None,)], "t string").select(std.legal_form(F.col("t"))).first()[0]
    assert none is None


def test_size_class_span(spark):
    cases = [
        ("3", None, None, None, (10, 19)), ("8", None, None, None, (500, None)), (" 4 st", None, None, None, (20, 49)), ("9", "5-9 anställda", None, None, (5, 9)),
        ("", "10–19 anställda", None, None, (10, 19)), (None, "500+", None, None, (500, None)), (None, "0 anställda", None, None, (0, 0)),
        (None, "05-09", None, None, (0, 0)), (None, "okänd", None, None, (None, None)), ("3", None, 7, None, (7, None)), ("0", None, None, None, (0, 0)),
    ]
    for code, text, lo, hi, want in cases:
        df = spark.createDataFrame([(code, text, lo, hi)], "employees_class_code string, employees_class string, employees_min int, employees_max int")
        r = std.size_class_span(df).first()
        assert (r.employees_min, r.employees_max) == want, (code, text)


def test_master_projection_fills_missing_columns(spark):
    old = spark.createDataFrame([("1", " A ", "  ", "X", "12", "unknown")], "orgnr string, name string, scb_municipality string, city string, employees string, hiring_status string")
    r = std.master_projection(old).first()
    assert (r.orgnr, r.name, r.kommun, r.employees, r.hiring_status, r.website, r.line_of_work_conf) == ("1", "A", "X", 12, "unknown", None, None)
    assert len(r) == len(std.MASTER_COLUMNS)


def test_timestamp_standardize(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01T00:00:00Z",), ("x",), (None,), (" ",)], "t string")
    out, counts = std.timestamp_standardize(df, ["t"])
    assert [r.t for r in out.collect()] == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "x", None, " "]
    assert counts.first().asDict() == {"t_skipped": 1, "t_changed": 1}


def test_code_table_fill(spark, rows):
    df = spark.createDataFrame([("1", " "), ("1", "own"), ("9", None), (None, None)], "code_col string, label_col string")
    codes = spark.createDataFrame([("1", "One")], "code string, label string")
    assert rows(std.code_table_fill(df, codes, "code_col", "label_col")) == [(None, None), ("1", "One"), ("1", "own"), ("9", None)]


def test_payload_flatten(spark):
    df = spark.createDataFrame(
        [("1", '{"foretag": {"Stkl, kod": "3", "Antal arbetsställen": 4, "Säteslän": "Skåne län"}}'), ("2", "{}"), ("3", "no json"), ("4", None)],
        "orgnr string, payload string",
    )
    got = {r.orgnr: tuple(r)[1:] for r in std.payload_flatten(df).collect()}
    assert got["1"] == ("3", 4, "unknown", "unknown", "Skåne", "ok")
    assert got["2"] == got["3"] == got["4"] == ("unknown", None, "unknown", "unknown", "unknown", "unknown")


def test_ownership(spark):
    cases = [("Privat", None, "privat"), ("", "Region Skåne", "offentlig"), ("privat", "statlig", "offentlig"), (None, None, "unknown"), ("x", "y", "unknown")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r[0] for r in df.select(std.ownership_bucket("a", "b") == F.col("want")).collect())
