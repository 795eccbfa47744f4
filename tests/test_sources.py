import json

import pytest

from firmweave.operators import standardize as std
from firmweave.sources import feeds, filings, register, schemas, snapshots


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_feed_order_and_rejects(spark, tmp_path):
    obj = lambda n, **kw: json.dumps({"orgnr": n, "checked_at": "2024-01-01T00:00:00Z", **kw})
    write(tmp_path / "tech_shard10.ndjson", [obj("1"), "", "   ", obj("2")])
    write(tmp_path / "tech_shard2.ndjson", [obj("3"), "{}", "[]", "[1]", "{broken", '{"orgnr": 5566778899, "checked_at": "2024-01-01"}'])
    write(tmp_path / "other.ndjson", [obj(" "), '{"orgnr": "4", "checked_at": ""}', obj("5"), "null"])
    patterns = [str(tmp_path / "tech_shard*.ndjson"), str(tmp_path / "*.ndjson")]
    got, rejects = feeds.feed_scan(spark, patterns, "tech")
    ordered = [r.orgnr for r in got.orderBy("feed_order").collect()]
    # Pattern rank first, then path (10 before 2), then line; files matched twice are read once.
    assert ordered == ["1", "2", "3", "5566778899", "5"]
    counts = {r.reject: r["count"] for r in rejects.groupBy("reject").count().collect()}
    assert counts == {"error": 5, "skipped": 2}


def test_website_feed_keeps_rows_without_time(spark, tmp_path):
    write(tmp_path / "a.ndjson", ['{"orgnr": "1", "found_website": "https://a.se"}'])
    got, rejects = feeds.feed_scan(spark, [str(tmp_path / "a.ndjson")], "website")
    assert got.count() == 1 and rejects.count() == 0
    with pytest.raises(FileNotFoundError):
        feeds.feed_scan(spark, [str(tmp_path / "none*.ndjson")], "website")


def test_feed_write_appends_by_shard(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("1", None, 0), ("2", "x", 1)], "orgnr string, name string, shard_id int")
    feeds.feed_write(df, path)
    feeds.feed_write(df, path)
    assert spark.read.json(path).count() == 4
    assert any('"name":null' in r.value for r in spark.read.text(path).collect())


def test_register_scan_takes_the_newest_file(spark, tmp_path, rows):
    head = "Organisationsidentitet;OrganisationsNamn;Registreringsdatum;Organisationsform;Avregistreringsdatum;Postadress"
    write(tmp_path / "bulk_1.csv", [head, "old;;;;;"])
    write(tmp_path / "bulk_2.csv", [
        head, "556677-8899$ORGNR-IDORG;Alfa AB$N$1|Beta;1999-01-02$x;AB-ORGFO$y;;Gatan 1$$111 22$ Lund $SE",
        "5566778800$PERSON;X;;;;", "bad\x00line$ORGNR-IDORG;X;;;;", "123$ORGNR-IDORG;X;;;;",
        '"5566778801$ORGNR-IDORG";;;Kommanditbolag;2020-01-01;',
    ])
    bulk = register.register_bulk_scan(spark, str(tmp_path / "bulk_*.csv"))
    assert set(bulk.columns) == {c.split()[0] for c in schemas.REGISTER_BULK.split(", ")} | {"row_order"}
    got = rows(std.register_standardize(bulk).drop("row_order"))
    assert got == [
        ("5566778801", None, None, None, "KB", "inactive"),
        ("5566778899", "Alfa AB", "Lund", "1999-01-02", "AB", "active"),
    ]


def test_filing_scan(spark, tmp_path, rows):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "5566778899_2023-12-31.xhtml").write_text("<html>\n1</html>")
    (tmp_path / "notes.xhtml").write_text("x")
    got = rows(filings.filing_scan(spark, str(tmp_path)), "orgnr", "end_date", "xhtml")
    assert got == [("", "", "x"), ("5566778899", "2023-12-31", "<html>\n1</html>")]


def test_snapshots(spark, tmp_path):
    store = snapshots.TableSnapshots(spark, str(tmp_path / "t"), partition_by=["y"])
    assert store.versions() == []
    assert store.write(spark.range(3).selectExpr("id", "id % 2 AS y")) == 0
    assert store.write(store.read().where("id > 0")) == 1
    (tmp_path / "t" / "v=2").mkdir()  # unfinished: no commit mark
    assert store.versions() == [0, 1]
    assert store.read().count() == 2 and store.read(0).count() == 3


def test_snapshot_versions_are_written_once(spark, tmp_path):
    first, second = (snapshots.TableSnapshots(spark, str(tmp_path / "t")) for _ in range(2))
    first.write(spark.range(1))
    second._claim(1)  # another writer is at work on the next version
    with pytest.raises(FileExistsError):
        first.write(spark.range(9))
    assert first.write(spark.range(2), 1) == 1  # an abandoned write is replaced by number
    with pytest.raises(FileExistsError):
        second.write(spark.range(9), 1)
    assert second.write(spark.range(3)) == 2
    assert first.expire(2) == [0] and first.versions() == [1, 2] and first.read().count() == 3
    assert first.expire(0) == [1] and first.versions() == [2]
    assert first.write(spark.range(4)) == 3
