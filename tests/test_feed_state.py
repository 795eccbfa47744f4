"""Feed lines that hold no single object, and feeds kept as keyed state."""

import json

from firmweave.operators import merge
from firmweave.sources import feeds
from firmweave.sources.snapshots import TableSnapshots
from firmweave.streaming import feed_stream

TIME = "2024-01-01T00:00:00Z"


def test_lines_that_are_no_single_object_are_errors(spark, tmp_path, rows):
    good = '{"orgnr":"1","found_website":"w"}'
    bad = [good + good, good + " trailing", good + ",{}", good + "]", good[:-1], '{"orgnr":NaN}', "[1]", "{}", "{ }", "5", '"x"', "null", good + ',"', "x" + good]
    fine = [good, f"  {good}\t", '{"orgnr":"2","orgnr":"3"}', '{"orgnr":4,"found_website":["a","b"],"status":{"k":1},"name":true}', '{"orgnr":"5","extra":{"deep":[1,{"x":null}]}}']
    (tmp_path / "f.ndjson").write_text("\n".join([*bad, "", *fine, '{"name":"keyless"}']))
    found, rejects = feeds.feed_scan(spark, [str(tmp_path / "f.ndjson")], "website")
    assert rows(found, "orgnr", "found_website", "status", "name") == rows(spark.createDataFrame(
        [("1", "w", None, None)] * 2 + [("3", None, None, None), ("4", '["a","b"]', '{"k":1}', "true"), ("5", None, None, None)], "a string, b string, c string, d string"))
    assert sorted(r.line for r in rejects.where("reject = 'error'").collect()) == sorted(bad)
    assert rejects.where("reject = 'skipped'").count() == 1


def line(key, **fields):
    return json.dumps({"orgnr": str(key), "checked_at": TIME, **fields})


def master(spark, n):
    types = {"website": "string", "website_status": "string", "website_checked_at": "timestamp", "segment_groups": "string", "segment_groups_checked_at": "timestamp"}
    return spark.range(n).selectExpr("CAST(id AS STRING) AS orgnr", *[f"CAST(NULL AS {t}) AS {c}" for c, t in types.items()])


def test_a_batch_touches_its_companies_only_and_equals_one_batch_of_all(spark, tmp_path, rows):
    changes, kinds = TableSnapshots(spark, str(tmp_path / "changes")), ["website", "segments"]
    paths = {k: str(tmp_path / k) for k in kinds}
    for p in paths.values():
        (tmp_path / p).mkdir()
    base = master(spark, 200)

    def run():
        feed_stream.feed_state(spark, paths, changes, str(tmp_path / "ckpt")).awaitTermination()

    assert rows(feed_stream.current_master(base, changes, kinds)) == rows(base)
    # All companies, then two of them: by an older row, a newer one, and the same time again.
    (tmp_path / "website" / "a1").write_text("\n".join(line(i, found_website=f"w{i}" if i % 2 else "", status="First") for i in range(200)))
    (tmp_path / "segments" / "a1").write_text("\n".join(line(i, segment_groups_after=f"g{i}") for i in range(100)))
    run()
    (tmp_path / "website" / "b1").write_text("\n".join(
        [line(4, found_website="late", status="older", checked_at="2023-01-01T00:00:00Z"), line(5, status="newer", checked_at="2024-03-01T00:00:00Z"), line(5, status="tie"), line(5, status="tie", checked_at="2024-03-01T00:00:00Z")]
    ) + "\n{torn")
    run()
    run()  # nothing new
    sizes = [changes.read(v).count() for v in changes.versions()]
    assert sizes == [200, 2]
    got = feed_stream.current_master(base, changes, kinds)
    read = {k: feeds.feed_scan(spark, [f"{p}/*"], k)[0] for k, p in paths.items()}
    assert rows(got) == rows(merge.signal_feeds_apply(base, read)[0])
    assert {r.orgnr: (r.website, r.website_status) for r in got.where("orgnr in (4, 5)").collect()} == {"4": ("late", "first"), "5": ("w5", "newer")}


def test_a_version_left_half_written_is_replaced(spark, tmp_path, rows):
    changes = TableSnapshots(spark, str(tmp_path / "changes"))
    (tmp_path / "website").mkdir()
    (tmp_path / "website" / "a").write_text(line(1, found_website="w"))
    (tmp_path / "changes" / "v=0").mkdir(parents=True)
    (tmp_path / "changes" / "v=0" / "part-broken.parquet").write_text("no parquet")
    feed_stream.feed_state(spark, {"website": str(tmp_path / "website")}, changes, str(tmp_path / "ckpt")).awaitTermination()
    assert [r.website for r in feed_stream.current_master(master(spark, 2), changes, ["website"]).orderBy("orgnr").collect()] == [None, "w"]


def test_lines_are_numbered_by_place():
    import pyarrow as pa

    places = [("a", 0)] * 3 + [("b", 0)] * 2 + [("b", 9)] + [("a", 0)] * 2
    batch = lambda part: pa.RecordBatch.from_arrays(
        [pa.array(["x"] * len(part)), pa.array([p for p, _ in part], pa.string()), pa.array([b for _, b in part], pa.int64())], names=["value", "file_path", "block_start"])
    out = feed_stream._line_numbers()([batch(places), batch([]), batch(places[-4:])])
    assert [b.column(3).to_pylist() for b in out] == [[0, 1, 2, 0, 1, 0, 3, 4], [], [2, 1, 5, 6]]


def test_a_line_is_parsed_once_however_often_its_value_is_read(spark, tmp_path):
    (tmp_path / "f.ndjson").write_text("\n".join([line(1, found_website="w"), "{torn"]))
    found, _ = feeds.feed_scan(spark, [str(tmp_path / "f.ndjson")], "website")
    read, _ = merge.observations({"website": found})
    assert read.count() == 1
    assert read._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
