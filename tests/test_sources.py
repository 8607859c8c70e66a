import json

import pytest

from lumisift.sources import catalogs, reports
from lumisift.streaming import incremental

REPORT = """<?xml version="1.0"?><!-- a <comment> -->
<dv:dvTargetResults xmlns:dv="urn:x" ticId="{tic}" sectorsObserved="101" planetCandidateCount="2.0">
 <dv:matchedToiId>100.01</dv:matchedToiId><dv:matchedToiId></dv:matchedToiId>
 <dv:tessMag value="10.5"/><dv:tessMag value="99"/><dv:effectiveTemp value="nan"/>
 <dv:limbDarkeningModel modelName="claret" coefficient1="0.1"/>
 {planets}
</dv:dvTargetResults>"""
PLANET = """<dv:planetResults planetNumber="{n}">
 <dv:planetCandidate suspectedEclipsingBinary=" TRUE " maxMultipleEventSigma="9.5"><dv:weakSecondary mesMad="0.5"/></dv:planetCandidate>
 <dv:allTransitsFit fullConvergence="false" modelFitSnr=""><dv:modelParameters>
  <dv:modelParameter name="orbitalPeriodDays" value="1" uncertainty="2"/><dv:modelParameter name="orbitalPeriodDays" value="3.5" uncertainty="0.1"/><dv:modelParameter name="unknown" value="8"/>
 </dv:modelParameters></dv:allTransitsFit>
 <dv:centroidResults><dv:differenceImageMotionResults><dv:msTicCentroidOffsets><dv:meanSkyOffset value="6" uncertainty="2"/></dv:msTicCentroidOffsets><dv:msControlCentroidOffsets><dv:meanSkyOffset value="6" uncertainty="0"/></dv:msControlCentroidOffsets></dv:differenceImageMotionResults></dv:centroidResults>
 <dv:differenceImageResults sector="4"/><dv:differenceImageResults sector="5"/>
</dv:planetResults>"""


def write(folder):
    (folder / "deep").mkdir()
    (folder / "a.xml").write_text(REPORT.format(tic=11, planets=PLANET.format(n=1) + PLANET.format(n="x")))
    (folder / "deep/b.xml").write_text(REPORT.format(tic=12, planets=""))
    (folder / "deep/c.xml").write_text("<not-valid-xml>")
    (folder / "deep/d.xml").write_text("<other/>")
    (folder / "note.txt").write_text("no report")


def test_parse_reports(spark, tmp_path):
    write(tmp_path)
    parsed = reports.parse_reports(reports.scan_reports(spark, str(tmp_path)))
    row = parsed.signals.collect()
    assert len(row) == 1
    row = row[0]
    assert (row["tic_id"], row["planet_number"], row["sector"], row["n_difference_images"], row["xml_filename"]) == (11, 1, 5, 2, "a.xml")
    assert (row["tess_mag"], row["effective_temp"], row["planet_candidate_count"], row["radius"]) == (10.5, None, 2, None)
    assert (row["sectors_observed"], row["matched_toi_ids"]) == ([1, 3], ["100.01"])
    assert (row["suspected_eclipsing_binary"], row["full_convergence"], row["model_fit_snr"]) == (True, False, None)
    assert (row["orbital_period_days"], row["orbital_period_days_err"], row["transit_depth_ppm"]) == (3.5, 0.1, None)
    assert (row["ms_tic_centroid_offset_sigma"], row["ms_control_centroid_offset_sigma"], row["weak_secondary_mes_mad"]) == (3.0, None, 0.5)
    assert (row["limb_darkening_model"], row["limb_darkening_c1"], row["limb_darkening_c2"]) == ("claret", 0.1, None)
    assert tuple(parsed.counts().first()) == (4, 2, 2, 1)
    assert {(r["error_type"], r["path"][-5:]) for r in parsed.file_errors.collect()} == {("ParseError", "c.xml"), ("ValueError", "d.xml")}
    assert [r["level"] for r in parsed.rejects.collect()] == ["tce"]


def test_write_signals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    parsed = reports.parse_reports(reports.scan_reports(spark, str(tmp_path / "in")))
    assert reports.write_signals(parsed, str(tmp_path / "out"), str(tmp_path / "errors"), "1.0")
    out = spark.read.parquet(str(tmp_path / "out")).first()
    assert out["parser_version"] == "1.0" and out["sector"] == 5
    errors = [json.loads(x) for f in (tmp_path / "errors").glob("*.json") for x in f.read_text().splitlines()]
    assert len(errors) == 3 and all({"timestamp", "level", "path", "error_type", "message"} <= set(e) for e in errors)


def test_all_files_bad(spark, tmp_path):
    texts = spark.createDataFrame([("x.xml", "<oops"), ("y.xml", None), ("z.xml", "")], "path string, value string")
    parsed = reports.parse_reports(texts)
    assert not reports.write_signals(parsed, str(tmp_path / "out"), str(tmp_path / "errors"), "1.0")
    assert not (tmp_path / "out").exists() and tuple(parsed.counts().first()) == (3, 0, 3, 0)


def test_streamed_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    seen = []
    go = lambda: incremental.stream_reports(spark, str(tmp_path / "in"), lambda signals, errors, n: seen.append((signals.count(), errors.count())), str(tmp_path / "checkpoint")).awaitTermination(120)
    go()
    assert seen == [(1, 3)]
    (tmp_path / "in/e.xml").write_text(REPORT.format(tic=13, planets=PLANET.format(n=1)))
    go()
    assert seen[1:] == [(1, 0)]


def fixed(tic, parallax, gaia=""):
    line = [" "] * 396
    for (name, start, stop, _), text in [(x, {"tic_id": tic, "doyle_parallax_over_error": parallax, "doyle_gaia_dr3": gaia}.get(x[0], "")) for x in catalogs.STELLAR_LAYOUT]:
        line[start - 1 : stop] = list(text.rjust(stop - start + 1))
    return "".join(line)


def test_fixed_width(spark, tmp_path):
    (tmp_path / "c.dat").write_text("\n".join([fixed("42", "7.25", "1234567890123456789"), fixed("", "1.0"), fixed("43", "")]) + "\n")
    got = {r["tic_id"]: r for r in catalogs.read_fixed_width(spark, str(tmp_path / "c.dat")).collect()}
    assert set(got) == {42, 43} and got[42]["doyle_parallax_over_error"] == 7.25 and got[42]["doyle_gaia_dr3"] == 1234567890123456789 and got[43]["doyle_parallax_over_error"] is None
    with pytest.raises(Exception):
        catalogs.read_fixed_width(spark, str(tmp_path / "none.dat")).count()


def test_id_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("TIC,x\n7,a\n8.0,b\nbad,c\n,d\n")
    assert sorted(r["ticId"] for r in catalogs.read_id_csv(spark, str(tmp_path / "c.csv")).collect()) == [7, 8]
    with pytest.raises(KeyError):
        catalogs.with_ids(spark.createDataFrame([(1,)], "x long"))
    kept, dropped = catalogs.with_ids(spark.createDataFrame([("1",), ("z",)], "TIC string"))
    assert kept.count() == 1 and dropped.first()["n_dropped"] == 1


MRT = """Title: A table
Byte-by-byte Description of file: t.txt
--------------------------------------------------------------------------------
   Bytes Format Units  Label     Explanations
--------------------------------------------------------------------------------
   1-  9 I9     ---    TIC       Identifier
  11- 15 F5.2   d      Per       Period
      17 A1     ---    Flag      Flag
--------------------------------------------------------------------------------
       42  1.25 x
       bad 2.50 y
       43       z
"""


def test_mrt(spark, tmp_path):
    (tmp_path / "t.txt").write_text(MRT)
    got = {r["ticId"]: (r["Per"], r["Flag"]) for r in catalogs.read_mrt(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {42: (1.25, "x"), 43: (None, "z")}


def test_mrt_with_a_long_head(spark, tmp_path):
    """The head ends at its last rule, wherever that is."""
    (tmp_path / "t.txt").write_text("Note: more\n" * 700 + MRT)
    assert {r["ticId"] for r in catalogs.read_mrt(spark, str(tmp_path / "t.txt")).collect()} == {42, 43}
    (tmp_path / "none.txt").write_text("a\nb\n")
    with pytest.raises(ValueError):
        catalogs.read_mrt(spark, str(tmp_path / "none.txt"))


def test_optional_catalog(spark, tmp_path):
    assert catalogs.optional_catalog(spark, None, None).count() == 0
    assert catalogs.optional_catalog(spark, "/path/to/x", None).count() == 0
    assert catalogs.optional_catalog(spark, str(tmp_path / "missing"), None).columns == ["tic_id"]


def test_reports_are_parsed_once(spark, tmp_path):
    texts = spark.createDataFrame([("/r/a.xml", '<dvTargetResults ticId="1"><planetResults planetNumber="1"><bootstrapResults significance="0.25"/><differenceImageResults sector="4"/></planetResults></dvTargetResults>'), ("/r/b.xml", "<x")], "path string, value string")
    parsed = reports.parse_reports(texts)
    plan = parsed.signals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") == 1
    assert [r["bootstrap_significance"] for r in parsed.signals.collect()] == [0.25]
    observed = {}
    assert reports.write_signals(parsed, str(tmp_path / "out"), str(tmp_path / "errors"), "1.0", observed)
    assert observed == {"files_total": 2, "files_ok": 1, "files_failed": 1, "rows": 1}


def test_mrt_rows_are_told_by_place(spark, tmp_path):
    """A row that equals a line of the head, a rule-like line among the rows, a note that looks like a rule, and rows without a usable id."""
    head, rows = MRT.split("       42", 1)
    head = head.replace("Title: A table\n", "Title: A table\n       42  1.25 x\n" + "=" * 80 + "\n").rstrip("\n") + "\nNote (1): 12 stars\n" + "-" * 80 + "\n"
    (tmp_path / "t.txt").write_text(head + "       42" + rows + "       42  1.25 x\n" + "-" * 80 + "\n       44  9.75 -\n")
    got = sorted((r["ticId"], r["Per"], r["Flag"]) for r in catalogs.read_mrt(spark, str(tmp_path / "t.txt")).collect())
    assert got == [(42, 1.25, "x"), (42, 1.25, "x"), (43, None, "z"), (44, 9.75, "-")]
    (tmp_path / "u.txt").write_text(MRT)
    both = catalogs.read_mrt(spark, str(tmp_path / "*.txt")).count()
    assert both == len(got) + 2


def test_mrt_over_several_blocks(spark, tmp_path):
    """Places rise across the blocks of a file that many tasks read."""
    (tmp_path / "t.txt").write_text(MRT + "".join(f"{i:9d}  1.25 x\n" for i in range(1000, 6000)))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert catalogs.read_mrt(spark, str(tmp_path / "t.txt")).count() == 5002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_catalog_is_converted_once(spark, tmp_path):
    import gzip

    source, folder = tmp_path / "c.dat.gz", str(tmp_path / "copies")
    source.write_bytes(gzip.compress((fixed("42", "7.25") + "\n").encode()))
    reads = []

    def read(s, path):
        reads.append(path)
        return catalogs.read_fixed_width(s, path)

    one = lambda: catalogs.stored_catalog(spark, str(source), folder, read)
    assert [r["tic_id"] for r in one().collect()] == [42] and len(reads) == 1
    again = one()
    assert [r["tic_id"] for r in again.collect()] == [42] and len(reads) == 1 and "Text" not in again._jdf.queryExecution().executedPlan().toString()
    source.write_bytes(gzip.compress((fixed("42", "7.25") + "\n" + fixed("43", "1.0") + "\n").encode()))
    assert one().count() == 2 and len(reads) == 2


def test_skipped_files_are_named(spark, tmp_path):
    import os

    from lumisift.sources import tables

    rows = spark.range(1000).selectExpr("id AS a", "CAST(id AS STRING) AS b")
    rows.repartition(2).write.parquet(str(tmp_path / "good"))
    rows.limit(0).write.parquet(str(tmp_path / "empty"))
    whole = next(f for f in (tmp_path / "good").iterdir() if f.suffix == ".parquet").read_bytes()
    bad = tmp_path / "bad files"
    bad.mkdir()
    (bad / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (bad / "footer.parquet").write_bytes(whole[:-200] + b"\xff" * 192 + whole[-8:])
    (bad / "tiny.parquet").write_bytes(b"x")
    page = bytearray(whole)
    page[8:200] = os.urandom(192)
    (bad / "page.parquet").write_bytes(bytes(page))
    paths = [str(tmp_path / "good"), str(tmp_path / "empty"), *sorted(map(str, bad.iterdir())), str(tmp_path / "gone.parquet")]
    named = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in tables.skipped_files(spark, paths, "a long, b string").collect()}
    assert named == {"cut.parquet": "not a Parquet file", "footer.parquet": "a footer that can't be read", "tiny.parquet": "not a Parquet file", "gone.parquet": "missing"}
    deep = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in tables.skipped_files(spark, paths, "a long, b string", deep=True).collect()}
    assert deep == named | {"page.parquet": "columns that can't be read"}
    with pytest.warns(UserWarning, match="gone"):
        assert tables.read_tolerant(spark, paths, "a long, b string").count() >= 1000
    assert tables.skipped_files(spark, [str(tmp_path / "good")], "a long, b string").count() == 0
    assert [r["reason"] for r in tables.skipped_files(spark, [str(tmp_path / "gone")], "a long").collect()] == ["missing"]


def test_predictions_with_comments(spark, tmp_path):
    from lumisift.sources import tables

    (tmp_path / "p.csv").write_text('# made today\nuid,target_id,score,note # columns\n7-1-S3,7,0.5,"a # b" # tail\n  # only a comment\n8-1-S3,8,,"say ""#1"""\n9-1-S3,9,x,plain#tail\n\n')
    rows = [tuple(r) for r in tables.read_predictions(spark, str(tmp_path / "p.csv"), "uid string, target_id long, score double, note string").orderBy("uid").collect()]
    assert rows[0] == ("7-1-S3", 7, 0.5, "a # b") and rows[1][:3] == ("8-1-S3", 8, None) and rows[2] == ("9-1-S3", 9, None, "plain")
    found = tables.read_predictions(spark, str(tmp_path / "p.csv"))
    assert dict(found.dtypes) == {"uid": "string", "target_id": "bigint", "score": "string", "note": "string"} and found.count() == 3
    (tmp_path / "none.csv").write_text("# nothing\n")
    assert tables.read_predictions(spark, str(tmp_path / "none.csv"), "uid string").count() == 0


def test_batches_replace_themselves(spark, tmp_path):
    folder, schema = str(tmp_path / "c"), "k long, v string"
    assert incremental.read_committed(spark, folder, schema).count() == 0 and incremental.run_history(spark, folder).count() == 0
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    assert incremental.commit_batch(frame((1, "a"), (2, "b")), folder, 0, "v1") == 2
    incremental.commit_batch(frame((3, "c")), folder, 1, "v1")
    incremental.commit_batch(frame((3, "d"), (4, "e")), folder, 1, "v2", n_errors=5)
    frame((9, "lost")).write.parquet(f"{folder}/data/batch=2/attempt=dead")  # an attempt that never got its entry
    assert sorted(map(tuple, incremental.read_committed(spark, folder, schema).select("batch", "k", "v").collect())) == [(0, 1, "a"), (0, 2, "b"), (1, 3, "d"), (1, 4, "e")]
    history = sorted((r["batch"], r["version"], r["n_rows"], r["n_errors"], r["current"]) for r in incremental.run_history(spark, folder).collect())
    assert history == [(0, "v1", 2, 0, True), (1, "v1", 1, 0, False), (1, "v2", 2, 5, True)]


def test_reports_are_committed_by_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    folder = str(tmp_path / "out")
    go = lambda: incremental.stream_reports(spark, str(tmp_path / "in"), incremental.committed_reports(folder, "v1"), str(tmp_path / "checkpoint")).awaitTermination(120)
    go()
    (tmp_path / "checkpoint/commits/0").unlink()  # as after a crash between the sink and the mark
    (tmp_path / "checkpoint/commits/.0.crc").unlink(missing_ok=True)
    go()
    assert incremental.read_committed(spark, f"{folder}/signals", "tic_id long, planet_number int").count() == 1
    assert sorted((r["n_rows"], r["n_errors"], r["current"]) for r in incremental.run_history(spark, f"{folder}/signals").collect()) == [(1, 3, False), (1, 3, True)]
    assert incremental.read_committed(spark, f"{folder}/errors", "path string").count() == 3


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda n, stamp, at: spark.range(n).selectExpr("id AS tic_id", f"TIMESTAMP '{stamp}' AS queried_at", f"'{at}' AS x")
    assert incremental.upsert_cache(rows(200, "2024-01-01 00:00:00", "old"), path, buckets=8) == 8
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    before = files()
    assert incremental.upsert_cache(rows(1, "2024-02-01 00:00:00", "new"), path, buckets=8) == 1
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    assert len(before) == len(after) == 8 and len(kept) == 7
    held = {r["tic_id"]: r["x"] for r in spark.read.parquet(path).collect()}
    assert len(held) == 200 and held[0] == "new" and held[1] == "old"
    incremental.upsert_cache(rows(1, "2023-01-01 00:00:00", "older"), path, buckets=8)
    assert {r["x"] for r in spark.read.parquet(path).filter("tic_id = 0").collect()} == {"new"}


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    from lumisift.operators import joins, windows
    from lumisift.sources import tables

    rows = spark.range(500).selectExpr("id % 97 AS tic_id", "id AS planet_number", "CAST(id AS DOUBLE) AS orbital_period_days")
    stars = spark.range(97).selectExpr("id AS tic_id", "id * 2 AS ruwe")
    tables.write_bucketed(rows, "bucketed_rows", str(tmp_path / "rows"), buckets=4)
    tables.write_bucketed(stars, "bucketed_stars", str(tmp_path / "stars"), buckets=4)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.enrich(spark.table("bucketed_rows"), spark.table("bucketed_stars"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Window" in plan
        found = windows.matching_entities(spark.table("bucketed_rows"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in found
        assert out.count() == 500 and out.filter("ruwe = tic_id * 2").count() == 500
        spark.sql("DROP TABLE bucketed_stars")
        again = tables.attach_bucketed(spark, "bucketed_again", str(tmp_path / "stars"), stars.schema, buckets=4)
        assert "Exchange" not in joins.enrich(spark.table("bucketed_rows"), again)._jdf.queryExecution().executedPlan().toString() and again.count() == 97
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
        for t in ("bucketed_rows", "bucketed_again", "bucketed_stars"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_sketches_of_sectors_unite(spark, tmp_path):
    from lumisift.operators import aggs

    rows = spark.range(60_000).selectExpr("id % 20000 AS tic_id", "CAST(id % 7 AS INT) AS sector")
    path = str(tmp_path / "sketches")
    aggs.entity_sketches(rows.filter("sector < 6")).write.parquet(path)
    aggs.entity_sketches(rows.filter("sector = 6")).write.mode("append").parquet(path)
    got = aggs.entities_of_sketches(spark.read.parquet(path)).first()
    assert abs(got["n_entities"] - 20_000) <= 0.03 * 20_000 and got["n_rows"] == 60_000
    each = {r["sector"]: r["n_entities"] for r in aggs.entities_of_sketches(spark.read.parquet(path), ["sector"]).collect()}
    exact = {r["sector"]: r["n"] for r in rows.groupBy("sector").agg({"tic_id": "count"}).withColumnRenamed("count(tic_id)", "n").collect()}
    assert set(each) == set(exact) and aggs.entities_of_sketches(spark.read.parquet(path).limit(0)).first()["n_entities"] == 0
    approx = {r["metric"]: r["n"] for r in aggs.sample_summary(rows, approximate=True).collect()}
    assert abs(approx["entities"] - 20_000) <= 600 and {r["metric"]: r["n"] for r in aggs.sample_summary(rows).collect()}["entities"] == 20_000


@pytest.mark.parametrize("descending", [False, True])
def test_keyset_pages_equal_offset_pages(spark, descending):
    import random

    from lumisift.operators import select

    rng = random.Random(4)
    rows = [(i // 3, i % 3, rng.choice([None, 1.0, 2.0, 2.5, -1.0])) for i in range(100)]
    df = spark.createDataFrame(rows, "tic_id long, planet_number int, x double").repartition(3)
    last, seen = None, []
    for page in range(12):
        got = select.page_after(df, "x", last, descending=descending, size=9)
        want = select.sorted_page(df, "x", descending=descending, size=9, offset=9 * page)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        last = select.cursor_of(got, "x")
        seen += [tuple(r) for r in got.collect()]
    assert len(seen) == 100 and sorted(seen, key=repr) == sorted(rows, key=repr)
    assert select.cursor_of(df.limit(0), "x") is None


def test_prologs_of_reports(spark):
    head = "﻿ <?xml version='1.0'?><!DOCTYPE x><!-- <other/> -- > -->\n<!-- b -->"
    one = '<dv:dvTargetResults xmlns:dv="u" ticId="1"><dv:planetResults planetNumber="1"/></dv:dvTargetResults>'
    texts = spark.createDataFrame([("a.xml", head + one), ("b.xml", "<!-- " * 20_000), ("c.xml", head + "<other/>"), ("d.xml", "<!-- x -->" * 5000 + one)], "path string, value string")
    parsed = reports.parse_reports(texts)
    assert {r["path"]: r["_root"] for r in parsed.files.select("path", "_root").collect()} == {"a.xml": "dvTargetResults", "b.xml": "", "c.xml": "other", "d.xml": "dvTargetResults"}


def test_errors_alone_equal_those_of_all_columns(spark, tmp_path, data):
    """One parse of one scan, and the same errors as from the whole report."""
    write(tmp_path)
    texts = reports.scan_reports(spark, str(tmp_path))
    parsed, errors = reports.parse_reports(texts), reports.parse_errors(texts)
    want = parsed.file_errors.unionByName(parsed.rejects, allowMissingColumns=True)
    key = lambda df: sorted((tuple(r) for r in df.select("level", "path", "error_type", "message", "tic_id").collect()), key=repr)
    assert key(errors) == key(want) and len(key(want)) == 3
    from lumisift.plans import registry

    plan = registry.queries()["reject_counts"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") == 1


def test_targets_are_worked_out_once_a_file(spark):
    """A report's own columns are found below the generator of its signals."""
    text = '<dvTargetResults ticId="1" sectorsObserved="11"><tessMag value="2.5" value2="x"><a>b</a></tessMag><planetResults planetNumber="1"><planetCandidate suspectedEclipsingBinary="True"/></planetResults><planetResults planetNumber="2"/></dvTargetResults>'
    signals = reports.parse_reports(spark.createDataFrame([("a.xml", text)], "path string, value string")).signals
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    assert "_sectorsObserved" not in plan[: plan.index("Generate explode(_signals")]
    rows = signals.orderBy("planet_number").collect()
    assert [(r["tess_mag"], r["sectors_observed"], r["suspected_eclipsing_binary"], r["radius"]) for r in rows] == [(2.5, [1, 2], True, None), (2.5, [1, 2], None, None)]


def test_folders_of_broken_files_are_listed_as_one(spark, tmp_path, monkeypatch):
    """The files of a folder without a readable one are not handed over by name; in a mixed folder they are, and a folder below is left out."""
    from pyspark.sql import DataFrameReader

    from lumisift.sources import tables

    spark.range(5).selectExpr("id AS a").coalesce(1).write.parquet(str(tmp_path / "mixed"))
    spark.range(5).selectExpr("id AS a").coalesce(1).write.parquet(str(tmp_path / "bad/below"))
    for i in range(40):
        (tmp_path / f"bad/{i}.txt").write_text("x")
    (tmp_path / "mixed/x.txt").write_text("x")
    asked = []
    load = DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **b: asked.append(path) or load(self, path, *a, **b))
    named = tables.skipped_files(spark, [str(tmp_path / "mixed"), str(tmp_path / "bad") + "/*.txt"], "a long").collect()
    assert {r["reason"] for r in named} == {"not a Parquet file"} and len({r["path"] for r in named}) == len(named) == 41
    assert max(len(p) for p in asked) == 2 and len(asked) == 2


def test_texts_of_one_structure_are_read_as_if_each_were_parsed():
    """Values found by their places equal those of a whole parse, also where a value, a quote, a comment or a cut stands in the way."""
    from lumisift.sources import elements

    plain = REPORT.format(tic=11, planets=PLANET.format(n=1) + PLANET.format(n=2)).replace("<!-- a <comment> -->", "")
    odd = [("11", "12"), ('value="6"', 'value=""'), ('value="6"', 'value="6&lt;"'), ('value="6"', 'value="6<"'), ('value="6"', 'value="6>"'), ('value="6"', 'value=" 6\n"'), ('value="6"', 'value="\x01"'), ('value="6"', 'value="é"'), ('value="6"', "value='6'"),
           ('value="6"', 'value=\'"6"\''), ('value="6"', 'value="6" value="7"'), ('value="6"', 'value="<dv:planetResults "'), ('value="6"', 'dv:value="6"'), ('name="unknown"', 'name="transitDepthPpm"'), ('name="unknown" value="8"', 'value="8" name="transitDepthPpm"'),
           ('name="unknown"', 'name = "transitDepthPpm"'), ('name="unknown"', 'name="it\'s"'), ("100.01", '"100.01"'), ("100.01", "1<!-- c -->2"), ("100.01", "<![CDATA[a\"b\"]]>"), ("100.01", 'x name="y"'), ("100.01", ""), (' planetNumber="1"', ""), ("</dv:planetResults>\n", '</dv:planetResults>"]]>"\n'),
           ("</dv:dvTargetResults>", ""), ("</dv:dvTargetResults>", '<dv:tessMag value="1"/><dv:radius value="2"/></dv:dvTargetResults>'), ("</dv:dvTargetResults>", "</dv:dvTargetResults><a/>"), ("</dv:dvTargetResults>", '</dv:dvTargetResults>"x'), ("</dv:planetResults>\n", '</dv:planetResults>"x\n'), ("</dv:dvTargetResults>", '</dv:dvTargetResults><!-- "--" -->'), ("dv:", ""), ("dv:planetResults", "planetResults"),
           ("<dv:planetResults", "<!-- <dv:planetResults"), ("<dv:planetResults", "<a><dv:planetResults"), ('<?xml version="1.0"?>', ""), ('<?xml version="1.0"?>', "\n"), ('<?xml version="1.0"?>', "<?xml version=1.0?>"), ('<?xml version="1.0"?>', '<?xml version="1.0"?><!DOCTYPE a>')]
    texts = [plain, plain, *(x for a, b in odd for x in (plain.replace(a, b), plain.replace(a, b, 1)) if x != plain), "", "<", '"', "<a", '<a b="', '<a b="c"/>', "<planetResults planetNumber='1'/>"]
    quick, whole = (elements.Reader(reports.TARGET, "planetResults", reports.SIGNAL) for _ in range(2))
    whole._by_shape = lambda raw: None
    parsed = []
    quick.names.tree, tree = lambda text: parsed.append(text) or tree(text), quick.names.tree
    for text in texts * 2:
        assert quick.read(text.encode()) == whole.read(text.encode()), text
    assert quick.read(None) == (None, []) and len(quick.read(plain.encode())[1]) == 2
    parsed.clear()
    assert quick.read(plain.replace("9.5", "8.25").encode())[1][0][6] == "8.25" and not parsed
    quick.room = 0
    assert quick.read(plain.replace("dv:", "x:").encode()) == whole.read(plain.encode()) and len(quick.shapes) == 3


def test_texts_behind_a_report_are_an_error(spark):
    """As for every XML parser, a report with anything but comments behind its root is not well-formed; bytes that are no UTF-8 stop nothing."""
    one = '<dvTargetResults ticId="1" toiId=" T 1 "><planetResults planetNumber="1"/></dvTargetResults>'
    texts = spark.createDataFrame([("a.xml", one + "<!-- x -->\n"), ("b.xml", one + "x"), ("c.xml", one + one)], "path string, value string")
    latin = spark.sql("SELECT 'd.xml' AS path, CAST(concat(CAST('<dvTargetResults ticId=\"2\" toiId=\"' AS BINARY), X'E9', CAST('\"><planetResults planetNumber=\"1\"/></dvTargetResults>' AS BINARY)) AS STRING) AS value")
    parsed = reports.parse_reports(texts.unionByName(latin))
    assert {(r["xml_filename"], r["tic_id"], r["toi_id"]) for r in parsed.signals.collect()} == {("a.xml", 1, "T 1"), ("d.xml", 2, "�")}
    assert {(r["path"], r["error_type"]) for r in parsed.file_errors.collect()} == {("b.xml", "ParseError"), ("c.xml", "ParseError")}


def test_columns_of_signals_are_no_one_method(spark):
    """The columns stand outside of whole-stage code, whose one method for all of them is longer than the JVM compiles."""
    texts = spark.createDataFrame([("a.xml", "<x/>")], "path string, value string")
    plan = reports.parse_reports(texts).signals._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(_signals")]
    assert plan.count("MapInArrow from_xml") == 1 and "Project [xml_filename" in above and not any("*(" in x for x in above.splitlines() if "Project [xml_filename" in x)
