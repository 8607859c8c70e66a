import pytest
from pyspark.sql import functions as F

from lumisift.operators import aggs, joins, select, sets, vetting, windows
from lumisift.plans import pipelines, proxy
from lumisift.sources import tables
from lumisift.streaming import incremental


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "tic_id long")


def test_enrich_keeps_rows_and_the_first_match(spark):
    catalog = spark.createDataFrame([(1, 1, 5.0), (1, 0, 7.0), (None, 0, 9.0)], "tic_id long, copy int, doyle_ruwe double")
    got = joins.enrich(ids(spark, 1, 2, None), catalog, [F.col("copy")]).collect()
    assert sorted([(r["tic_id"], r["doyle_ruwe"], r["has_doyle_params"]) for r in got], key=repr) == sorted([(1, 7.0, True), (2, None, False), (None, None, False)], key=repr)
    assert joins.enrich(ids(spark, 1), None).first()["has_doyle_params"] is False


def test_catalog_flags(spark):
    got = joins.add_catalog_flags(ids(spark, 1, 2, 3, None), prsa=ids(spark, 1, 1), kostov_vetted=None, oddo=ids(spark, 2), kostov_unvetted=ids(spark, 3)).collect()
    by = {r["tic_id"]: r for r in got}
    assert len(got) == 4 and by[1]["flag_prsa_eb"] and by[2]["flag_oddo_eb"] and by[3]["annotation_kostov_candidate"]
    assert [by[k]["flag_catalog_eb"] for k in (1, 2, 3, None)] == [True, True, False, False]
    assert not joins.add_catalog_flags(ids(spark, 1)).first()["flag_catalog_eb"]
    with pytest.raises(KeyError):
        joins.add_catalog_flags(spark.createDataFrame([(1,)], "x long"))


SAMPLE = "tic_id long, planet_number int, sector int"
SCORES = "uid string, target_id long, tce_plnt_num int, tce_period double, z_shape_0 double, score double"


def test_scoped_and_unscoped_merge(spark):
    sample = spark.createDataFrame([(1, 1, 47), (2, 1, 47), (3, 1, 50)], SAMPLE)
    scores = spark.createDataFrame([("1-1-S47", 1, 1, 3.0, 0.4, 0.9), ("2-1-S99", 2, 1, 3.0, 0.6, 0.8)], SCORES)
    scoped = {r["tic_id"]: r["score"] for r in joins.merge_predictions(sample, scores).collect()}
    free = {r["tic_id"]: r["score"] for r in joins.merge_predictions(sample, scores, scope_by_run=False).collect()}
    assert scoped == {1: 0.9, 2: None, 3: None} and free == {1: 0.9, 2: 0.8, 3: None}
    merged = joins.merge_predictions(sample, scores)
    assert "target_id" not in merged.columns and {r["tic_id"]: r["median_z_score"] for r in merged.collect()}[1] == 0.4


@pytest.mark.parametrize("side", ["sample", "scores"])
def test_merge_raises_on_repeated_keys_even_if_only_counted(spark, side):
    sample = [(1, 1, 47)] * (2 if side == "sample" else 1)
    scores = [("1-1-S47", 1, 1, 3.0, 0.4, 0.9)] * (2 if side == "scores" else 1)
    merged = joins.merge_predictions(spark.createDataFrame(sample, SAMPLE), spark.createDataFrame(scores, SCORES))
    with pytest.raises(Exception, match="not unique"):
        merged.count()
    with pytest.raises(Exception, match="not unique"):
        merged.select("tic_id").collect()


def test_merge_names_missing_columns(spark):
    with pytest.raises(KeyError):
        joins.merge_predictions(ids(spark, 1), spark.createDataFrame([], SCORES))


def test_suspects(spark):
    df = spark.createDataFrame([(0.5, None), (0.5, 1.0), (None, None)], "score double, tce_period double")
    assert joins.count_suspect_joins(df).first()["n_suspect"] == 1


def test_histogram_follows_pandas_cut(spark):
    import numpy as np
    import pandas as pd

    values = np.random.default_rng(0).normal(size=500)
    want = pd.cut(pd.Series(values), bins=30).value_counts(sort=False).tolist()
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    assert [r["n"] for r in aggs.histogram(df, "x").orderBy("bin").collect()] == want
    same = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert [r["n"] for r in aggs.histogram(same, "x").orderBy("bin").collect()] == pd.cut(pd.Series([2.0] * 3), bins=30).value_counts(sort=False).tolist()
    assert aggs.histogram(df.limit(0), "x").count() == 0
    assert sum(r["n"] for r in aggs.histogram(df, "x", log_x=True).collect()) == int((values > 0).sum())


def test_empty_table_reports(spark):
    empty = spark.createDataFrame([], "a boolean, b boolean, x double, y double")
    assert all(r["both"] == 0 for r in aggs.cooccurrence(empty, ["a", "b"]).collect())
    assert aggs.density2d(empty, "x", "y").count() == 0 and aggs.distribution_stats(empty, ["x"]).first()["n"] == 0


@pytest.mark.parametrize("n", [1, 2, 4000, 4001])
def test_median_is_exact_between_two_quantiles(spark, n):
    """With an accuracy below the number of values only those near the middle are counted one by one."""
    import statistics

    import numpy as np

    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n).tolist(), rng.integers(0, 5, n).astype(float).tolist()
    df = spark.createDataFrame([*zip(x, y, strict=True), (None, float("nan"))], "x double, y double").repartition(5)
    got = {r["metric"]: (r["n"], r["median"], r["low"], r["high"]) for r in aggs.distribution_stats(df, ["x", "y"], accuracy=500).collect()}
    assert got == {c: (n, statistics.median(v), min(v), max(v)) for c, v in (("x", x), ("y", y))}


def test_work_list_and_paging(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6)], "tic_id long, sector int")
    assert {tuple(r) for r in select.work_list(rows).collect()} == {(1, "5-5"), (2, "5-5"), (2, "6-6")}
    with pytest.raises(KeyError):
        select.work_list(ids(spark, 1))
    page = select.sorted_page(rows, "sector", size=1, offset=3, ties=("tic_id",))
    assert tuple(page.first()) == (2, 6)


def test_candidates_and_controls(spark):
    rows = spark.createDataFrame([(i, 1, 1, i % 2 == 0, float(i) if i else None) for i in range(20)], "tic_id long, planet_number int, sector int, passes_all_filters boolean, anomaly_score double")
    got = select.select_candidates(rows, top_n=3, control=4).collect()
    assert [r["tic_id"] for r in got if not r["is_control_sample"]] == [18, 16, 14]
    assert sum(r["is_control_sample"] for r in got) == 4 and all(not r["passes_all_filters"] for r in got if r["is_control_sample"])
    again = select.control_sample(rows.repartition(7), 4).collect()
    assert {r["tic_id"] for r in again} == {r["tic_id"] for r in got if r["is_control_sample"]}


LOG = "candidate_id long, vetter_id string, vetting_round int, classification string, confidence string, decided_at int"


def test_decisions(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", 1, "unsure", "low", 1), (1, "b", 1, "planet", "high", 2), (1, "a", 2, "unsure", "low", 3), (2, "a", 1, "planet", "medium", 4), (2, "b", 1, "planet", "low", 5), (3, "a", 1, "banana", "low", 6), (3, "a", 1, "planet", "sure", 7), (None, "a", 1, "planet", "low", 8)], LOG)
    rejects = vetting.record_decisions(log, str(tmp_path / "log"))
    kept = spark.read.parquet(str(tmp_path / "log"))
    assert kept.count() == 5 and {r["reason"] for r in rejects.collect()} == {"unknown classification", "unknown confidence", "candidate_id is missing"}
    pair = vetting.agreement(kept).first()
    assert (pair["n"], pair["agreed"], pair["reaches_target"]) == (2, 1, False)
    assert [tuple(r)[0:2] + (r["action"],) for r in vetting.revet_queue(kept).collect()] == [(1, "unsure", "escalate")]
    assert [r["vetting_round"] for r in vetting.decisions_for(kept, 1).collect()] == [1, 1, 2]
    assert vetting.confusion(kept).filter("class_a = 'unsure'").first()["planet"] == 1


def test_pending_and_caches(spark):
    log = spark.createDataFrame([("a", "done", 1), ("b", "failed", 2), ("b", "done", 1), ("c", "failed", 1), ("c", "done", 2)], "path string, status string, recorded_at int")
    listed = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    assert {r["path"] for r in incremental.pending(listed, log).collect()} == {"b", "d"}
    cache = spark.createDataFrame([(1, "2024-01-01"), (1, "2023-01-01"), (2, "2022-01-01")], "tic_id long, queried_at string").withColumn("queried_at", F.col("queried_at").cast("timestamp"))
    assert {r["tic_id"] for r in incremental.stale_lookups(ids(spark, 1, 2, 3), cache, "2024-03-01").collect()} == {2, 3}
    assert incremental.upsert_lookups(cache, cache).count() == 2


def test_unions(spark):
    a, b = spark.createDataFrame([(1, 2)], "tic_id long, x int"), spark.createDataFrame([(1, 3)], "tic_id long, y int")
    both = sets.union_sectors([a, b])
    assert both.columns == ["tic_id", "x", "y"] and both.count() == 2
    assert sets.union_catalogs([a, b]).first()["n_rows"] == 2


def test_build_sample_and_thresholds_survive_parquet(spark, data, tmp_path):
    df = pipelines.build_sample([proxy.tce(spark, data)], proxy.CONFIG)
    assert df.count() == proxy.tce(spark, data).count() and not df.filter("has_doyle_params").count()
    df.write.parquet(str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    assert tables.read_thresholds(again)["stellar_cuts"]["tmag_max"] == 14.0
    assert tables.read_thresholds(again.drop("any_diagnostic_flag")) == {} and tables.read_thresholds(df.withColumn("any_diagnostic_flag", F.lit(True) | F.lit(False))) == {}
    report = pipelines.report(again)
    assert report["gates"].first()["n_total"] == df.count() and report["histogram_model_fit_snr"].count() == 30


def test_matching_periods_add_no_window(spark, data):
    """Bands, entities and the join are dealt once each, beside what the input (read twice) has itself; no window sorts an entity."""
    known = proxy.tce(spark, data).drop("planet_number")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    out = plan(windows.add_matching_period_signals(known))
    assert "Window" not in out and out.count("Exchange hashpartitioning") <= 2 * plan(known).count("Exchange hashpartitioning") + 3


def test_tolerant_read(spark, tmp_path):
    spark.createDataFrame([(1,)], "a long").write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"nonsense")
    assert tables.read_tolerant(spark, [str(tmp_path / "good"), str(tmp_path / "bad.parquet")], "a long").count() == 1
    assert tables.read_tolerant(spark, [], "a long").count() == 0
    with pytest.warns(UserWarning, match="gone.parquet"):
        assert tables.read_tolerant(spark, [str(tmp_path / "good"), str(tmp_path / "gone.parquet")], "a long").count() == 1


def test_read_sectors(spark, tmp_path):
    spark.createDataFrame([(1, float("nan"))], "tic_id long, x double").write.parquet(str(tmp_path / "tce_dv_metrics_s1.parquet"))
    spark.createDataFrame([(2, 3)], "tic_id long, y int").write.parquet(str(tmp_path / "tce_dv_metrics_s2.parquet"))
    got = {r["tic_id"]: (r["x"], r["y"]) for r in tables.read_sectors(spark, str(tmp_path)).collect()}
    assert got == {1: (None, None), 2: (None, 3)}


def test_predictions_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# made by hand\nuid,target_id,score\n# again\n1-1-S5,1,0.5\n")
    got = tables.read_predictions(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in got] == [("1-1-S5", 1, 0.5)]
    rows = spark.createDataFrame([(1, 5), (1, 5)], "tic_id long, sector int")
    tables.write_work_list(rows, str(tmp_path / "w.csv"))
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "w.csv")).collect()] == [(1, "5-5")]


def test_phase_fold(spark):
    series = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 3.0), (1, 2.5, 5.0), (2, 0.0, 9.0)], "tic_id long, t double, value double")
    wanted = spark.createDataFrame([(1, 1, 10.0, 0.0), (1, 2, None, 0.0)], "tic_id long, planet_number int, orbital_period_days double, epoch double")
    got = {r["phase_bin"]: (r["n"], r["mean"]) for r in pipelines.phase_fold(series, wanted, bins=4).collect()}
    assert got == {0: (2, 2.0), 1: (1, 5.0)}
