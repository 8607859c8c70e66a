import pytest
from pyspark.sql import functions as F

from lumisift.functions import exprs, nulls
from lumisift.operators import flags, windows

SCHEMA = "tic_id long, planet_number int, sector int, tess_mag double, log_g double, effective_temp double, radius double, orbital_period_days double, model_chi_square double, model_degrees_of_freedom double, odd_even_depth_statistic double, odd_even_depth_significance double, ghost_core_correlation double, ghost_halo_correlation double, ms_tic_centroid_offset_sigma double, ms_control_centroid_offset_sigma double, model_fit_snr double, full_convergence boolean, suspected_eclipsing_binary boolean"
CLEAN = dict(tic_id=1, planet_number=1, sector=5, tess_mag=10.0, log_g=4.5, effective_temp=5500.0, radius=1.0, orbital_period_days=3.0, model_chi_square=2200.0, model_degrees_of_freedom=1000.0, odd_even_depth_statistic=4.0, odd_even_depth_significance=0.5, ghost_core_correlation=0.8, ghost_halo_correlation=0.2, ms_tic_centroid_offset_sigma=1.0, ms_control_centroid_offset_sigma=1.0, model_fit_snr=30.0, full_convergence=True, suspected_eclipsing_binary=False)


@pytest.fixture
def run(spark):
    def go(*changes, **config):
        rows = [tuple((CLEAN | c).values()) for c in (changes or [{}])]
        df = nulls.nan_to_null(spark.createDataFrame(rows, SCHEMA)).transform(flags.add_derived_metrics)
        return flags.add_any_flag(flags.add_diagnostic_flags(df, config)).orderBy("planet_number").collect()

    return go


def raised(row):
    return {f for f in flags.DIAGNOSTIC_FLAGS if row[f]}


def test_clean_row_raises_nothing(run):
    assert not raised(run()[0]) and not run()[0]["any_diagnostic_flag"]


def test_missing_everything_raises_nothing(run):
    row = run({k: None for k in CLEAN if k not in ("tic_id", "planet_number", "sector")})[0]
    assert not raised(row) and not row["annotation_low_rchisq"]


def test_nan_counts_as_missing(run):
    row = run({k: float("nan") for k, v in CLEAN.items() if isinstance(v, float)})[0]
    assert not raised(row) and row["model_chi_square_reduced"] is None


@pytest.mark.parametrize(("change", "flag"), [
    ({"suspected_eclipsing_binary": True}, "flag_suspected_eb"), ({"full_convergence": False}, "flag_no_convergence"), ({"odd_even_depth_significance": -1.0}, "flag_invalid_odd_even"),
    ({"ghost_core_correlation": 0.1}, "flag_background_eb"), ({"odd_even_depth_statistic": 1600.0}, "flag_large_odd_even"), ({"model_fit_snr": 9.9}, "flag_low_snr"),
])
def test_each_flag_alone(run, change, flag):
    row = run(change)[0]
    assert raised(row) == {flag} and row["any_diagnostic_flag"]


@pytest.mark.parametrize(("change", "flag"), [({"odd_even_depth_statistic": 1225.0}, "flag_large_odd_even"), ({"model_fit_snr": 10.0}, "flag_low_snr"), ({"ghost_core_correlation": 0.2}, "flag_background_eb")])
def test_thresholds_are_strict(run, change, flag):
    assert flag not in raised(run(change)[0])


@pytest.mark.parametrize(("target", "control", "flagged"), [(1.0, 1.0, False), (5.0, 4.0, True), (5.0, 1.0, False), (5.0, None, True), (1.0, None, False), (None, None, False)])
def test_centroid_truth_table(run, target, control, flagged):
    row = run({"ms_tic_centroid_offset_sigma": target, "ms_control_centroid_offset_sigma": control})[0]
    assert row["flag_centroid_offset"] is flagged


def test_low_chi_square_is_an_annotation(run):
    row = run({"model_chi_square": 1000.0})[0]
    assert row["annotation_low_rchisq"] and not row["any_diagnostic_flag"]


def test_absent_columns_give_false(spark):
    row = flags.add_any_flag(flags.add_diagnostic_flags(spark.createDataFrame([(1,)], "tic_id long"))).first()
    assert not raised(row) and row["any_diagnostic_flag"] is False
    assert flags.survivors(spark.createDataFrame([(1,)], "tic_id long")).count() == 0


def test_zero_and_negative_metrics_are_null(run):
    row = run({"model_degrees_of_freedom": 0.0, "odd_even_depth_statistic": -5.0, "ghost_halo_correlation": 0.0})[0]
    assert (row["model_chi_square_reduced"], row["odd_even_depth_sig"], row["ghost_diagnostic_ratio"]) == (None, None, None)


def matching(spark, rows, **more):
    df = spark.createDataFrame(rows, "tic_id long, orbital_period_days double")
    return sorted(map(tuple, windows.add_matching_period_signals(df, 0.01, **more).select("tic_id", "orbital_period_days", "matching_period_signals").collect()), key=repr)


def test_matching_periods(spark):
    got = matching(spark, [(1, 3.0), (1, 3.005), (1, None), (2, 3.0), (2, 3.02), (3, 3.0), (None, 3.0), (None, 3.001)])
    assert {(t, m) for t, _, m in got} == {(1, True), (2, False), (3, False), (None, False)}
    assert len(got) == 8


def test_matching_gap_is_strict(spark):
    assert not any(m for *_, m in matching(spark, [(1, 1.0), (1, 1.5)], )) and not any(m for *_, m in matching(spark, [(1, 0.0), (1, 0.01)]))


def harmonics(spark, rows):
    df = spark.createDataFrame([(e, i, 1, p) for i, (e, p) in enumerate(rows)], "tic_id long, planet_number int, sector int, orbital_period_days double")
    return {r["planet_number"]: r["n_period_matches"] for r in windows.flag_period_harmonics(df).collect()}


def test_period_harmonics(spark):
    rows = [(1, 2.0), (1, 4.0), (1, 6.01), (1, 2.0), (2, 2.0), (2, None), (2, 0.0), (None, 2.0), (None, 2.0)]
    assert harmonics(spark, rows) == {0: 3, 1: 2, 2: 2, 3: 3, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_period_harmonics_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), round(rng.choice([1, 2, 3, 6]) * (1 + rng.uniform(-0.02, 0.02)), 3)) for _ in range(120)]
    near = lambda r: any(abs(r - t) / t < 0.01 for t in windows.HARMONICS)
    want = {i: sum(near(p / q) for j, (f, q) in enumerate(rows) if i != j and e == f) for i, (e, p) in enumerate(rows)}
    assert harmonics(spark, rows) == want


def test_period_harmonics_at_the_tolerance(spark):
    """Ratios on both sides of each edge, wherever the edge falls in a band."""
    rows = [(e, p) for e in range(300) for b in (1.07**e,) for t in (1.0, 2.0, 3.0) for p in (b, b * t * 0.99000001, b * t * 0.98999999, b * t * 1.00999999, b * t * 1.01000001)]
    near = lambda r: any(abs(r - t) / t < 0.01 for t in windows.HARMONICS)
    want = {i: sum(near(p / q) for j in range(i // 15 * 15, i // 15 * 15 + 15) for q in (rows[j][1],) if i != j) for i, (_, p) in enumerate(rows)}
    assert harmonics(spark, rows) == want


def test_period_harmonics_sends_a_period_to_few_bands(spark):
    """A period goes to one or two bands per target, not to three each."""
    df = spark.range(0, 2000).selectExpr("id AS tic_id", "CAST(1 AS INT) AS planet_number", "1 AS sector", "pow(1.003D, id) AS orbital_period_days")
    out = windows.flag_period_harmonics(df)
    out.collect()

    def rows_of_generates(node):
        inner = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node.plan() if "QueryStage" in node.nodeName() else None
        below = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if node.nodeName() == "Generate" else []
        return own + [n for b in below for n in rows_of_generates(b)]

    sent = rows_of_generates(out._jdf.queryExecution().executedPlan())
    assert len(sent) == 1 and 5 * 2000 <= sent[0] < 8 * 2000


def test_cuts(spark):
    config = {"stellar_cuts": {"tmag_min": 6, "tmag_max": 14, "log_g_min": 3.5}, "require_valid": ["log_g"], "required_for_clean": ["passed_tmag_cut", "passed_log_g_cut"]}
    df = spark.createDataFrame([(6.0, 3.5), (14.0, 3.4), (14.1, None), (None, 4.0)], "tess_mag double, log_g double")
    got = flags.apply_cuts(df, config).collect()
    assert [r["passed_tmag_cut"] for r in got] == [True, True, False, False]
    assert [r["passed_log_g_cut"] for r in got] == [True, False, False, True]
    assert [r["passed_ruwe_cut"] for r in got] == [None] * 4
    assert [r["in_clean_sample"] for r in got] == [True, False, False, False]
    assert [r["has_valid_stellar_params"] for r in got] == [True, True, False, True]


def test_anomaly_score_needs_all_parts(spark):
    df = spark.createDataFrame([(10.0, 350.0, 100.0), (0.0, 350.0, 100.0), (None, 1.0, 1.0)], "model_chi_square_reduced double, odd_even_depth_sig double, model_fit_snr double")
    got = [r["anomaly_score"] for r in flags.add_anomaly_score(df).collect()]
    assert got == [pytest.approx(1.0 + 0.3 + 1.0), None, None]


def test_type_flags(spark):
    types = {"eb": {"enabled": True, "codes": ["EB*", "EB"]}, "yso": {"enabled": False, "codes": ["Y*O"]}}
    df = spark.createDataFrame([("Star EB*",), ("V*,Y*O",), (None,), ("EBX",)], "otypes string")
    got = [(r["simbad_is_eb"], r["simbad_is_yso"], r["simbad_is_variable"]) for r in flags.derive_type_flags(df, types).collect()]
    assert got == [(True, False, True), (False, False, False), (False, False, False), (False, False, False)]


def test_sentinel_parameters(spark):
    df = spark.createDataFrame([(31000.0, 5.59962, 0.18), (31000.0, 5.6, 0.18), (None, 5.59962, 0.18)], "effective_temp double, log_g double, radius double")
    assert [r["has_sentinel_stellar_params"] for r in flags.flag_sentinel_parameters(df).collect()] == [True, False, False]


def one(spark, expr, kind="string", value=None):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "value"), [("12", 12), ("12.0", 12), (" 42 ", 42), ("12.5", None), ("", None), (None, None), ("x", None), ("nan", None), ("1e3", 1000)])
def test_to_long(spark, text, value):
    assert one(spark, nulls.to_long, value=text) == value


@pytest.mark.parametrize(("text", "value"), [("101", [1, 3]), ("1000", [4]), ("0", []), ("", []), (None, []), ("12", [])])
def test_bitmask(spark, text, value):
    assert (one(spark, exprs.decode_bitmask, value=text) or []) == value


@pytest.mark.parametrize(("uid", "run"), [("91-1-S47", "47-47"), ("91-1-S36-S69", "36-69"), ("91-1", None), ("91-1-Sx", None), (None, None), ("91-1-X2", None)])
def test_runs(spark, uid, run):
    assert one(spark, lambda c: exprs.normalize_run(exprs.run_of_uid(c)), value=uid) == run


def test_row_median(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (1.0, 2.0, 9.0), (None, None, float("nan"))], "z_shape_0 double, z_shape_1 double, z_shape_2 double")
    assert [r["median_z_score"] for r in exprs.add_median_z_score(df).collect()] == [3.0, 2.0, None]
    assert exprs.add_median_z_score(df.select(F.lit(1).alias("a"))).first()["median_z_score"] is None


def test_report_url(spark):
    assert one(spark, lambda c: exprs.report_url(c, F.lit(7)), "long", 123456).endswith("/s0007/target/0000/0000/0012/3456/hlsp_tess-spoc_tess_phot_0000000000123456-s0007-s0007_tess_v1_dvm.pdf")
    assert one(spark, lambda c: exprs.report_url(c, F.lit(7)), "string", "x") is None


def test_id_column():
    assert exprs.find_id_column(["a", "TIC_ID"]) == "TIC_ID" and exprs.find_id_column(["TICname", "x"]) == "TICname" and exprs.find_id_column(["x"]) is None


def test_absent_columns_give_null_metrics_and_no_flags(spark):
    rows = spark.createDataFrame([(1, 1, 2.5), (1, 2, 2.505), (None, 1, 2.5)], "tic_id long, planet_number int, orbital_period_days double")
    out = rows.transform(flags.add_derived_metrics).transform(flags.add_diagnostic_flags)
    got = {(r["tic_id"], r["planet_number"]): r for r in out.collect()}
    assert all(r[c] is None for r in got.values() for c in ("model_chi_square_reduced", "odd_even_depth_sig", "ghost_diagnostic_ratio"))
    assert got[1, 1]["flag_matching_period"] and got[1, 2]["flag_matching_period"] and not got[None, 1]["flag_matching_period"]
    bare = rows.select("planet_number").transform(flags.add_derived_metrics).transform(flags.add_diagnostic_flags).collect()
    assert len(bare) == 3 and not any(r[f] for r in bare for f in flags.DIAGNOSTIC_FLAGS)


def test_filter_catalogs_follow_their_switches(spark):
    from lumisift.plans import pipelines

    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, None)], "tic_id long")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "tic_id long")
    catalogs = {"a_eb": ids(1, None), "b_dipper": ids(2), "c_cpv": ids(3), "d_eb": None}
    got = {r["tic_id"]: r for r in pipelines.filter_chain(rows, {"catalog_filters": {"a_eb": True, "b_dipper": True, "c_cpv": False, "d_eb": True}}, catalogs).collect()}
    assert [got[i]["failed_known_eb"] for i in (1, 2, 3, None)] == [True, False, False, False]
    assert [got[i]["failed_known_dipper"] for i in (1, 2, 3, None)] == [False, True, False, False] and got[3]["passes_all_filters"]


def test_summary_records_skip_what_is_there(spark, tmp_path):
    from lumisift.plans import pipelines

    path = str(tmp_path / "records")
    rows = spark.createDataFrame([(1, 1, 36, 0.5), (2, 1, 37, 0.7)], "tic_id long, planet_number int, sector int, x double")
    pipelines.write_summary_records(rows.limit(1), path)
    pipelines.write_summary_records(rows.withColumn("x", F.lit(9.0)), path)
    got = {r["tic_id"]: r["record"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 2 and spark.read.parquet(path).count() == 2 and sum("9.0" in v for v in got.values()) == 1


def test_matching_periods_equal_brute_force(spark):
    """Gaps on both sides of the tolerance, equal and negative periods, values far beyond the tolerance, other orders of bands."""
    import random

    rng = random.Random(6)
    rows = [(e, rng.choice([0.0, 0.01, 0.015, 0.03]) * rng.randint(-3, 3) + rng.randint(0, 4) * 0.05 + rng.choice([0, 1e-12, 0.0099, 0.01])) for e in range(400) for _ in range(rng.randint(1, 4))]
    rows += [(1000, 1e300), (1000, 2e300), (1000, 3e300), (1001, 1e300), (1001, 1e300), (1002, float("inf")), (1002, float("inf")), (1003, float("nan")), (1003, float("nan")), (1004, None), (1004, None)]
    own = {}
    for e, p in rows:
        own.setdefault(e, []).append(p)
    finite = lambda v: sorted(p for p in v if p is not None and p == p and abs(p) < float("inf"))
    want = {e for e, v in own.items() if any(b - a < 0.01 for a, b in zip(finite(v), finite(v)[1:], strict=False))}
    got = matching(spark, rows)
    assert {e for e, _, m in got if m} == want and len(got) == len(rows) and 50 < len(want) < 380 and 1000 not in want and 1001 in want


def test_a_hot_entity_is_spread(spark):
    """A million rows of one entity: no window, no shuffle by the entity alone, and no task with most of the rows."""
    df = spark.range(1_000_000).select(F.lit(7).cast("long").alias("tic_id"), (F.col("id") * 0.011).alias("orbital_period_days")).union(spark.range(10).select(F.col("id") + 100, F.lit(1.0)))
    found = windows.matching_entities(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    assert found.count() == 0
    one = df.union(spark.createDataFrame([(7, 5500.0001)], "tic_id long, orbital_period_days double"))
    out = windows.add_matching_period_signals(one)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["tic_id"], r["matching_period_signals"], r["n"]) for r in out.groupBy("tic_id", "matching_period_signals").agg(F.count(F.lit(1)).alias("n")).collect()} == {(7, True, 1_000_001)} | {(100 + i, False, 1) for i in range(10)}


def test_periods_may_come_from_a_cheaper_table(spark):
    rows = spark.createDataFrame([(1, 3.0), (1, 3.005), (2, 3.0)], "tic_id long, orbital_period_days double")
    out = windows.add_matching_period_signals(rows.withColumn("more", F.lit(1)), periods=rows)
    assert {(r["tic_id"], r["matching_period_signals"]) for r in out.collect()} == {(1, True), (2, False)} and out.columns == ["tic_id", "orbital_period_days", "more", "matching_period_signals"]
