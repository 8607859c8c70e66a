"""Registered queries over the detection tables: each reads the test tables through the proxies and applies operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, nulls
from ..operators import aggs, flags, joins, select, sets, vetting, windows
from ..sources import catalogs as cat
from ..sources import reports, tables
from ..sources.scratch import scratch_path, stored
from ..streaming import incremental
from . import pipelines, proxy

KEYS = ["tic_id", "planet_number", "sector"]
STELLAR_ORDER = ["copy"]


def _stellar_order() -> list[Column]:
    return [F.col("copy").asc()]


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return proxy.tce(spark, d).transform(flags.add_derived_metrics)


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).transform(flags.add_diagnostic_flags).transform(flags.add_any_flag)


def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select(*KEYS, "model_chi_square_reduced", "odd_even_depth_sig", "ghost_diagnostic_ratio", "matching_period_signals")


def metrics_absent_columns(spark: SparkSession, d: str) -> DataFrame:
    """Metrics and flags of a table with few of their inputs: null and False, no error."""
    few = proxy.tce(spark, d).select(*KEYS, "model_chi_square", "orbital_period_days", "full_convergence")
    out = few.drop("orbital_period_days").transform(flags.add_derived_metrics).transform(flags.add_diagnostic_flags)
    return out.select(*KEYS, "model_chi_square_reduced", "odd_even_depth_sig", "ghost_diagnostic_ratio", "matching_period_signals", *flags.DIAGNOSTIC_FLAGS)


def report_tables(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a whole report in one table: gates, summary, one histogram, statistics, co-occurrence, survivors and their scores."""
    scores = proxy.predictions(proxy.tce(spark, d)).selectExpr("target_id AS tic_id", "tce_plnt_num AS planet_number", "score")
    # A report reads its sample many times, so the sample is built once.
    out = pipelines.report(stored(_sample(spark, d), "sample"), scores)
    gates = aggs.long_form(out["gates"], out["gates"].columns)
    bars = out["histogram_tess_mag"].select(F.concat(F.lit("tess_mag "), F.col("bin").cast("string")).alias("metric"), "n")
    known = out["statistics"].select(F.concat(F.lit("values of "), F.col("metric")).alias("metric"), "n")
    both = out["cooccurrence"].select(F.concat("flag_a", F.lit(" and "), "flag_b").alias("metric"), F.col("both").alias("n"))
    coverage = aggs.long_form(out["coverage"], out["coverage"].columns).withColumn("metric", F.concat(F.lit("survivors "), F.col("metric")))
    return reduce(DataFrame.unionByName, [gates, out["summary"].select("metric", "n"), bars, known, both, coverage])


def prefixed_columns(spark: SparkSession, d: str) -> DataFrame:
    return exprs.prefixed(proxy.stellar(spark, d).filter("copy = 0"), "cat_", ["tic_id"]).groupBy((F.col("tic_id") % 7).alias("part")).agg(F.count("cat_copy").alias("n"), F.max("cat_doyle_ruwe").alias("most"))


def score_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The work list of the survivors as a CSV folder, and the scores that came back for it, read from one."""
    out, back = scratch_path(spark, "worklist"), scratch_path(spark, "scored")
    proxy.predictions(proxy.tce(spark, d)).select("uid", "target_id", "tce_plnt_num", "score").write.csv(back)
    lines = spark.read.text(back)
    scores = tables.parse_predictions(lines, "uid,target_id,tce_plnt_num,score", "uid string, target_id long, tce_plnt_num int, score double")
    return pipelines.score_round_trip(flagged(spark, d), scores, f"{out}.csv", partitions=proxy.dealt(spark, d))


def matching_period(spark: SparkSession, d: str) -> DataFrame:
    return windows.add_matching_period_signals(proxy.tce(spark, d), 0.01).groupBy("matching_period_signals").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tic_id").alias("n_entities"))


def diagnostic_flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select(*KEYS, *flags.DIAGNOSTIC_FLAGS, "annotation_low_rchisq", "any_diagnostic_flag")


def any_flag(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("any_diagnostic_flag").agg(F.count(F.lit(1)).alias("n"))


def survivors(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).transform(flags.survivors).select(*KEYS, "model_fit_snr")


def stellar_cuts(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.enrich(proxy.tce(spark, d), proxy.stellar(spark, d), _stellar_order())
    return flags.apply_cuts(rows, proxy.CONFIG).select(*KEYS, "passed_tmag_cut", "passed_log_g_cut", "passed_parallax_cut", "passed_ruwe_cut", "has_valid_stellar_params", "in_clean_sample")


def enrich_left_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.enrich(proxy.tce(spark, d), proxy.stellar(spark, d), _stellar_order()).select(*KEYS, "doyle_parallax_over_error", "doyle_ruwe", "has_doyle_params")


def catalog_flags(spark: SparkSession, d: str) -> DataFrame:
    out = joins.add_catalog_flags(proxy.tce(spark, d), **proxy.id_catalogs(spark, d))
    return out.select(*KEYS, "flag_prsa_eb", "flag_kostov_eb", "flag_oddo_eb", "flag_catalog_eb", "annotation_kostov_candidate")


def crossmatch_counts(spark: SparkSession, d: str) -> DataFrame:
    out = joins.add_catalog_flags(proxy.tce(spark, d), **proxy.id_catalogs(spark, d))
    return aggs.bool_counts(out, ["flag_prsa_eb", "flag_kostov_eb", "flag_oddo_eb", "flag_catalog_eb", "annotation_kostov_candidate"])


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return windows.keep_first(proxy.stellar(spark, d), ["tic_id"], _stellar_order()).drop("copy")


def union_sectors(spark: SparkSession, d: str) -> DataFrame:
    rows = proxy.tce(spark, d).select(*KEYS, "tess_mag", "log_g")
    both = sets.union_sectors([rows.filter("sector < 60"), rows.filter("sector >= 60").drop("log_g")])
    return both.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.count("log_g").alias("n_log_g"), F.countDistinct("tic_id").alias("n_entities"))


def union_catalogs(spark: SparkSession, d: str) -> DataFrame:
    c = proxy.id_catalogs(spark, d)
    return sets.union_catalogs([c["prsa"], c["kostov_vetted"]])


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.build_sample([proxy.tce(spark, d)], proxy.CONFIG, stellar=proxy.stellar(spark, d), stellar_order=_stellar_order(), **proxy.id_catalogs(spark, d))


SAMPLE_COLUMNS = [*KEYS, "run_type", "has_doyle_params", "model_chi_square_reduced", "flag_catalog_eb", "any_diagnostic_flag", "passed_parallax_cut", "in_clean_sample", "sample_version"]


def build_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).select(*SAMPLE_COLUMNS)


def sample_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggs.sample_summary(_sample(spark, d))


def run_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggs.run_type_counts(exprs.classify_run_type(proxy.tce(spark, d)))


def summary_gates(spark: SparkSession, d: str) -> DataFrame:
    return aggs.summary_gates(_sample(spark, d))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggs.histogram(metrics(spark, d), "ghost_diagnostic_ratio").select("bin", "n")


def histogram_log(spark: SparkSession, d: str) -> DataFrame:
    return aggs.histogram(metrics(spark, d), "model_chi_square_reduced", log_x=True).select("bin", "n")


def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics take several passes, so the six columns are joined and computed once."""
    names = ["model_chi_square_reduced", "odd_even_depth_sig", "ghost_diagnostic_ratio", "model_fit_snr", "orbital_period_days", "tess_mag"]
    return aggs.distribution_stats(stored(metrics(spark, d).select(*names), "metrics"), names)


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return aggs.cooccurrence(flagged(spark, d), flags.DIAGNOSTIC_FLAGS)


def sectors_seen(spark: SparkSession, d: str) -> DataFrame:
    return aggs.sectors_seen(proxy.tce(spark, d)).select(F.array_join("sectors", ",").alias("sectors"))


def density2d(spark: SparkSession, d: str) -> DataFrame:
    return aggs.density2d(proxy.tce(spark, d), "model_fit_snr", "tess_mag", bins=20)


def survivor_table(spark: SparkSession, d: str) -> DataFrame:
    rows = flagged(spark, d)
    scores = exprs.add_median_z_score(proxy.predictions(proxy.tce(spark, d))).selectExpr("target_id AS tic_id", "tce_plnt_num AS planet_number", "score", "median_z_score")
    return select.survivor_table(rows, scores)


def sorted_page(spark: SparkSession, d: str) -> DataFrame:
    return select.sorted_page(proxy.tce(spark, d), "tess_mag", descending=True, size=50, offset=100).select("tic_id", "planet_number", "tess_mag")


def worklist(spark: SparkSession, d: str) -> DataFrame:
    return select.work_list(flagged(spark, d).transform(flags.survivors))


def _merged(spark: SparkSession, d: str, scoped: bool) -> DataFrame:
    rows = proxy.tce(spark, d)
    scores = proxy.predictions(rows)
    if scoped:  # every fifth score belongs to another run and must not match
        scores = scores.withColumn("uid", F.expr("CASE WHEN target_id % 5 = 0 THEN concat(CAST(target_id AS STRING), '-', CAST(tce_plnt_num AS STRING), '-S1-S2') ELSE uid END"))
    return joins.merge_predictions(rows, scores, scope_by_run=scoped, partitions=proxy.dealt(spark, d)).select(*KEYS, "score", "tce_period", "median_z_score", "uid")


def merge_predictions_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, True)


def merge_predictions_unscoped(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, False)


def median_z(spark: SparkSession, d: str) -> DataFrame:
    return exprs.add_median_z_score(proxy.predictions(proxy.tce(spark, d))).select("uid", "median_z_score")


def score_coverage(spark: SparkSession, d: str) -> DataFrame:
    return aggs.score_coverage(_merged(spark, d, True))


def suspect_joins(spark: SparkSession, d: str) -> DataFrame:
    return joins.count_suspect_joins(_merged(spark, d, False))


def uid_runs(spark: SparkSession, d: str) -> DataFrame:
    uid = F.expr("CASE WHEN tic_id % 4 = 0 THEN concat(tic_id, '-1-S', sector, '-S', sector + 3) WHEN tic_id % 4 = 1 THEN concat(tic_id, '-1-Sx', sector) WHEN tic_id % 4 = 2 THEN concat(tic_id, '-1') ELSE concat(tic_id, '-1-S', sector) END")
    rows = proxy.tce(spark, d).select(*KEYS, uid.alias("uid"))
    return rows.select(*KEYS, exprs.run_of_uid(F.col("uid")).alias("run_token"), exprs.normalize_run(exprs.run_of_uid(F.col("uid"))).alias("run"), exprs.sector_run(F.col("sector")).alias("own_run"))


def bitmask_sectors(spark: SparkSession, d: str) -> DataFrame:
    mask = F.expr("CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN concat(bin(o_custkey), 'x') ELSE bin(o_custkey) END")
    return proxy.table(spark, d, "orders").select("o_orderkey", F.nullif(F.array_join(exprs.decode_bitmask(mask), ","), F.lit("")).alias("sectors"))


def report_urls(spark: SparkSession, d: str) -> DataFrame:
    return proxy.tce(spark, d).select(*KEYS, exprs.report_url(F.col("tic_id"), F.col("sector")).alias("url"))


def log10_values(spark: SparkSession, d: str) -> DataFrame:
    return proxy.tce(spark, d).select(*KEYS, nulls.log10_positive(F.col("odd_even_depth_statistic")).alias("log_statistic"))


# --- ingest ----------------------------------------------------------------------------------------


def report_texts(rows: DataFrame) -> DataFrame:
    """Report files rendered from detections: (path, value), one per target; every 50th is broken, every 77th has another root."""
    attr = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))
    c = F.col
    s = {n: F.expr(e) for n, e in proxy.REPORT_SIGNAL.items()}
    t = {n: F.expr(e) for n, e in proxy.REPORT_TARGET.items()}
    attrs = lambda of, **names: F.concat(*[attr(name, of[out]) for name, out in names.items()])
    sky = lambda tag, col: F.concat(F.lit(f"<{tag}><meanSkyOffset"), attr("value", c(col) * 2), attr("uncertainty", F.when(c(col).isNotNull(), F.lit("2.0"))), F.lit(f"/></{tag}>"))
    parameter = lambda name, out: F.concat(F.lit(f'<dv:modelParameter name="{name}"'), attr("value", c(out) if out == "orbital_period_days" else s[out]), F.lit(' uncertainty="0.5"/>'))
    one = F.concat(
        F.lit("<dv:planetResults"), attr("planetNumber", F.when((c("tic_id") + c("planet_number")) % 11 != 0, c("planet_number"))), attrs(s, toiId="tce_toi_id", toiCorrelation="toi_correlation", detrendFilterLength="detrend_filter_length"),
        F.lit("><dv:planetCandidate"), attr("suspectedEclipsingBinary", c("suspected_eclipsing_binary")),
        attrs(s, maxSingleEventSigma="max_single_event_sigma", maxMultipleEventSigma="max_multiple_event_sigma", robustStatistic="robust_statistic", modelChiSquare2="model_chi_square_2", modelChiSquareDof2="model_chi_square_dof_2", modelChiSquareGof="model_chi_square_gof", modelChiSquareGofDof="model_chi_square_gof_dof"),
        F.lit("><dv:weakSecondary"), attrs(s, mesMad="weak_secondary_mes_mad", robustStatistic="weak_secondary_robust_statistic"), F.lit("/></dv:planetCandidate>"),
        F.lit("<dv:allTransitsFit"), attr("fullConvergence", c("full_convergence")), attr("modelChiSquare", c("model_chi_square")), attr("modelDegreesOfFreedom", c("model_degrees_of_freedom")), attr("modelFitSnr", c("model_fit_snr")), attrs(s, transitModelName="transit_model_name"),
        F.lit('><dv:modelParameters><dv:modelParameter name="other" value="1"/>'), *[parameter(name, out) for name, out in reports.MODEL_PARAMETERS.items()], F.lit("</dv:modelParameters></dv:allTransitsFit>"),
        F.lit("<dv:binaryDiscriminationResults><dv:oddEvenTransitDepthComparisonStatistic"), attr("value", c("odd_even_depth_statistic")), attr("significance", c("odd_even_depth_significance")), F.lit("/></dv:binaryDiscriminationResults>"),
        F.lit("<dv:bootstrapResults"), attrs(s, significance="bootstrap_significance"), F.lit("/>"),
        F.lit("<dv:centroidResults><dv:differenceImageMotionResults>"), sky("msTicCentroidOffsets", "ms_tic_centroid_offset_sigma"), sky("msControlCentroidOffsets", "ms_control_centroid_offset_sigma"), F.lit("</dv:differenceImageMotionResults></dv:centroidResults>"),
        F.lit("<dv:ghostDiagnosticResults><dv:coreApertureCorrelationStatistic"), attr("value", c("ghost_core_correlation")), attrs(s, significance="ghost_core_correlation_significance"),
        F.lit("/><dv:haloApertureCorrelationStatistic"), attr("value", c("ghost_halo_correlation")), attrs(s, significance="ghost_halo_correlation_significance"), F.lit("/></dv:ghostDiagnosticResults>"),
        F.repeat(F.lit('<dv:differenceImageResults sector="1"/>'), c("n_difference_images") - 1), F.lit("<dv:differenceImageResults"), attr("sector", c("sector")), F.lit("/></dv:planetResults>"))
    grouped = rows.groupBy("tic_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("body"), F.min("tess_mag").alias("mag"))
    stars = [F.concat(F.lit(f"<dv:{element}"), attr("value", c("mag") if out == "tess_mag" else t[out]), F.lit("/>")) for element, out in reports.STELLAR.items()]
    head = F.concat(
        F.lit('<?xml version="1.0"?>\n<dv:dvTargetResults xmlns:dv="urn:report"'), attr("ticId", c("tic_id")), attrs(t, toiId="toi_id", planetCandidateCount="planet_candidate_count", startCadence="start_cadence", endCadence="end_cadence", pipelineTaskId="pipeline_task_id"), F.lit(' sectorsObserved="101">'),
        F.lit("<dv:matchedToiId>M"), (c("tic_id") % 8).cast("string"), F.lit("</dv:matchedToiId><dv:matchedToiId></dv:matchedToiId><dv:matchedToiId>M9</dv:matchedToiId>"), *stars,
        F.lit("<dv:limbDarkeningModel"), attrs(t, modelName="limb_darkening_model", **{f"coefficient{i}": f"limb_darkening_c{i}" for i in range(1, 5)}), F.lit("/>"))
    good = F.concat(head, c("body"), F.lit("</dv:dvTargetResults>"))
    text = F.when(c("tic_id") % 50 == 0, F.concat(head, c("body"))).when(c("tic_id") % 77 == 0, F.lit("<other/>")).otherwise(good)
    return grouped.select(F.concat(F.lit("/reports/"), c("tic_id").cast("string"), F.lit(".xml")).alias("path"), text.alias("value"))


def parse_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the parsed signals, lists as text."""
    parsed = reports.parse_reports(report_texts(proxy.tce(spark, d)))
    return parsed.signals.withColumns({x: F.array_join(x, ",") for x in ("sectors_observed", "matched_toi_ids")})


def reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.parse_errors(report_texts(proxy.tce(spark, d))).groupBy("level", "error_type").agg(F.count(F.lit(1)).alias("n"))


def _stellar_lines(rows: DataFrame) -> DataFrame:
    """Catalog rows as lines of the stellar layout."""
    texts = {"tic_id": F.col("tic_id").cast("string"), "doyle_parallax_over_error": F.col("doyle_parallax_over_error").cast("string"), "doyle_ruwe": F.when(F.col("tic_id") % 4 != 0, F.col("doyle_ruwe").cast("string"))}
    cells, at = [], 1
    for name, start, stop, _ in cat.STELLAR_LAYOUT:
        cells += [F.lpad(F.lit(""), start - at, " "), F.lpad(F.coalesce(texts.get(name, F.lit("")), F.lit("")), stop - start + 1, " ")]
        at = stop + 1
    return rows.select(F.concat(*cells).alias("value"))


def fixed_width(spark: SparkSession, d: str) -> DataFrame:
    lines = _stellar_lines(proxy.stellar(spark, d).filter("copy = 0"))
    return cat.parse_fixed_width(lines, cat.STELLAR_LAYOUT).select("tic_id", "doyle_parallax_over_error", "doyle_ruwe", "doyle_gaia_dr3")


def catalog_ids(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE o_custkey % 4 WHEN 0 THEN concat(' ', o_orderkey, ' ') WHEN 1 THEN concat(o_orderkey, '.0') WHEN 2 THEN concat(o_orderkey, '.5') ELSE 'n/a' END")
    return cat.with_ids(proxy.table(spark, d, "orders").select(text.alias("TIC")))[0].select("ticId")


# --- specified operators -----------------------------------------------------------------------------


def period_harmonics(spark: SparkSession, d: str) -> DataFrame:
    return windows.flag_period_harmonics(proxy.tce(spark, d)).select(*KEYS, "period_harmonic_match", "n_period_matches")


#: Fixed values of the filter configuration.
FILTERS = {
    "data_quality": {"require_convergence": True, "centroid_offset_sigma_max": 3.0, "ghost_ratio_min": 1.0, "model_fit_snr_min": 20.0},
    "false_positive": {"odd_even_significance_max": 35.0, "treat_suspected_eb_as_failed": True, "fail_period_harmonics": True},
    "catalog_filters": {"prsa_eb": True, "kostov_eb": True, "oddo_dipper": True, "unvetted_cpv": False, "high_ruwe": True},
    "simbad_filter": {"enabled": True},
    "anomaly": {"reduced_chisq_min": 1.1},
}
#: Object types of the proxy: words of p_type and brands stand for type codes.
TYPES = {"eclipsing_binary": {"enabled": True, "codes": ["PROMO", "SMALL"], "flag": "simbad_is_eb"}, "pulsating_variable": {"enabled": True, "codes": ["ECONOMY"], "flag": "simbad_is_pulsating"}, "generic_variable": {"enabled": False, "codes": ["LARGE"], "flag": "simbad_is_generic"}}
FAILED = ["failed_convergence", "failed_centroid", "failed_ghost", "failed_low_snr", "failed_suspected_eb", "failed_odd_even", "failed_period_harmonic", "failed_known_eb", "failed_known_dipper", "failed_simbad_variable", "failed_well_fit"]


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = flags.derive_type_flags(metrics(spark, d), TYPES)
    c = proxy.id_catalogs(spark, d)
    catalogs = {"prsa_eb": c["prsa"], "kostov_eb": c["kostov_vetted"], "oddo_dipper": c["oddo"], "unvetted_cpv": c["kostov_unvetted"], "high_ruwe": c["kostov_unvetted"]}
    return pipelines.filter_chain(rows, FILTERS, catalogs, harmonics=True)


def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d).select(*KEYS, *FAILED, "passes_all_filters")


def anomaly_score(spark: SparkSession, d: str) -> DataFrame:
    return flags.add_anomaly_score(metrics(spark, d)).select(*KEYS, "score_chisq", "score_odd_even", "score_snr", "anomaly_score")


def type_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags.derive_type_flags(proxy.tce(spark, d), TYPES).select(*KEYS, "simbad_is_eb", "simbad_is_pulsating", "simbad_is_generic", "simbad_is_variable")


NOW = "2024-02-01 00:00:00"


def stale_lookups(spark: SparkSession, d: str) -> DataFrame:
    ids = proxy.table(spark, d, "customer").select(F.col("c_custkey").alias("tic_id"))
    events = proxy.table(spark, d, "events")
    latest = events.agg(F.max("ts")).scalar()
    cache = events.select(F.col("user_id").alias("tic_id"), F.col("ts").alias("queried_at"))
    return incremental.stale_lookups(ids, cache, latest, max_age_days=1)


def newest_lookups(spark: SparkSession, d: str) -> DataFrame:
    events = proxy.table(spark, d, "events").select(F.col("user_id").alias("tic_id"), F.col("ts").alias("queried_at"), "event_id")
    return incremental.upsert_lookups(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")).select("tic_id", "queried_at", "event_id")


def family_flags(spark: SparkSession, d: str) -> DataFrame:
    c = proxy.id_catalogs(spark, d)
    out = joins.add_family_flags(proxy.tce(spark, d), {"a": ("eb", c["prsa"], True), "b": ("eb", c["kostov_vetted"], False), "c": ("dipper", c["oddo"], True)})
    return out.select(*KEYS, "in_family_eb", "in_family_dipper")


def parent_sample(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.build_parent_sample(proxy.tce(spark, d), proxy.CONFIG, windows.keep_first(proxy.stellar(spark, d), ["tic_id"], _stellar_order()))
    return out.select("tic_id", F.array_join("sectors", ",").alias("sectors"), "baseline_sectors", "tess_mag", "effective_temp", "radius", "log_g", "has_doyle_params", "passed_tmag_cut", "passed_log_g_cut", "passed_parallax_cut", "passed_ruwe_cut", "in_clean_sample")


def top_n(spark: SparkSession, d: str) -> DataFrame:
    scored = flags.add_anomaly_score(flagged(spark, d)).withColumn("passes_all_filters", ~F.col("any_diagnostic_flag"))
    return select.select_candidates(scored, top_n=100).select(*KEYS, "anomaly_score", "is_control_sample")


def control_sample(spark: SparkSession, d: str) -> DataFrame:
    failed = flagged(spark, d).withColumn("passes_all_filters", ~F.col("any_diagnostic_flag"))
    return select.control_sample(failed, 50).select(*KEYS, "is_control_sample")


def shared_triples(spark: SparkSession, d: str) -> DataFrame:
    return flags.flag_shared_parameters(proxy.tce(spark, d), ["effective_temp", "log_g", "radius"], least=3).select(*KEYS, "has_shared_stellar_params")


def sentinel_parameters(spark: SparkSession, d: str) -> DataFrame:
    return flags.flag_sentinel_parameters(proxy.tce(spark, d), {"log_g": 1.0, "radius": 0.5}).select(*KEYS, "has_sentinel_stellar_params")


def deep_eclipse(spark: SparkSession, d: str) -> DataFrame:
    return flags.flag_deep_eclipse(proxy.tce(spark, d), 100_000.0).select(*KEYS, "flag_deep_eclipse")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'click' THEN 'unsure' WHEN 'view' THEN 'planet' WHEN 'purchase' THEN 'background' ELSE event_type END")
    return proxy.table(spark, d, "events").select(
        F.col("user_id").alias("candidate_id"), F.expr("concat('v', CAST(event_id % 2 AS STRING))").alias("vetter_id"), F.expr("CAST(event_id % 3 AS INT)").alias("vetting_round"),
        kind.alias("classification"), F.expr("CASE WHEN event_id % 9 = 0 THEN 'certain' ELSE 'high' END").alias("confidence"), F.col("ts").alias("decided_at"), "event_id")


def decision_rejects(spark: SparkSession, d: str) -> DataFrame:
    return vetting.validate_decisions(_decisions(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def agreement(spark: SparkSession, d: str) -> DataFrame:
    return vetting.agreement(vetting.validate_decisions(_decisions(spark, d))[0])


def revet_queue(spark: SparkSession, d: str) -> DataFrame:
    return vetting.revet_queue(vetting.validate_decisions(_decisions(spark, d))[0])


def new_files(spark: SparkSession, d: str) -> DataFrame:
    listed = proxy.table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"))
    log = proxy.table(spark, d, "orders").filter("o_custkey % 3 = 0").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'done' ELSE 'failed' END").alias("status"), F.col("o_orderdate").alias("recorded_at"))
    return incremental.pending(listed, log)


def phase_fold(spark: SparkSession, d: str) -> DataFrame:
    series = proxy.table(spark, d, "events").select(F.col("user_id").alias("tic_id"), F.expr("CAST(event_id % 1000 AS DOUBLE)").alias("t"), "value")
    candidates = proxy.tce(spark, d).select("tic_id", "planet_number", "orbital_period_days", F.lit(0.5).alias("epoch"))
    return pipelines.phase_fold(series, candidates, bins=20)


def decisions_for(spark: SparkSession, d: str) -> DataFrame:
    """The operator is a lookup: all decisions on one candidate, here the seventh user."""
    valid = vetting.validate_decisions(_decisions(spark, d))[0]
    return vetting.decisions_for(valid, 7).select("candidate_id", "vetter_id", "vetting_round", "classification", "event_id")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    classes = ["unsure", "planet", "background"]
    return vetting.confusion(vetting.validate_decisions(_decisions(spark, d))[0], classes)


def read_folder(spark: SparkSession, d: str) -> DataFrame:
    """All files of a folder that match a pattern, columns by name."""
    return tables.read_sectors(spark, d, "orders*.parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))


#: A head as tables of this kind have it; the query renders its rows below.
_MRT_HEAD = ["Title: orders", "=" * 40, "Byte-by-byte Description of file: t.txt", "-" * 40, "   Bytes Format Units Label Explanations", "-" * 40, "   1-  9 I9     ---   TIC   id", "  11- 20 F10.2  d     Per   period", "      22 A1     ---   Flag  kind", "-" * 40]


def machine_readable(spark: SparkSession, d: str) -> DataFrame:
    orders = proxy.table(spark, d, "orders")
    path = scratch_path(spark, "mrt")
    line = F.concat(F.lpad(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("-")), 9, " "), F.lit(" "), F.lpad((F.col("o_custkey") / 4).cast("string"), 10, " "), F.lit(" "), F.substring("o_orderstatus", 1, 1))
    # Files of a status, each with its head before its rows; as many as keep a task's share from growing. A rule-like line among the rows.
    n = proxy.partitions(orders.count())
    file = F.pmod(F.hash("o_orderkey"), F.lit(n)).alias("file")
    rows = orders.select("o_orderstatus", file, F.lit(1).alias("turn"), F.when(F.col("o_orderkey") % 1000 == 0, F.lit("-" * 40)).otherwise(line).alias("value"))
    heads = rows.select("o_orderstatus", "file").distinct().select("o_orderstatus", "file", F.lit(0).alias("turn"), F.lit("\n".join(_MRT_HEAD)).alias("value"))
    rows.union(heads).repartition(3 * n, "o_orderstatus", "file").sortWithinPartitions("o_orderstatus", "file", "turn").select("o_orderstatus", "file", "value").write.partitionBy("o_orderstatus", "file").text(path)
    return cat.read_mrt(spark, f"{path}/*/*/*.txt").select(F.col("ticId").alias("tic_id"), "Per", "Flag")


def summary_records(spark: SparkSession, d: str) -> DataFrame:
    rows = flagged(spark, d).transform(flags.survivors).select(*KEYS, "model_fit_snr", "any_diagnostic_flag")
    return pipelines.summary_records(rows).select(*KEYS, F.get_json_object("record", "$.model_fit_snr").cast("double").alias("snr"), F.get_json_object("record", "$.any_diagnostic_flag").alias("flagged"))


# --- what is written and read back ------------------------------------------------------------------


def sample_sink(spark: SparkSession, d: str) -> DataFrame:
    """A sample written by sector with its provenance and thresholds: what another run reads back of it."""
    path = scratch_path(spark, "sample")
    tables.write_sample(_sample(spark, d), path, proxy.CONFIG)
    back = tables.read_table(spark, path)
    held = tables.read_thresholds(back)
    rows = back.groupBy("sector", "sample_version").agg(F.count(F.lit(1)).alias("n"), F.count_if("any_diagnostic_flag").alias("n_flagged"))
    return rows.withColumns({"tmag_max": F.lit(float(held["stellar_cuts"]["tmag_max"])), "log_g_min": F.lit(float(held["stellar_cuts"]["log_g_min"]))})


def _a_file_a_row(lines: DataFrame, folder: str) -> None:
    """Every line as a file of its own, in one folder: a folder for each would have to be listed for each."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, "value").write.option("maxRecordsPerFile", 1).text(folder)


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """Report files scanned from a folder tree, parsed, and written by sector beside their errors: counts of the run and of what is read back."""
    folder = scratch_path(spark, "reports")
    suppliers = proxy.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tic_id"), "s_acctbal")
    planet = lambda n, sector: F.concat(F.lit(f'<planetResults planetNumber="{n}"><bootstrapResults significance="'), F.col("s_acctbal").cast("string"), F.lit(f'"/><differenceImageResults sector="{sector}"/></planetResults>'))
    body = F.concat(planet(1, 5), planet("x", 6), F.when(F.col("tic_id") % 3 == 0, planet(2, 7)).otherwise(""))
    end = F.when(F.col("tic_id") % 7 == 0, "").otherwise("</dvTargetResults>")
    text = F.when(F.col("tic_id") % 11 == 0, "<other/>").otherwise(F.concat(F.lit("<!-- <a> --><dvTargetResults ticId=\""), F.col("tic_id").cast("string"), F.lit('">'), body, end))
    _a_file_a_row(suppliers.select(text.alias("value")), folder)
    counts: dict[str, int] = {}
    parsed = reports.parse_reports(reports.scan_reports(spark, folder, "*.txt"))
    reports.write_signals(parsed, f"{folder}-signals", f"{folder}-errors", "v1", counts)
    signals = spark.read.parquet(f"{folder}-signals").groupBy(F.concat(F.lit("sector "), F.col("sector").cast("string"), F.lit(" by "), F.col("parser_version")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    errors = spark.read.json(f"{folder}-errors").groupBy(F.concat_ws(" ", "level", "error_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    run = spark.createDataFrame(list(counts.items()), "metric string, n long")
    return run.unionByName(signals).unionByName(errors)


def worklist_sink(spark: SparkSession, d: str) -> DataFrame:
    """The work list as a CSV folder, read back by its suffix."""
    path = scratch_path(spark, "worklist") + ".csv"
    tables.write_work_list(flagged(spark, d).transform(flags.survivors), path)
    return tables.read_table(spark, path, "tic_id long, sector_run string")


def predictions_with_comments(spark: SparkSession, d: str) -> DataFrame:
    """Scores read from a CSV with comment lines, comments behind values and a quoted #."""
    path = scratch_path(spark, "scores")
    rows = proxy.predictions(proxy.tce(spark, d))
    tail = F.when(F.col("target_id") % 3 == 0, " # checked, twice").when(F.col("target_id") % 3 == 1, "#").otherwise("")
    note = F.when(F.col("target_id") % 2 == 0, F.lit('"a # b, c"')).otherwise(F.lit("plain"))
    line = F.concat_ws(",", F.col("uid"), F.col("target_id").cast("string"), F.col("tce_plnt_num").cast("string"), note, F.col("score").cast("string"))
    text = F.when(F.col("tce_plnt_num") == 1, F.concat(F.lit("# next target\n"), line, tail)).otherwise(F.concat(line, tail))
    # Every row brings a header, as where the files of several runs are put together.
    rows.select(F.concat(F.lit("# made by a scorer\nuid,target_id,tce_plnt_num,note,score # header\n"), text).alias("value")).write.text(path)
    return tables.read_predictions(spark, path, "uid string, target_id long, tce_plnt_num int, note string, score double")


def _cents(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def skipped_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder in which whole and broken files stand side by side: rows that a tolerant read gives, and files that it skips, by reason."""
    folder = scratch_path(spark, "mixed")
    orders = proxy.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    orders.write.parquet(f"{folder}/whole")
    orders.limit(0).write.parquet(f"{folder}/empty")
    _a_file_a_row(proxy.table(spark, d, "supplier").select(F.concat(F.lit("no table, only text "), "s_name").alias("value")), f"{folder}/broken")
    schema = "o_orderkey long, o_totalprice double"
    paths = [f"{folder}/whole", f"{folder}/empty", f"{folder}/broken", f"{folder}/missing"]
    rows = tables.read_tolerant(spark, paths, schema).agg(F.lit("rows").alias("what"), F.count(F.lit(1)).alias("n"), _cents("o_totalprice").alias("total"))
    skipped = tables.skipped_files(spark, paths, schema).groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))
    return rows.unionByName(skipped)


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """A folder streamed in two runs, the last batch replayed as after a crash: rows by batch as readers see them, with the attempts behind them."""
    folder, source, checkpoint = (scratch_path(spark, x) for x in ("committed", "arrivals", "stream"))
    orders = proxy.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    schema = "o_orderkey long, o_custkey long, o_totalprice double"
    orders = orders.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
    run = lambda: incremental.stream_files(spark, source, schema, folder, checkpoint, "v1").awaitTermination()
    for part in (0, 1):
        orders.filter(F.col("o_orderkey") % 2 == part).write.mode("append").parquet(source)
        run()
    # The last batch is planned but not marked as done: the next run does it again.
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/1")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, False)
    run()
    rows = incremental.read_committed(spark, folder, schema).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), _cents("o_totalprice").alias("total"))
    runs = incremental.run_history(spark, folder).groupBy("batch").agg(F.count(F.lit(1)).alias("n_attempts"), F.sum(F.when(F.col("current"), F.col("n_rows"))).alias("n_recorded"), F.max("version").alias("version"))
    return rows.join(runs, "batch")


def entity_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entities from sketches stored by sector, united for all and for each half: whether within 3 % of the exact count."""
    path, rows = scratch_path(spark, "sketches"), proxy.tce(spark, d)
    aggs.entity_sketches(rows).write.parquet(path)
    half = (F.col("sector") % 2).alias("half")
    stored = spark.read.parquet(path)
    united = aggs.entities_of_sketches(stored.withColumn("half", half), ["half"]).unionByName(aggs.entities_of_sketches(stored).withColumn("half", F.lit(None).cast("int")))
    exact = rows.cube(half).agg(F.countDistinct("tic_id").alias("exact")).withColumnRenamed("half", "of")
    near = F.abs(F.col("n_entities") - F.col("exact")) <= 0.03 * F.col("exact")
    return united.join(exact, F.col("half").eqNullSafe(F.col("of"))).select("half", "n_rows", "exact", near.alias("near"))


def cached_lookups(spark: SparkSession, d: str) -> DataFrame:
    """A stored cache of lookups brought up to date bucket by bucket."""
    path = scratch_path(spark, "cache")
    events = proxy.table(spark, d, "events").select(F.col("user_id").alias("tic_id"), F.col("ts").alias("queried_at"), "event_id")
    for part in (0, 1):
        incremental.upsert_cache(events.filter(F.col("event_id") % 2 == part), path, buckets=16)
    return spark.read.parquet(path).select("tic_id", "queried_at", "event_id")


def bucketed_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Detections and catalog stored in buckets of the id, then joined without an exchange."""
    rows, stars = (f"t{scratch_path(spark, 'b').rsplit('-', 1)[1]}" for _ in range(2))
    tables.write_bucketed(proxy.tce(spark, d).select(*KEYS), rows, scratch_path(spark, "bucketed"), buckets=8)
    tables.write_bucketed(proxy.stellar(spark, d), stars, scratch_path(spark, "bucketed"), buckets=8)
    return joins.enrich(spark.table(rows), spark.table(stars), _stellar_order()).select(*KEYS, "doyle_parallax_over_error", "doyle_ruwe", "has_doyle_params")


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The fourth page, reached by the last row of each page before it."""
    rows, last = proxy.tce(spark, d).select("tic_id", "planet_number", "log_g"), None
    for _ in range(3):
        last = select.cursor_of(select.page_after(rows, "log_g", last, descending=True, size=40), "log_g")
    return select.page_after(rows, "log_g", last, descending=True, size=40)


def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """The one-to-one check on rows that pass it."""
    checked = joins.require_unique(proxy.tce(spark, d), ["tic_id", "planet_number"], "detections")
    return checked.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def found_id_column(spark: SparkSession, d: str) -> DataFrame:
    """A CSV catalog whose id column is found by its name."""
    path = scratch_path(spark, "ids")
    proxy.table(spark, d, "orders").select(F.col("o_custkey").alias("other"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).otherwise("none").alias("Tic_ID")).write.csv(path, header=True)
    return cat.read_id_csv(spark, path, None).select("ticId")


def stored_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A gzipped fixed-width catalog, read through its Parquet copy."""
    path, folder = scratch_path(spark, "stars"), scratch_path(spark, "copies")
    rows = proxy.stellar(spark, d).filter("copy = 0")
    _stellar_lines(rows).coalesce(1).write.option("compression", "gzip").text(path)
    for _ in range(2):  # the second read finds the copy
        stars = cat.stored_catalog(spark, path, folder, lambda s, p: cat.read_fixed_width(s, p, partitions=8))
    return stars.select("tic_id", "doyle_parallax_over_error", "doyle_ruwe", "doyle_gaia_dr3")


def absent_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Flags where three catalogs are unset, a placeholder and missing, and one is there."""
    path = scratch_path(spark, "catalog")
    proxy.id_catalogs(spark, d)["oddo"].write.parquet(path)
    read = lambda where: cat.optional_catalog(spark, where, lambda s, p: s.read.parquet(p))
    out = joins.add_catalog_flags(proxy.tce(spark, d), prsa=read(None), kostov_vetted=read("/path/to/catalog"), kostov_unvetted=read(f"{path}-missing"), oddo=read(path))
    return aggs.bool_counts(out, ["flag_prsa_eb", "flag_kostov_eb", "flag_oddo_eb", "flag_catalog_eb", "annotation_kostov_candidate"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        derived_metrics, matching_period, diagnostic_flags, any_flag, survivors, stellar_cuts, enrich_left_join, catalog_flags, crossmatch_counts, dedupe_first,
        union_sectors, union_catalogs, build_sample, sample_summary, run_type_counts, summary_gates, histogram, histogram_log, distribution_stats, cooccurrence,
        sectors_seen, density2d, survivor_table, sorted_page, worklist, merge_predictions_scoped, merge_predictions_unscoped, median_z, score_coverage, suspect_joins,
        uid_runs, bitmask_sectors, report_urls, log10_values, parse_reports, reject_counts, fixed_width, catalog_ids, period_harmonics, filter_chain, anomaly_score,
        type_flags, stale_lookups, newest_lookups, family_flags, parent_sample, top_n, control_sample, shared_triples, sentinel_parameters, deep_eclipse,
        decision_rejects, agreement, revet_queue, new_files, phase_fold, summary_records, metrics_absent_columns, report_tables, prefixed_columns, score_round_trip,
        decisions_for, confusion, read_folder, machine_readable, sample_sink, report_files, worklist_sink, predictions_with_comments, skipped_files, stream_replay,
        entity_sketches, cached_lookups, bucketed_enrich, keyset_page, unique_keys, found_id_column, absent_catalogs, stored_catalog,
    )
}
