"""The queries in plain SQL over the same tables, to hold results against another engine."""

from __future__ import annotations

from ..sources.reports import MODEL_PARAMETERS
from . import proxy
from .queries import TYPES

_TCE = f"tce AS ({proxy.TCE_SQL})"
_MET = """
gaps AS (SELECT *, orbital_period_days - lag(orbital_period_days) OVER (PARTITION BY tic_id ORDER BY orbital_period_days NULLS FIRST) AS gap FROM tce),
met AS (SELECT * EXCLUDE (gap),
  model_chi_square / nullif(model_degrees_of_freedom, 0) AS model_chi_square_reduced,
  CASE WHEN odd_even_depth_statistic >= 0 THEN sqrt(odd_even_depth_statistic) END AS odd_even_depth_sig,
  ghost_core_correlation / nullif(ghost_halo_correlation, 0) AS ghost_diagnostic_ratio,
  coalesce(bool_or(gap < 0.01) OVER (PARTITION BY tic_id), FALSE) AS matching_period_signals FROM gaps)"""
_CENTROID = "(ms_tic_centroid_offset_sigma IS NOT NULL OR ms_control_centroid_offset_sigma IS NOT NULL) AND NOT (coalesce(ms_tic_centroid_offset_sigma < 3, FALSE) OR coalesce(ms_control_centroid_offset_sigma < 3, FALSE))"
_RULES = {
    "flag_suspected_eb": "coalesce(suspected_eclipsing_binary, FALSE)",
    "flag_no_convergence": "coalesce(NOT full_convergence, FALSE)",
    "flag_invalid_odd_even": "coalesce(odd_even_depth_significance = -1, FALSE)",
    "flag_background_eb": "coalesce(ghost_diagnostic_ratio < 1, FALSE)",
    "flag_centroid_offset": _CENTROID,
    "flag_matching_period": "matching_period_signals",
    "flag_large_odd_even": "coalesce(odd_even_depth_sig > 35, FALSE)",
    "flag_low_snr": "coalesce(model_fit_snr < 10, FALSE)",
}
_FLG = "flg0 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _RULES.items()) + ", coalesce(model_chi_square_reduced < 1.1, FALSE) AS annotation_low_rchisq FROM met),\nflg AS (SELECT *, " + " OR ".join(_RULES) + " AS any_diagnostic_flag FROM flg0)"
_STELLAR = f"stellar AS (SELECT * FROM ({proxy.STELLAR_SQL}) QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY copy) = 1)"
_CUTS = """coalesce(tess_mag BETWEEN 6 AND 14, FALSE) AS passed_tmag_cut, coalesce(log_g >= 3.5, FALSE) AS passed_log_g_cut,
  coalesce(doyle_parallax_over_error >= 5, FALSE) AS passed_parallax_cut, coalesce(doyle_ruwe < 1.4, FALSE) AS passed_ruwe_cut,
  effective_temp IS NOT NULL AND radius IS NOT NULL AND log_g IS NOT NULL AND tess_mag IS NOT NULL AS has_valid_stellar_params"""
_CLEAN = "passed_tmag_cut AND passed_log_g_cut AND passed_parallax_cut AND passed_ruwe_cut AND has_valid_stellar_params AS in_clean_sample"
_CATALOGS = """tic_id % 97 = 0 AS flag_prsa_eb, tic_id % 89 = 0 AS flag_kostov_eb, tic_id % 101 = 0 AS flag_oddo_eb,
  tic_id % 97 = 0 OR tic_id % 89 = 0 OR tic_id % 101 = 0 AS flag_catalog_eb, tic_id % 3 = 1 AS annotation_kostov_candidate"""
_SAMPLE = f"""sample0 AS (SELECT flg.* EXCLUDE (any_diagnostic_flag), s.doyle_parallax_over_error, s.doyle_ruwe, s.tic_id IS NOT NULL AS has_doyle_params,
  {_CATALOGS.replace("tic_id", "flg.tic_id")}, any_diagnostic_flag OR flg.tic_id % 97 = 0 OR flg.tic_id % 89 = 0 OR flg.tic_id % 101 = 0 AS any_diagnostic_flag,
  any_diagnostic_flag AS by_diagnostics, CASE WHEN n_difference_images > 1 THEN 'multi_sector' ELSE 'single_sector' END AS run_type FROM flg LEFT JOIN stellar s ON flg.tic_id = s.tic_id),
sample1 AS (SELECT *, {_CUTS} FROM sample0), sample AS (SELECT *, {_CLEAN} FROM sample1)"""
_FULL = f"WITH {_TCE}, {_MET}, {_FLG}, {_STELLAR}, {_SAMPLE}"
_MEDIAN = "list_median([z_shape_0, z_shape_1, z_shape_2])"
_PRED = f"pred AS ({proxy.PREDICTIONS_SQL})"
_KEYS = "tic_id, planet_number, sector"


def _met(body: str) -> str:
    return f"WITH {_TCE}, {_MET}\n{body}"


def _flg(body: str) -> str:
    return f"WITH {_TCE}, {_MET}, {_FLG}\n{body}"


def _long(source: str, columns: dict[str, str], template: str) -> str:
    return "\nUNION ALL ".join(template.format(name=n, expr=e, source=source) for n, e in columns.items())


def _histogram(value: str, bins: int = 30) -> str:
    """Right-closed bins over a CTE of values."""
    return f"""v AS (SELECT {value} AS v FROM met), w AS (SELECT v FROM v WHERE v IS NOT NULL), r AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM w),
c AS (SELECT CAST(greatest(1, least({bins}, ceil((v - lo) / r.w))) AS INT) AS bin, count(*) AS n FROM w, r GROUP BY 1)
SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(1, {bins + 1}) t(b) LEFT JOIN c ON c.bin = b"""


_SUMMARY = ["flag_suspected_eb", "flag_no_convergence", "flag_invalid_odd_even", "flag_background_eb", "flag_centroid_offset", "flag_matching_period", "flag_large_odd_even", "flag_low_snr", "flag_prsa_eb", "flag_kostov_eb", "flag_oddo_eb", "flag_catalog_eb", "passed_tmag_cut", "passed_log_g_cut", "passed_parallax_cut", "passed_ruwe_cut", "has_doyle_params", "in_clean_sample"]
_STATS = ["model_chi_square_reduced", "odd_even_depth_sig", "ghost_diagnostic_ratio", "model_fit_snr", "orbital_period_days", "tess_mag"]
_OWN_RUN = "concat(CAST(sector AS VARCHAR), '-', CAST(sector AS VARCHAR))"


def _rendered(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in columns.items())


def _types(alias: str = "") -> str:
    words = "string_split_regex(otypes, '[ ,]+')"
    each = {t["flag"]: f"list_has_any({words}, [{', '.join(repr(c) for c in t['codes'])}])" if t["enabled"] else "FALSE" for t in TYPES.values()}
    return ", ".join(f"{e} AS {n}" for n, e in each.items()) + ", " + " OR ".join(each.values()) + " AS simbad_is_variable"


_HARMONICS = """ratios AS (SELECT a.tic_id, a.planet_number, a.sector, b.planet_number AS other, b.sector AS other_sector, a.orbital_period_days / nullif(b.orbital_period_days, 0) AS r
  FROM met a JOIN met b ON a.tic_id = b.tic_id AND (a.planet_number <> b.planet_number OR a.sector <> b.sector)),
peers AS (SELECT tic_id, planet_number, sector, count(*) AS n FROM ratios
  WHERE abs(r - 1) < 0.01 OR abs(r - 2) / 2 < 0.01 OR abs(r - 0.5) / 0.5 < 0.01 OR abs(r - 3) / 3 < 0.01 OR abs(r - 1 / CAST(3 AS DOUBLE)) / (1 / CAST(3 AS DOUBLE)) < 0.01 GROUP BY ALL),
har AS (SELECT met.*, CAST(coalesce(n, 0) AS INT) AS n_period_matches, coalesce(n, 0) > 0 AS period_harmonic_match FROM met LEFT JOIN peers USING (tic_id, planet_number, sector))"""
_FAILED = {
    "failed_convergence": "coalesce(NOT full_convergence, FALSE)",
    "failed_centroid": _CENTROID,
    "failed_ghost": "coalesce(ghost_diagnostic_ratio < 1, FALSE)",
    "failed_low_snr": "coalesce(model_fit_snr < 20, FALSE)",
    "failed_suspected_eb": "coalesce(suspected_eclipsing_binary, FALSE)",
    "failed_odd_even": "coalesce(odd_even_depth_sig > 35, FALSE)",
    "failed_period_harmonic": "period_harmonic_match",
    "failed_known_eb": "simbad_is_eb OR tic_id % 97 = 0 OR tic_id % 89 = 0",
    "failed_known_dipper": "tic_id % 101 = 0",
    "failed_simbad_variable": "simbad_is_variable",
    "failed_well_fit": "coalesce(model_chi_square_reduced < 1.1, FALSE)",
}
_SCORE = """CASE WHEN model_chi_square_reduced > 0 THEN log10(model_chi_square_reduced) END AS score_chisq,
  0.3 * CASE WHEN odd_even_depth_sig > 0 THEN log10(odd_even_depth_sig / 35) END AS score_odd_even, 0.5 * CASE WHEN model_fit_snr > 0 THEN log10(model_fit_snr) END AS score_snr"""
_DECISIONS = """dec AS (SELECT user_id AS candidate_id, concat('v', event_id % 2) AS vetter_id, event_id % 3 AS vetting_round,
  CASE event_type WHEN 'click' THEN 'unsure' WHEN 'view' THEN 'planet' WHEN 'purchase' THEN 'background' ELSE event_type END AS classification,
  CASE WHEN event_id % 9 = 0 THEN 'certain' ELSE 'high' END AS confidence, ts AS decided_at, event_id FROM events),
chk AS (SELECT *, CASE WHEN classification NOT IN ('unsure', 'planet', 'background') THEN 'unknown classification' WHEN confidence <> 'high' THEN 'unknown confidence' END AS reason FROM dec),
ok AS (SELECT * FROM chk WHERE reason IS NULL)"""
_PARSED_OK = "tic_id % 50 <> 0 AND tic_id % 77 <> 0"


def oracle_sql() -> dict[str, str]:
    m = "SELECT '{name}' AS metric, CAST(count_if({expr}) AS BIGINT) AS n FROM {source}"
    stat = "SELECT '{name}' AS metric, count({expr}) AS n, median({expr}) AS median, min({expr}) AS low, max({expr}) AS high FROM {source}"
    pct = "SELECT '{name}' AS metric, CAST(count_if({expr}) AS BIGINT) AS n, count_if({expr}) * 100.0 / count(*) AS pct FROM {source}"
    pairs = [(a, b) for a in _RULES for b in _RULES]
    scoped_uid = "CASE WHEN target_id % 5 = 0 THEN concat(CAST(target_id AS VARCHAR), '-', CAST(tce_plnt_num AS VARCHAR), '-S1-S2') ELSE uid END"
    scoped = f"WITH {_TCE}, {_PRED}, p AS (SELECT * REPLACE ({scoped_uid} AS uid), target_id % 5 <> 0 AS own FROM pred),\nmrg AS (SELECT tic_id, planet_number, sector, score, tce_period, {_MEDIAN} AS median_z_score, uid FROM tce LEFT JOIN p ON tic_id = target_id AND planet_number = tce_plnt_num AND own)"
    unscoped = f"WITH {_TCE}, {_PRED}, mrg AS (SELECT tic_id, planet_number, sector, score, tce_period, {_MEDIAN} AS median_z_score, uid FROM tce LEFT JOIN pred ON tic_id = target_id AND planet_number = tce_plnt_num)"
    sample_flags = [c for c in _SUMMARY if c.startswith("flag_")]
    cents = "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)"
    of_files = "count(*) AS files_total, count_if(k % 11 <> 0 AND k % 7 <> 0) AS files_ok, count_if(k % 11 = 0) AS other_root, count_if(k % 11 <> 0 AND k % 7 = 0) AS broken, count_if(k % 11 <> 0 AND k % 7 <> 0 AND k % 3 = 0) AS second"
    grid = "CAST(least(19, floor(({c} - {c}0) / (({c}1 - {c}0) / 20))) AS INT)"
    return {
        "derived_metrics": _met(f"SELECT {_KEYS}, model_chi_square_reduced, odd_even_depth_sig, ghost_diagnostic_ratio, matching_period_signals FROM met"),
        "metrics_absent_columns": f"WITH {_TCE}\nSELECT {_KEYS}, CAST(NULL AS DOUBLE) AS model_chi_square_reduced, CAST(NULL AS DOUBLE) AS odd_even_depth_sig, CAST(NULL AS DOUBLE) AS ghost_diagnostic_ratio, FALSE AS matching_period_signals, "
        + ", ".join(f"{'coalesce(NOT full_convergence, FALSE)' if n == 'flag_no_convergence' else 'FALSE'} AS {n}" for n in _RULES) + " FROM tce",
        "report_tables": f"""{_FULL}, h AS (SELECT min(tess_mag) AS lo, (max(tess_mag) - min(tess_mag)) / 30 AS w FROM sample),
hc AS (SELECT CAST(greatest(1, least(30, ceil((tess_mag - lo) / h.w))) AS INT) AS bin, count(*) AS n FROM sample, h GROUP BY 1)
SELECT 'n_total' AS metric, count(*) AS n FROM sample UNION ALL SELECT 'n_clean', count_if(in_clean_sample) FROM sample UNION ALL SELECT 'n_unflagged_diagnostics', count_if(NOT by_diagnostics) FROM sample
UNION ALL SELECT 'n_unflagged_catalog', count_if(NOT flag_catalog_eb) FROM sample UNION ALL SELECT 'n_survivors', count_if(NOT any_diagnostic_flag) FROM sample UNION ALL SELECT 'entities', count(DISTINCT tic_id) FROM sample
UNION ALL """ + _long("sample", {n: n for n in _SUMMARY} | {"unflagged": "NOT any_diagnostic_flag", "rows": "TRUE"}, m) + "\nUNION ALL SELECT concat('tess_mag ', b), coalesce(n, 0) FROM range(1, 31) t(b) LEFT JOIN hc ON hc.bin = b"
        + "".join(f"\nUNION ALL SELECT 'values of {c}', count({c}) FROM sample" for c in _STATS) + "".join(f"\nUNION ALL SELECT '{a} and {b}', CAST(count_if({a} AND {b}) AS BIGINT) FROM sample" for a in sample_flags for b in sample_flags)
        + "".join(f"\nUNION ALL SELECT 'survivors {n}', CAST(count_if(NOT any_diagnostic_flag{e}) AS BIGINT) FROM sample" for n, e in {"n_total": "", "n_scored": " AND (tic_id + planet_number) % 3 = 0", "n_unscored": " AND (tic_id + planet_number) % 3 <> 0"}.items()),
        "prefixed_columns": "SELECT o_orderkey % 7 AS part, count(*) AS n, max(0.8 + (o_custkey % 20) / CAST(10 AS DOUBLE)) AS most FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1",
        "score_round_trip": f"WITH {_TCE}, {_MET}, {_FLG}, {_PRED}\nSELECT tic_id, {_OWN_RUN} AS sector_run, count(*) AS n_signals, count(score) AS n_scored FROM flg LEFT JOIN pred ON tic_id = target_id AND planet_number = tce_plnt_num AND uid = concat(tic_id, '-', planet_number, '-S', sector) WHERE NOT any_diagnostic_flag GROUP BY 1, 2",
        "control_sample": _flg(f"SELECT {_KEYS}, TRUE AS is_control_sample FROM flg WHERE any_diagnostic_flag ORDER BY md5(concat_ws('-', '42', tic_id, planet_number, sector)), {_KEYS} LIMIT 50"),
        "matching_period": _met("SELECT matching_period_signals, count(*) AS n, count(DISTINCT tic_id) AS n_entities FROM met GROUP BY 1"),
        "diagnostic_flags": _flg(f"SELECT {_KEYS}, {', '.join(_RULES)}, annotation_low_rchisq, any_diagnostic_flag FROM flg"),
        "any_flag": _flg("SELECT any_diagnostic_flag, count(*) AS n FROM flg GROUP BY 1"),
        "survivors": _flg(f"SELECT {_KEYS}, model_fit_snr FROM flg WHERE NOT any_diagnostic_flag"),
        "stellar_cuts": f"{_FULL}\nSELECT {_KEYS}, passed_tmag_cut, passed_log_g_cut, passed_parallax_cut, passed_ruwe_cut, has_valid_stellar_params, in_clean_sample FROM sample",
        "enrich_left_join": f"{_FULL}\nSELECT {_KEYS}, doyle_parallax_over_error, doyle_ruwe, has_doyle_params FROM sample",
        "catalog_flags": f"WITH {_TCE}\nSELECT {_KEYS}, {_CATALOGS} FROM tce",
        "crossmatch_counts": f"WITH {_TCE}, c AS (SELECT {_CATALOGS} FROM tce)\n" + _long("c", {n: n for n in ("flag_prsa_eb", "flag_kostov_eb", "flag_oddo_eb", "flag_catalog_eb", "annotation_kostov_candidate")}, m),
        "dedupe_first": f"WITH {_STELLAR}\nSELECT tic_id, doyle_parallax_over_error, doyle_ruwe FROM stellar",
        "union_sectors": f"WITH {_TCE}\nSELECT sector, count(*) AS n, count(CASE WHEN sector < 60 THEN log_g END) AS n_log_g, count(DISTINCT tic_id) AS n_entities FROM tce GROUP BY sector",
        "union_catalogs": "SELECT o_orderkey AS tic_id, CAST(o_orderkey % 97 = 0 AS BIGINT) + CAST(o_orderkey % 89 = 0 AS BIGINT) AS n_rows FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0",
        "build_sample": f"{_FULL}\nSELECT {_KEYS}, run_type, has_doyle_params, model_chi_square_reduced, flag_catalog_eb, any_diagnostic_flag, passed_parallax_cut, in_clean_sample, 'v1' AS sample_version FROM sample",
        "sample_summary": f"{_FULL}\n" + _long("sample", {n: n for n in _SUMMARY} | {"unflagged": "NOT any_diagnostic_flag", "rows": "TRUE"}, pct) + "\nUNION ALL SELECT 'entities', count(DISTINCT tic_id), count(DISTINCT tic_id) * 100.0 / count(*) FROM sample",
        "run_type_counts": f"WITH {_TCE}\nSELECT CASE WHEN n_difference_images > 1 THEN 'multi_sector' ELSE 'single_sector' END AS run_type, count(*) AS n FROM tce GROUP BY 1",
        "summary_gates": f"{_FULL}\nSELECT count(*) AS n_total, CAST(count_if(in_clean_sample) AS BIGINT) AS n_clean, CAST(count_if(NOT by_diagnostics) AS BIGINT) AS n_unflagged_diagnostics, CAST(count_if(NOT flag_catalog_eb) AS BIGINT) AS n_unflagged_catalog, CAST(count_if(NOT any_diagnostic_flag) AS BIGINT) AS n_survivors FROM sample",
        "histogram": f"WITH {_TCE}, {_MET}, {_histogram('ghost_diagnostic_ratio')}",
        "histogram_log": f"WITH {_TCE}, {_MET}, {_histogram('CASE WHEN model_chi_square_reduced > 0 THEN log10(model_chi_square_reduced) END')}",
        "distribution_stats": _met(_long("met", {n: n for n in _STATS}, stat)),
        "cooccurrence": _flg("\nUNION ALL ".join(f"SELECT '{a}' AS flag_a, '{b}' AS flag_b, CAST(count_if({a} AND {b}) AS BIGINT) AS \"both\", CAST(count_if({a} AND {b}) AS DOUBLE) / greatest(count_if({a}), 1) AS share FROM flg" for a, b in pairs)),
        "sectors_seen": f"WITH {_TCE}\nSELECT string_agg(CAST(sector AS VARCHAR), ',' ORDER BY sector) AS sectors FROM (SELECT DISTINCT sector FROM tce)",
        "density2d": f"WITH {_TCE}, r AS (SELECT min(model_fit_snr) AS x0, max(model_fit_snr) AS x1, min(tess_mag) AS y0, max(tess_mag) AS y1 FROM tce)\nSELECT {grid.format(c='x')} AS xbin, {grid.format(c='y')} AS ybin, count(*) AS n FROM (SELECT model_fit_snr AS x, tess_mag AS y FROM tce), r GROUP BY 1, 2",
        "survivor_table": f"WITH {_TCE}, {_MET}, {_FLG}, {_PRED}\nSELECT {_KEYS}, orbital_period_days, transit_depth_ppm, tess_mag, effective_temp, model_chi_square_reduced, model_fit_snr, score, {_MEDIAN} AS median_z_score, {_url()} AS report_url FROM flg LEFT JOIN pred ON tic_id = target_id AND planet_number = tce_plnt_num WHERE NOT any_diagnostic_flag",
        "sorted_page": f"WITH {_TCE}\nSELECT tic_id, planet_number, tess_mag FROM tce ORDER BY tess_mag DESC NULLS LAST, tic_id, planet_number LIMIT 50 OFFSET 100",
        "worklist": _flg(f"SELECT DISTINCT tic_id, {_OWN_RUN} AS sector_run FROM flg WHERE NOT any_diagnostic_flag"),
        "merge_predictions_scoped": f"{scoped}\nSELECT * FROM mrg",
        "merge_predictions_unscoped": f"{unscoped}\nSELECT * FROM mrg",
        "median_z": f"WITH {_TCE}, {_PRED}\nSELECT uid, {_MEDIAN} AS median_z_score FROM pred",
        "score_coverage": f"{scoped}\nSELECT count(*) AS n_total, count(score) AS n_scored, count(*) - count(score) AS n_unscored FROM mrg",
        "suspect_joins": f"{unscoped}\nSELECT CAST(count_if(score IS NOT NULL AND tce_period IS NULL) AS BIGINT) AS n_suspect FROM mrg",
        "uid_runs": f"""WITH {_TCE}\nSELECT {_KEYS}, CASE tic_id % 4 WHEN 0 THEN concat('S', sector, '-S', sector + 3) WHEN 1 THEN concat('Sx', sector) WHEN 3 THEN concat('S', sector) END AS run_token,
  CASE tic_id % 4 WHEN 0 THEN concat(sector, '-', sector + 3) WHEN 3 THEN concat(sector, '-', sector) END AS run, {_OWN_RUN} AS own_run FROM tce""",
        "bitmask_sectors": "SELECT o_orderkey, CASE WHEN o_custkey % 6 > 1 THEN (SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM range(1, 40) t(i) WHERE (o_custkey >> (i - 1)) & 1 = 1) ELSE NULL END AS sectors FROM orders",
        "report_urls": f"WITH {_TCE}\nSELECT {_KEYS}, {_url()} AS url FROM tce",
        "log10_values": f"WITH {_TCE}\nSELECT {_KEYS}, CASE WHEN odd_even_depth_statistic > 0 THEN log10(odd_even_depth_statistic) END AS log_statistic FROM tce",
        "parse_reports": f"""WITH {_TCE}, t AS (SELECT * EXCLUDE (effective_temp, radius, log_g, transit_depth_ppm, otypes), min(tess_mag) OVER (PARTITION BY tic_id) AS mag FROM tce)
SELECT * EXCLUDE (mag, tess_mag, sector, n_difference_images), mag AS tess_mag, sector, n_difference_images, concat(tic_id, '.xml') AS xml_filename, '101' AS sectors_observed_bitmask, '1,3' AS sectors_observed, concat('M', tic_id % 8, ',M9') AS matched_toi_ids,
  {_rendered(proxy.REPORT_TARGET)}, {_rendered(proxy.REPORT_SIGNAL)}, {', '.join(f'CAST(0.5 AS DOUBLE) AS {n}_err' for n in MODEL_PARAMETERS.values())}
FROM t WHERE {_PARSED_OK} AND (tic_id + planet_number) % 11 <> 0""",
        "reject_counts": f"""WITH {_TCE}\nSELECT 'file' AS level, CASE WHEN tic_id % 50 = 0 THEN 'ParseError' ELSE 'ValueError' END AS error_type, count(DISTINCT tic_id) AS n FROM tce WHERE tic_id % 50 = 0 OR tic_id % 77 = 0 GROUP BY 2
UNION ALL SELECT 'tce', 'ValueError', count(*) FROM tce WHERE {_PARSED_OK} AND (tic_id + planet_number) % 11 = 0 HAVING count(*) > 0""",
        "fixed_width": f"WITH {_STELLAR}\nSELECT tic_id, doyle_parallax_over_error, CASE WHEN tic_id % 4 <> 0 THEN doyle_ruwe END AS doyle_ruwe, CAST(NULL AS BIGINT) AS doyle_gaia_dr3 FROM stellar",
        "catalog_ids": 'SELECT o_orderkey AS "ticId" FROM orders WHERE o_custkey % 4 < 2',
        "period_harmonics": f"WITH {_TCE}, {_MET}, {_HARMONICS}\nSELECT {_KEYS}, period_harmonic_match, n_period_matches FROM har",
        "filter_chain": f"WITH {_TCE}, {_MET}, {_HARMONICS}, typ AS (SELECT *, {_types()} FROM har), f AS (SELECT {_KEYS}, " + ", ".join(f"{e} AS {n}" for n, e in _FAILED.items()) + " FROM typ)\nSELECT *, NOT (" + " OR ".join(_FAILED) + ") AS passes_all_filters FROM f",
        "anomaly_score": _met(f"SELECT *, score_chisq + score_odd_even + score_snr AS anomaly_score FROM (SELECT {_KEYS}, {_SCORE} FROM met)"),
        "type_flags": f"WITH {_TCE}\nSELECT {_KEYS}, {_types()} FROM tce",
        "stale_lookups": "SELECT DISTINCT c_custkey AS tic_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY)",
        "newest_lookups": "SELECT user_id AS tic_id, ts AS queried_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
        "family_flags": f"WITH {_TCE}\nSELECT {_KEYS}, tic_id % 97 = 0 AS in_family_eb, tic_id % 101 = 0 AS in_family_dipper FROM tce",
        "parent_sample": f"""WITH {_TCE}, {_STELLAR}, g AS (SELECT tic_id, array_to_string(list_sort(list(DISTINCT sector)), ',') AS sectors, max(sector) - min(sector) + 1 AS baseline_sectors, min(tess_mag) AS tess_mag, min(effective_temp) AS effective_temp, min(radius) AS radius, min(log_g) AS log_g FROM tce GROUP BY 1),
j AS (SELECT g.*, s.doyle_parallax_over_error, s.doyle_ruwe, s.tic_id IS NOT NULL AS has_doyle_params FROM g LEFT JOIN stellar s USING (tic_id)), k AS (SELECT *, {_CUTS} FROM j)
SELECT tic_id, sectors, baseline_sectors, tess_mag, effective_temp, radius, log_g, has_doyle_params, passed_tmag_cut, passed_log_g_cut, passed_parallax_cut, passed_ruwe_cut, {_CLEAN} FROM k""",
        "top_n": _flg(f"SELECT {_KEYS}, anomaly_score, FALSE AS is_control_sample FROM (SELECT *, score_chisq + score_odd_even + score_snr AS anomaly_score FROM (SELECT *, {_SCORE} FROM flg WHERE NOT any_diagnostic_flag)) ORDER BY anomaly_score DESC NULLS LAST, tic_id, planet_number, sector LIMIT 100"),
        "shared_triples": f"""WITH {_TCE}, s AS (SELECT effective_temp, log_g, radius FROM tce WHERE effective_temp IS NOT NULL AND log_g IS NOT NULL AND radius IS NOT NULL GROUP BY ALL HAVING count(DISTINCT tic_id) >= 3)
SELECT {_KEYS}, s.radius IS NOT NULL AS has_shared_stellar_params FROM tce LEFT JOIN s ON tce.effective_temp = s.effective_temp AND tce.log_g = s.log_g AND tce.radius = s.radius""",
        "sentinel_parameters": f"WITH {_TCE}\nSELECT {_KEYS}, coalesce(abs(log_g - 1) <= 1e-6, FALSE) AND coalesce(abs(radius - 0.5) <= 5e-7, FALSE) AS has_sentinel_stellar_params FROM tce",
        "deep_eclipse": f"WITH {_TCE}\nSELECT {_KEYS}, coalesce(transit_depth_ppm > 100000, FALSE) AS flag_deep_eclipse FROM tce",
        "decision_rejects": f"WITH {_DECISIONS}\nSELECT reason, count(*) AS n FROM chk WHERE reason IS NOT NULL GROUP BY 1",
        "agreement": f"""WITH {_DECISIONS}, l AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY candidate_id, vetter_id ORDER BY vetting_round DESC, decided_at DESC, classification) = 1)
SELECT a.vetter_id AS vetter_a, b.vetter_id AS vetter_b, count(*) AS n, CAST(count_if(a.classification = b.classification) AS BIGINT) AS agreed, CAST(count_if(a.classification = b.classification) AS DOUBLE) / count(*) AS share,
  CAST(count_if(a.classification = b.classification) AS DOUBLE) / count(*) > 0.8 AS reaches_target FROM l a JOIN l b ON a.candidate_id = b.candidate_id AND a.vetter_id < b.vetter_id GROUP BY 1, 2""",
        "revet_queue": f"""WITH {_DECISIONS}, l AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY vetting_round DESC, decided_at DESC, classification) = 1),
r AS (SELECT candidate_id, count(DISTINCT vetting_round) AS rounds, count(DISTINCT CASE WHEN classification = 'unsure' THEN vetting_round END) AS unsure_rounds FROM ok GROUP BY 1)
SELECT l.candidate_id, classification, rounds, unsure_rounds, CASE WHEN unsure_rounds >= 2 THEN 'escalate' ELSE 'revet' END AS action FROM l JOIN r USING (candidate_id) WHERE classification = 'unsure'""",
        "decisions_for": f"WITH {_DECISIONS}\nSELECT candidate_id, vetter_id, vetting_round, classification, event_id FROM ok WHERE candidate_id = 7",
        "confusion": f"""WITH {_DECISIONS}, l AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY candidate_id, vetter_id ORDER BY vetting_round DESC, decided_at DESC, classification) = 1)
SELECT a.classification AS class_a, count_if(b.classification = 'unsure')::BIGINT AS unsure, count_if(b.classification = 'planet')::BIGINT AS planet, count_if(b.classification = 'background')::BIGINT AS background
FROM l a JOIN l b ON a.candidate_id = b.candidate_id AND a.vetter_id < b.vetter_id GROUP BY 1""",
        "sample_sink": f"{_FULL}\nSELECT sector, 'v1' AS sample_version, count(*) AS n, CAST(count_if(any_diagnostic_flag) AS BIGINT) AS n_flagged, CAST(14 AS DOUBLE) AS tmag_max, CAST(3.5 AS DOUBLE) AS log_g_min FROM sample GROUP BY sector",
        "report_files": f"WITH f AS (SELECT {of_files} FROM (SELECT s_suppkey AS k FROM supplier))\nSELECT metric, CAST(n AS BIGINT) AS n FROM (SELECT 'files_total' AS metric, files_total AS n FROM f UNION ALL SELECT 'files_ok', files_ok FROM f UNION ALL SELECT 'files_failed', files_total - files_ok FROM f UNION ALL SELECT 'rows', files_ok + second FROM f UNION ALL "
        + " UNION ALL ".join(f"SELECT '{m}', {n} FROM f WHERE {n} > 0" for m, n in {"sector 5 by v1": "files_ok", "sector 7 by v1": "second", "file ParseError": "broken", "file ValueError": "other_root", "tce ValueError": "files_ok"}.items()) + ")",
        "worklist_sink": _flg(f"SELECT DISTINCT tic_id, {_OWN_RUN} AS sector_run FROM flg WHERE NOT any_diagnostic_flag"),
        "predictions_with_comments": f"WITH {_TCE}, {_PRED}\nSELECT uid, target_id, tce_plnt_num, CASE WHEN target_id % 2 = 0 THEN 'a # b, c' ELSE 'plain' END AS note, score FROM pred",
        "skipped_files": f"SELECT 'rows' AS what, count(*) AS n, {cents} AS total FROM orders UNION ALL SELECT 'not a Parquet file', count(*), NULL FROM supplier UNION ALL SELECT 'missing', 1, NULL",
        "stream_replay": f"SELECT o_orderkey % 2 AS batch, count(*) AS n, {cents} AS total, 1 + o_orderkey % 2 AS n_attempts, count(*) AS n_recorded, 'v1' AS version FROM orders GROUP BY o_orderkey % 2",
        "entity_sketches": f"WITH {_TCE}\nSELECT sector % 2 AS half, count(*) AS n_rows, count(DISTINCT tic_id) AS exact, TRUE AS near FROM tce GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT tic_id), TRUE FROM tce",
        "cached_lookups": "SELECT user_id AS tic_id, ts AS queried_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
        "bucketed_enrich": f"{_FULL}\nSELECT {_KEYS}, doyle_parallax_over_error, doyle_ruwe, has_doyle_params FROM sample",
        "keyset_page": f"WITH {_TCE}\nSELECT tic_id, planet_number, log_g FROM tce ORDER BY log_g DESC NULLS LAST, tic_id, planet_number LIMIT 40 OFFSET 120",
        "unique_keys": f"WITH {_TCE}\nSELECT sector, count(*) AS n FROM tce GROUP BY 1",
        "found_id_column": 'SELECT o_orderkey AS "ticId" FROM orders WHERE o_orderkey % 5 <> 0',
        "stored_catalog": f"WITH {_STELLAR}\nSELECT tic_id, doyle_parallax_over_error, CASE WHEN tic_id % 4 <> 0 THEN doyle_ruwe END AS doyle_ruwe, CAST(NULL AS BIGINT) AS doyle_gaia_dr3 FROM stellar",
        "absent_catalogs": f"WITH {_TCE}\n" + _long("tce", {"flag_prsa_eb": "FALSE", "flag_kostov_eb": "FALSE", "flag_oddo_eb": "tic_id % 101 = 0", "flag_catalog_eb": "tic_id % 101 = 0", "annotation_kostov_candidate": "FALSE"}, m),
        "read_folder": "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1",
        "machine_readable": """SELECT o_orderkey AS tic_id, o_custkey / CAST(4 AS DOUBLE) AS "Per", left(o_orderstatus, 1) AS "Flag" FROM orders WHERE o_orderkey % 10 <> 0""",
        "new_files": """WITH l AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM orders WHERE o_custkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, status) = 1)
SELECT concat('f', o_orderkey) AS path FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l WHERE status = 'done')""",
        "phase_fold": f"""WITH {_TCE}, j AS (SELECT tic_id, planet_number, value, (CAST(event_id % 1000 AS DOUBLE) - CAST(0.5 AS DOUBLE)) AS dt, orbital_period_days AS p FROM tce JOIN events ON user_id = tic_id WHERE orbital_period_days > 0)
SELECT tic_id, planet_number, CAST(least(19, floor((dt / p - floor(dt / p)) * 20)) AS INT) AS phase_bin, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS stddev FROM j GROUP BY 1, 2, 3""",
        "summary_records": _flg(f"SELECT {_KEYS}, model_fit_snr AS snr, CASE WHEN any_diagnostic_flag THEN 'true' ELSE 'false' END AS flagged FROM flg WHERE NOT any_diagnostic_flag"),
    }


def _url() -> str:
    digits = "lpad(CAST(tic_id AS VARCHAR), 16, '0')"
    run = "concat('s', lpad(CAST(sector AS VARCHAR), 4, '0'))"
    path = ", '/', ".join(f"substr({digits}, {i}, 4)" for i in (1, 5, 9, 13))
    return f"concat('https://mast.stsci.edu/api/v0.1/Download/file/?uri=mast:HLSP/tess-spoc/', {run}, '/target/', {path}, '/hlsp_tess-spoc_tess_phot_', {digits}, '-', {run}, '-', {run}, '_tess_v1_dvm.pdf')"
