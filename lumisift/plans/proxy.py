"""Detection-shaped tables derived from the star-schema test tables.

The column expressions are plain SQL that Spark and other engines read alike; the queries use them as
DataFrame expressions, the oracles as text. The source tables hold no nulls and no unique line key, so
the expressions inject nulls and number the lines of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TCE = {
    "tic_id": "l_orderkey",
    "planet_number": "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT)",
    "sector": "CAST(36 + l_partkey % 45 AS INT)",
    "n_difference_images": "CAST(CASE WHEN l_suppkey % 10 = 0 THEN 3 ELSE 1 END AS INT)",
    "orbital_period_days": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity + l_discount END",
    "model_chi_square": "l_extendedprice",
    "model_degrees_of_freedom": "CASE WHEN l_linenumber = 6 THEN CAST(0 AS DOUBLE) ELSE l_quantity * 1000 END",
    "odd_even_depth_statistic": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE c_acctbal END",
    "odd_even_depth_significance": "CASE WHEN o_orderpriority = '5-LOW' THEN CAST(-1 AS DOUBLE) ELSE l_discount END",
    "ghost_core_correlation": "l_discount",
    "ghost_halo_correlation": "l_tax",
    "ms_tic_centroid_offset_sigma": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_discount * 60 END",
    "ms_control_centroid_offset_sigma": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_tax * 75 END",
    "model_fit_snr": "l_quantity",
    "full_convergence": "CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE ELSE NULL END",
    "suspected_eclipsing_binary": "CASE WHEN l_linestatus = 'F' THEN l_suppkey % 3 = 0 ELSE NULL END",
    "tess_mag": "o_totalprice / 25000",
    "effective_temp": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE p_retailprice * 6 END",
    "radius": "p_size / CAST(20 AS DOUBLE)",
    "log_g": "CASE WHEN l_suppkey % 20 = 1 THEN NULL ELSE p_size / CAST(10 AS DOUBLE) END",
    "transit_depth_ppm": "l_extendedprice * 4",
    "otypes": "concat(p_type, ' ', p_brand)",
}
TCE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TCE.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"
#: Catalog rows: two thirds of the orders, some ids twice with other values (copy 1 must lose).
STELLAR_SQL = """SELECT o_orderkey AS tic_id, 0 AS copy, o_totalprice / 10000 AS doyle_parallax_over_error, 0.8 + (o_custkey % 20) / CAST(10 AS DOUBLE) AS doyle_ruwe FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 1, o_totalprice / 5000, CAST(9 AS DOUBLE) FROM orders WHERE o_orderkey % 30 = 1"""
#: Id catalogs by the remainder of the order key.
ID_CATALOGS = {"prsa": (97, 0), "kostov_vetted": (89, 0), "oddo": (101, 0), "kostov_unvetted": (3, 1)}
PREDICTION_COLUMNS = {
    "uid": "concat(CAST(tic_id AS STRING), '-', CAST(planet_number AS STRING), '-S', CAST(sector AS STRING))",
    "target_id": "tic_id",
    "tce_plnt_num": "planet_number",
    "tce_period": "orbital_period_days",
    "z_shape_0": "ghost_halo_correlation",
    "z_shape_1": "CASE WHEN tic_id % 7 = 0 THEN NULL ELSE ghost_core_correlation END",
    "z_shape_2": "model_fit_snr",
    "score": "ghost_core_correlation",
}
PREDICTIONS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PREDICTION_COLUMNS.items()).replace("STRING", "VARCHAR") + " FROM tce WHERE (tic_id + planet_number) % 3 = 0"
#: Fixed values of the sample configuration that the queries use.
CONFIG = {
    "version": "v1",
    "stellar_cuts": {"tmag_min": 6.0, "tmag_max": 14.0, "log_g_min": 3.5, "parallax_over_error_min": 5.0, "ruwe_max_for_clean": 1.4},
    "require_valid": ["effective_temp", "radius", "log_g", "tess_mag"],
    "required_for_clean": ["passed_tmag_cut", "passed_log_g_cut", "passed_parallax_cut", "passed_ruwe_cut", "has_valid_stellar_params"],
    "diagnostics": {"period_match_tol_days": 0.01, "ghost_ratio_min": 1.0, "centroid_offset_max_sigma": 3.0, "odd_even_sig_max": 35.0, "snr_min": 10.0, "reduced_chisq_min": 1.1, "odd_even_invalid_sentinel": -1},
}

_OF_TARGET = "(tic_id % {0}) / CAST(8 AS DOUBLE)"
_OF_SIGNAL = "((tic_id + planet_number) % {0}) / CAST(8 AS DOUBLE)"
#: What reports hold beside the columns of TCE, by the column that parsing gives; eighths are the same in decimal and binary.
REPORT_TARGET = {
    "toi_id": "CASE WHEN tic_id % 4 = 0 THEN NULL ELSE concat('T', CAST(tic_id % 90 AS STRING)) END",
    "planet_candidate_count": "tic_id % 5",
    "start_cadence": "tic_id % 1000",
    "end_cadence": "tic_id % 1000 + 500",
    "pipeline_task_id": "CASE WHEN tic_id % 13 = 0 THEN NULL ELSE tic_id * 3 END",
    **{name: _OF_TARGET.format(2880 - 7 * i) for i, name in enumerate(("ra_deg", "dec_deg", "pm_ra", "pm_dec", "radius", "log_g", "log_metallicity", "stellar_density"))},
    "effective_temp": "CASE WHEN tic_id % 9 = 0 THEN NULL ELSE CAST(3000 + tic_id % 4000 AS DOUBLE) END",
    "limb_darkening_model": "CASE WHEN tic_id % 6 = 0 THEN NULL ELSE 'quadratic' END",
    **{f"limb_darkening_c{i}": _OF_TARGET.format(16 + i) for i in range(1, 5)},
}
REPORT_SIGNAL = {
    "tce_toi_id": "CASE WHEN planet_number = 1 THEN concat('T', CAST(tic_id % 90 AS STRING), '.01') END",
    "toi_correlation": _OF_SIGNAL.format(9),
    "detrend_filter_length": "(tic_id + planet_number) % 31",
    **{name: _OF_SIGNAL.format(100 + 3 * i) for i, name in enumerate((
        "max_single_event_sigma", "max_multiple_event_sigma", "robust_statistic", "model_chi_square_2", "model_chi_square_dof_2", "model_chi_square_gof", "model_chi_square_gof_dof",
        "weak_secondary_mes_mad", "weak_secondary_robust_statistic", "transit_epoch_btjd", "min_impact_parameter", "ratio_planet_radius_to_star_radius", "ratio_semi_major_axis_to_star_radius",
        "transit_duration_hours", "transit_depth_ppm", "bootstrap_significance", "ghost_core_correlation_significance", "ghost_halo_correlation_significance"))},
    "transit_model_name": "CASE WHEN tic_id % 10 = 0 THEN NULL ELSE 'limb' END",
}


#: Rows that a task sorts, joins or writes where a query deals them out itself.
ROWS_OF_A_TASK = 100_000
#: Rows that it takes at most, so that its memory has a bound at any size of the input.
MOST_ROWS_OF_A_TASK = 250_000
#: Rows of a table above which a join with it deals out both sides here; the planner broadcasts smaller ones.
ROWS_TO_BROADCAST = 2_000_000


def partitions(rows: int) -> int:
    return max(1, -(-rows // ROWS_OF_A_TASK))


def shuffled(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle: by the rows, but no more than a task writes straight through unless one would take more rows than a task may."""
    straight = max(1, int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")))
    return max(min(partitions(rows), straight), -(-rows // MOST_ROWS_OF_A_TASK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that the lines of a folder are dealt in (counted from footers)."""
    return shuffled(spark, table(spark, sf_dir, "lineitem").count())


def met(spark: SparkSession, rows: DataFrame, by: str, others: DataFrame, key: str) -> DataFrame:
    """Rows with the other row each names; where these are too many to broadcast, partitions follow the rows, not the session's number."""
    if others.count() > ROWS_TO_BROADCAST:
        # Of few columns the planner would still broadcast all rows, as it goes by estimated bytes.
        rows, others = rows.repartition(shuffled(spark, rows.count()), by), others.hint("merge")
    return rows.join(others, F.expr(f"{by} = {key}"))


def tce(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))
    # Orders meet customers, and lines their parts, before lines meet orders: wide rows are shuffled by order once, and
    # numbered where they are. The number of partitions follows the lines (counted from footers) as far as they are written
    # straight through: with more, the tasks that read hold and sort what they send, a split each. Beyond that a task's rows
    # have a bound, and so has the split.
    placed = met(spark, orders, "o_custkey", customers, "c_custkey")
    dealt = met(spark, lines, "l_partkey", parts, "p_partkey").repartition(shuffled(spark, lines.count()), "l_orderkey")
    joined = dealt.join(placed, F.expr("l_orderkey = o_orderkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in TCE.items()])


def stellar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS tic_id", "0 AS copy", "o_totalprice / 10000 AS doyle_parallax_over_error", "0.8D + (o_custkey % 20) / CAST(10 AS DOUBLE) AS doyle_ruwe")
    again = orders.filter("o_orderkey % 30 = 1").selectExpr("o_orderkey AS tic_id", "1 AS copy", "o_totalprice / 5000 AS doyle_parallax_over_error", "CAST(9 AS DOUBLE) AS doyle_ruwe")
    return first.unionByName(again)


def id_catalogs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return {name: orders.filter(f"o_orderkey % {by} = {rest}").select(F.col("o_orderkey").alias("tic_id")) for name, (by, rest) in ID_CATALOGS.items()}


def predictions(rows: DataFrame) -> DataFrame:
    return rows.filter("(tic_id + planet_number) % 3 = 0").selectExpr(*[f"{e} AS {n}" for n, e in PREDICTION_COLUMNS.items()])
