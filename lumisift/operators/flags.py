"""Boolean columns: suspicions (flag_*, failed_*), passes (passed_*, has_*, in_*) and annotations. Rows are never dropped.

Missing data never raises a flag and never passes a cut.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_ghost_diagnostic_ratio, add_odd_even_depth_sig, add_reduced_chi_square
from ..functions.nulls import log10_positive, true
from .windows import add_matching_period_signals

#: Thresholds where the configuration names none.
DEFAULT_THRESHOLDS: dict[str, Any] = {
    "ghost_ratio_min": 1.0,
    "centroid_offset_max_sigma": 3.0,
    "odd_even_sig_max": 35.0,
    "snr_min": 10.0,
    "reduced_chisq_min": 1.1,
    "odd_even_invalid_sentinel": -1,
}
#: The flags that take part in selection; catalog flags are appended by the build.
DIAGNOSTIC_FLAGS = [
    "flag_suspected_eb",
    "flag_no_convergence",
    "flag_invalid_odd_even",
    "flag_background_eb",
    "flag_centroid_offset",
    "flag_matching_period",
    "flag_large_odd_even",
    "flag_low_snr",
]
CATALOG_FLAG = "flag_catalog_eb"


def _all(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def add_derived_metrics(df: DataFrame, period_match_tol_days: float = 0.01, partition_keys: tuple[str, ...] = ("tic_id",), periods: DataFrame | None = None) -> DataFrame:
    """Reduced chi square, odd/even significance, core to halo ratio, and matching periods (found in `periods` where that is cheaper to read than df)."""
    df = df.transform(add_reduced_chi_square).transform(add_odd_even_depth_sig).transform(add_ghost_diagnostic_ratio)
    return add_matching_period_signals(df, period_match_tol_days, partition_keys=partition_keys, periods=periods)


def add_diagnostic_flags(df: DataFrame, thresholds: dict[str, Any] | None = None) -> DataFrame:
    """All diagnostic flags as non-null booleans in one projection; a flag whose inputs are absent is False."""
    t = DEFAULT_THRESHOLDS | (thresholds or {})

    def flag(needs: list[str], condition: Column) -> Column:
        return true(condition) if set(needs) <= set(df.columns) else F.lit(False)

    c = F.col
    target, control, most = c("ms_tic_centroid_offset_sigma"), c("ms_control_centroid_offset_sigma"), t["centroid_offset_max_sigma"]
    # Off target: some offset is known and none is small.
    off = (target.isNotNull() | control.isNotNull()) & ~(true(target < most) | true(control < most))
    rules = {
        "flag_suspected_eb": (["suspected_eclipsing_binary"], c("suspected_eclipsing_binary")),
        "flag_no_convergence": (["full_convergence"], ~c("full_convergence")),
        "flag_invalid_odd_even": (["odd_even_depth_significance"], c("odd_even_depth_significance") == t["odd_even_invalid_sentinel"]),
        "flag_background_eb": (["ghost_diagnostic_ratio"], c("ghost_diagnostic_ratio") < t["ghost_ratio_min"]),
        "flag_centroid_offset": (["ms_tic_centroid_offset_sigma", "ms_control_centroid_offset_sigma"], off),
        "flag_matching_period": (["matching_period_signals"], c("matching_period_signals")),
        "flag_large_odd_even": (["odd_even_depth_sig"], c("odd_even_depth_sig") > t["odd_even_sig_max"]),
        "flag_low_snr": (["model_fit_snr"], c("model_fit_snr") < t["snr_min"]),
        "annotation_low_rchisq": (["model_chi_square_reduced"], c("model_chi_square_reduced") < t["reduced_chisq_min"]),
    }
    return df.withColumns({name: flag(needs, condition) for name, (needs, condition) in rules.items()})


def add_any_flag(df: DataFrame, flags: list[str] | None = None, out: str = "any_diagnostic_flag") -> DataFrame:
    """OR of the flags present; False if none is."""
    return df.withColumn(out, _any([true(F.col(f)) for f in flags or DIAGNOSTIC_FLAGS if f in df.columns]))


def survivors(df: DataFrame, flag: str = "any_diagnostic_flag") -> DataFrame:
    """Rows without the flag; no rows where the column is absent."""
    return df.filter(~true(F.col(flag))) if flag in df.columns else df.limit(0)


def apply_cuts(df: DataFrame, config: dict[str, Any], prefix: str = "doyle_") -> DataFrame:
    """Selection cuts as booleans, and in_clean_sample. A cut without its column or threshold is null."""
    cuts, have = config.get("stellar_cuts", {}), set(df.columns)

    def cut(column: str, bounds: list[str], condition: Any) -> Column:
        limits = [cuts.get(b) for b in bounds]
        if column not in have or None in limits:
            return F.lit(None).cast("boolean")
        return true(condition(F.col(column), *limits))

    out = df.withColumns({
        "passed_tmag_cut": cut("tess_mag", ["tmag_min", "tmag_max"], lambda v, low, high: v.between(low, high)),
        "passed_log_g_cut": cut("log_g", ["log_g_min"], lambda v, low: v >= low),
        "passed_parallax_cut": cut(f"{prefix}parallax_over_error", ["parallax_over_error_min"], lambda v, low: v >= low),
        "passed_ruwe_cut": cut(f"{prefix}ruwe", ["ruwe_max_for_clean"], lambda v, high: v < high),
    })
    valid = [F.col(c).isNotNull() for c in config.get("require_valid", []) if c in have]
    out = out.withColumn("has_valid_stellar_params", _all(valid) if valid else F.lit(None).cast("boolean"))
    required = [true(F.col(c)) for c in config.get("required_for_clean", []) if c in out.columns]
    return out.withColumn("in_clean_sample", _all(required) if required else F.lit(False))


def apply_filters(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The eleven failed_* columns of the filter chain, and passes_all_filters. Absent inputs fail nothing."""
    quality, false_positive = config.get("data_quality", {}), config.get("false_positive", {})
    catalogs, have = config.get("catalog_filters", {}), set(df.columns)

    def fails(needs: list[str], condition: Any, enabled: Any = True) -> Column:
        return true(condition(*[F.col(n) for n in needs])) if enabled and set(needs) <= have else F.lit(False)

    centroid = quality.get("centroid_offset_sigma_max")
    known = lambda family: [F.col(f"in_{name}") for name, (kind, on) in _families(catalogs).items() if kind == family and on and f"in_{name}" in have]
    eb = known("eb") + [F.col(n) for n in ("flag_catalog_eb", "simbad_is_eb") if n in have]
    out = {
        "failed_convergence": fails(["full_convergence"], lambda v: ~v, quality.get("require_convergence")),
        "failed_centroid": fails(["ms_tic_centroid_offset_sigma", "ms_control_centroid_offset_sigma"], lambda a, b: (a.isNotNull() | b.isNotNull()) & ~(true(a < centroid) | true(b < centroid)), centroid is not None),
        "failed_ghost": fails(["ghost_diagnostic_ratio"], lambda v: v < quality["ghost_ratio_min"], "ghost_ratio_min" in quality),
        "failed_low_snr": fails(["model_fit_snr"], lambda v: v < quality["model_fit_snr_min"], "model_fit_snr_min" in quality),
        "failed_suspected_eb": fails(["suspected_eclipsing_binary"], lambda v: v, false_positive.get("treat_suspected_eb_as_failed")),
        "failed_odd_even": fails(["odd_even_depth_sig"], lambda v: v > false_positive["odd_even_significance_max"], "odd_even_significance_max" in false_positive),
        "failed_period_harmonic": fails(["period_harmonic_match"], lambda v: v, false_positive.get("fail_period_harmonics")),
        "failed_known_eb": _any([true(c) for c in eb]),
        "failed_known_dipper": _any([true(c) for c in known("dipper")]),
        "failed_simbad_variable": fails(["simbad_is_variable"], lambda v: v, config.get("simbad_filter", {}).get("enabled")),
        "failed_well_fit": fails(["model_chi_square_reduced"], lambda v: v < config["anomaly"]["reduced_chisq_min"], "reduced_chisq_min" in config.get("anomaly", {})),
    }
    return df.withColumns(out).withColumn("passes_all_filters", ~_any([F.col(c) for c in out]))


def _families(catalogs: dict[str, bool]) -> dict[str, tuple[str, bool]]:
    """Catalog switches by family: names with `_eb` hold binaries, with `dipper` or `cpv` dippers, others are informational."""
    kind = lambda name: "eb" if "_eb" in name else "dipper" if "dipper" in name or "cpv" in name else "information"
    return {name: (kind(name), on) for name, on in catalogs.items()}


def add_anomaly_score(df: DataFrame, weights: dict[str, float] | None = None, odd_even_threshold: float = 35.0) -> DataFrame:
    """Weighted sum of log10 metrics and its components, on all rows; null where a component is missing."""
    w = {"chisq": 1.0, "odd_even": 0.3, "snr": 0.5} | (weights or {})
    parts = {
        "score_chisq": w["chisq"] * log10_positive(F.col("model_chi_square_reduced")),
        "score_odd_even": w["odd_even"] * log10_positive(F.col("odd_even_depth_sig") / odd_even_threshold),
        "score_snr": w["snr"] * log10_positive(F.col("model_fit_snr")),
    }
    return df.withColumns(parts).withColumn("anomaly_score", F.col("score_chisq") + F.col("score_odd_even") + F.col("score_snr"))


def derive_type_flags(df: DataFrame, types: dict[str, dict], types_col: str = "otypes", prefix: str = "simbad_is_") -> DataFrame:
    """A flag per enabled category of object types, and `<prefix>variable` for any; missing types raise none.

    types: {category: {"enabled": bool, "codes": [...], "flag": optional name of the flag}}.
    """
    codes = F.split(F.col(types_col), "[ ,]+")
    found = {c.get("flag") or f"{prefix}{name}": true(F.arrays_overlap(codes, F.array(*[F.lit(x) for x in c["codes"]]))) if c.get("enabled") and c["codes"] else F.lit(False) for name, c in types.items()}
    return df.withColumns(found | {f"{prefix}variable": _any(list(found.values()))})


def flag_sentinel_parameters(df: DataFrame, sentinel: dict[str, float] | None = None, rtol: float = 1e-6, out: str = "has_sentinel_stellar_params") -> DataFrame:
    """Rows whose stellar parameters are the known filler values (all of them, within a relative tolerance)."""
    # The filler triple.
    triple = sentinel or {"effective_temp": 31000.0, "log_g": 5.59962, "radius": 0.18}
    return df.withColumn(out, _all([true(F.abs(F.col(c) - v) <= rtol * abs(v)) for c, v in triple.items()]))


def flag_shared_parameters(df: DataFrame, columns: list[str], least: int = 3, entity: str = "tic_id", out: str = "has_shared_stellar_params") -> DataFrame:
    """Rows whose parameter tuple stands on at least `least` distinct entities (the general form of a filler value)."""
    known = _all([F.col(c).isNotNull() for c in columns])
    shared = df.filter(known).groupBy(*[F.col(c).alias(f"_s_{c}") for c in columns]).agg(F.countDistinct(entity).alias("_n")).filter(F.col("_n") >= least)
    same = _all([F.col(c) == F.col(f"_s_{c}") for c in columns])
    return df.join(shared, same, "left").withColumn(out, F.col("_n").isNotNull()).drop("_n", *[f"_s_{c}" for c in columns])


def flag_deep_eclipse(df: DataFrame, depth_ppm: float, depth_col: str = "transit_depth_ppm", out: str = "flag_deep_eclipse") -> DataFrame:
    return df.withColumn(out, true(F.col(depth_col) > depth_ppm))
