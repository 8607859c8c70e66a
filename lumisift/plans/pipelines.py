"""User-facing compositions; each is one lazy plan."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.exprs import classify_run_type, sector_run, with_provenance
from ..functions.nulls import nan_to_null
from ..operators.aggs import cooccurrence, distribution_stats, histogram, long_form, sample_summary, score_coverage, summary_gates
from ..operators.flags import CATALOG_FLAG, DIAGNOSTIC_FLAGS, add_any_flag, add_derived_metrics, add_diagnostic_flags, apply_cuts, apply_filters, survivors
from ..operators.joins import add_catalog_flags, add_filter_catalogs, enrich, merge_predictions
from ..operators.select import survivor_table
from ..operators.sets import union_sectors
from ..operators.windows import flag_period_harmonics
from ..sources.tables import with_thresholds, write_work_list


def build_sample(parts: list[DataFrame], config: dict[str, Any], *, stellar: DataFrame | None = None, stellar_order: list | None = None, **catalogs: DataFrame | None) -> DataFrame:
    """Parsed sectors to the annotated sample: run type, catalog values, metrics, flags, cuts, provenance, thresholds.

    Matching periods are found in the parts, before anything is joined to them. Catalog flags of single sources and annotations don't gate.
    """
    diagnostics = config.get("diagnostics", {})
    raw = nan_to_null(union_sectors(parts))
    df = enrich(raw.transform(classify_run_type), stellar, stellar_order)
    df = add_derived_metrics(df, diagnostics.get("period_match_tol_days", 0.01), periods=raw)
    df = add_diagnostic_flags(df, diagnostics)
    df = add_catalog_flags(df, **catalogs)
    df = add_any_flag(df, [*DIAGNOSTIC_FLAGS, CATALOG_FLAG])
    df = apply_cuts(df, config)
    return with_thresholds(with_provenance(df, config.get("version", "unknown"), __version__), config)


#: The metrics that the report draws, and whether on a log axis.
REPORT_METRICS = {"model_chi_square_reduced": True, "odd_even_depth_sig": True, "ghost_diagnostic_ratio": False, "model_fit_snr": True, "orbital_period_days": True, "tess_mag": False}


def report(df: DataFrame, scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a sample report: gates, counts, histograms, statistics, co-occurrence, survivors, coverage."""
    flags = [c for c in df.columns if c.startswith("flag_")]
    metrics = {m: log for m, log in REPORT_METRICS.items() if m in df.columns}
    out = {"gates": summary_gates(df), "summary": sample_summary(df), "cooccurrence": cooccurrence(df, flags), "statistics": distribution_stats(df, list(metrics)), "survivors": survivor_table(df, scores)}
    out |= {f"histogram_{m}": histogram(df, m, log_x=log) for m, log in metrics.items()}
    if scores is not None:
        out["coverage"] = score_coverage(out["survivors"])
    return out


def build_parent_sample(observed: DataFrame, config: dict[str, Any], stellar: DataFrame | None = None, *, entity: str = "tic_id", sector: str = "sector", marker: str = "has_doyle_params") -> DataFrame:
    """One row per entity: sectors, span of sectors, stellar parameters (smallest known value), catalog values, cuts."""
    have = [c for c in ("tess_mag", "effective_temp", "radius", "log_g") if c in observed.columns]
    grouped = observed.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.sort_array(F.collect_set(sector)).alias("sectors"), (F.max(sector) - F.min(sector) + 1).alias("baseline_sectors"), *[F.min(c).alias(c) for c in have])
    return apply_cuts(enrich(grouped, stellar, key=entity, marker=marker), config)


def filter_chain(df: DataFrame, config: dict[str, Any], catalogs: dict[str, DataFrame | None], *, harmonics: bool = False) -> DataFrame:
    """The filter chain with its catalogs: in_<catalog> columns, then failed_* and passes_all_filters by the configuration's switches.

    harmonics=True flags period harmonics too, after the catalogs: these join by id, and rows that lie by id already need not be shuffled for them.
    """
    out = add_filter_catalogs(df, catalogs)
    return apply_filters(flag_period_harmonics(out, periods=df) if harmonics else out, config)


def score_round_trip(sample: DataFrame, scores: DataFrame, path: str | None = None, **how: Any) -> DataFrame:
    """The work list of a sample's survivors, written to `path` if given, with how many of its signals have come back scored.

    (tic_id, sector_run, n_signals, n_scored): a run without scores is still out.
    """
    kept = survivors(sample)
    write_work_list(kept, path)
    merged = merge_predictions(kept, scores, **how)
    return merged.groupBy("tic_id", sector_run(F.col("sector")).alias("sector_run")).agg(F.count(F.lit(1)).alias("n_signals"), F.count("score").alias("n_scored"))


def write_summary_records(df: DataFrame, path: str, keys: tuple[str, ...] = ("tic_id", "planet_number", "sector"), by: str = "sector") -> None:
    """Append summary records as Parquet by sector; keys that the folder holds already are skipped."""
    spark, records = df.sparkSession, summary_records(df, keys)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        records = records.join(spark.read.schema(records.schema).parquet(path).select(*keys), list(keys), "left_anti")
    records.write.mode("append").partitionBy(by).parquet(path)


def phase_fold(series: DataFrame, candidates: DataFrame, bins: int = 100, *, entity: str = "tic_id", time: str = "t", value: str = "value", period: str = "orbital_period_days", epoch: str = "epoch") -> DataFrame:
    """(candidate keys, phase_bin, n, mean, stddev): all sectors of a series folded at each candidate's period and stacked."""
    keys = [c for c in candidates.columns if c not in (period, epoch)]
    usable = candidates.filter(F.col(period) > 0)
    # Cycles since the epoch less the whole ones: a time on a whole cycle stays in the first bin despite rounding.
    cycles = (F.col(time) - F.coalesce(F.col(epoch), F.lit(0.0))) / F.col(period)
    at = F.least(F.lit(bins - 1), F.floor((cycles - F.floor(cycles)) * bins)).cast("int")
    folded = series.select(entity, time, value).join(usable, entity).filter(F.col(time).isNotNull() & F.col(value).isNotNull())
    return folded.groupBy(*keys, at.alias("phase_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))


def summary_records(df: DataFrame, keys: tuple[str, ...] = ("tic_id", "planet_number", "sector")) -> DataFrame:
    """(keys, record): all columns of a queued candidate as JSON."""
    return df.select(*keys, F.to_json(F.struct("*")).alias("record"))


__all__ = ["build_sample", "report", "build_parent_sample", "filter_chain", "score_round_trip", "write_summary_records", "phase_fold", "summary_records", "long_form"]
