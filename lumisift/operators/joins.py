"""Joins of detections with reference catalogs and external scores. All rows of the left side stay, once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import add_median_z_score, normalize_run, run_of_uid, sector_run
from ..functions.nulls import true
from .windows import keep_first


def enrich(df: DataFrame, catalog: DataFrame | None, order: list[Column] | None = None, *, key: str = "tic_id", marker: str = "has_doyle_params") -> DataFrame:
    """Left join of a catalog by id, its first row per id in an explicit order, and whether there was one.

    No catalog: only the marker, False. The catalog may be large, so how it joins is left to the planner.
    """
    if catalog is None:
        return df.withColumn(marker, F.lit(False))
    right = keep_first(catalog.filter(F.col(key).isNotNull()), [key], order or [F.col(c).asc_nulls_last() for c in catalog.columns if c != key] or [F.lit(1)])
    return df.join(right.withColumn("_hit", F.lit(True)), key, "left").withColumn(marker, true(F.col("_hit"))).drop("_hit")


#: The catalogs by flag; the first three are vetted, the last only annotates.
VETTED = {"prsa": "flag_prsa_eb", "kostov_vetted": "flag_kostov_eb", "oddo": "flag_oddo_eb"}
ANNOTATED = {"kostov_unvetted": "annotation_kostov_candidate"}


def membership(df: DataFrame, catalogs: dict[str, DataFrame | None], flags: dict[str, str], key: str = "tic_id") -> DataFrame:
    """One flag per catalog: whether the row's id is in it. All catalogs are united and joined once."""
    if key not in df.columns:
        raise KeyError(f"{key} is missing")
    given = [c.select(F.col("tic_id").alias("_id"), F.lit(name).alias("_source")) for name, c in catalogs.items() if c is not None and name in flags]
    if not given:
        return df.withColumns({f: F.lit(False) for f in flags.values()})
    held = reduce(DataFrame.unionByName, given).filter(F.col("_id").isNotNull())
    sets = held.groupBy("_id").agg(*[F.bool_or(F.col("_source") == name).alias(f"_in_{name}") for name in flags])
    out = df.join(sets, F.col(key) == F.col("_id"), "left")
    return out.withColumns({flag: true(F.col(f"_in_{name}")) for name, flag in flags.items()}).drop("_id", *[f"_in_{n}" for n in flags])


def add_catalog_flags(df: DataFrame, **catalogs: DataFrame | None) -> DataFrame:
    """Flags per vetted catalog, their OR as flag_catalog_eb, and the unvetted annotation."""
    out = membership(df, catalogs, VETTED | ANNOTATED)
    return out.withColumn("flag_catalog_eb", reduce(Column.__or__, [F.col(f) for f in VETTED.values()]))


def add_family_flags(df: DataFrame, catalogs: dict[str, tuple[str, DataFrame, bool]], families: tuple[str, ...] = ("eb", "dipper"), key: str = "tic_id") -> DataFrame:
    """in_family_<family>: the id is in any switched-on catalog of the family. catalogs: {name: (family, ids, enabled)}."""
    on = [ids.select(F.col("tic_id").alias("_id"), F.lit(family).alias("_family")) for family, ids, enabled in catalogs.values() if enabled]
    if not on:
        return df.withColumns({f"in_family_{f}": F.lit(False) for f in families})
    sets = reduce(DataFrame.unionByName, on).filter(F.col("_id").isNotNull()).groupBy("_id").agg(*[F.bool_or(F.col("_family") == f).alias(f"_f_{f}") for f in families])
    out = df.join(sets, F.col(key) == F.col("_id"), "left")
    return out.withColumns({f"in_family_{f}": true(F.col(f"_f_{f}")) for f in families}).drop("_id", *[f"_f_{f}" for f in families])


def add_filter_catalogs(df: DataFrame, catalogs: dict[str, DataFrame | None], key: str = "tic_id") -> DataFrame:
    """in_<catalog> for each catalog of the filter configuration, which the filter chain reads by its switches; in none where a catalog is missing."""
    return membership(df, catalogs, {name: f"in_{name}" for name in catalogs}, key)


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The same rows; running it raises if a key occurs twice. The check is a filter, so no pruning removes it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_n", n)
    return checked.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what}: key ({', '.join(keys)}) is not unique")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def merge_predictions(sample: DataFrame, predictions: DataFrame, *, scope_by_run: bool = True, run_col: str | None = None, check: bool = True, partitions: int | None = None) -> DataFrame:
    """Left join of external scores on (id, number) and, if scoped, the run; adds median_z_score.

    Columns that both sides have stay the sample's. A key that occurs twice on either side raises. The
    sample's run is its sector, or run_col where given; a score's run is read from its uid. Missing runs match nothing.
    Both sides meet in `partitions` partitions where given, else in the session's number, whatever their rows.
    """
    for c in ("tic_id", "planet_number", *(["sector"] if scope_by_run and run_col is None else [])):
        if c not in sample.columns:
            raise KeyError(f"the sample has no column {c}")
    for c in ("target_id", "tce_plnt_num", *(["uid"] if scope_by_run else [])):
        if c not in predictions.columns:
            raise KeyError(f"the predictions have no column {c}")
    drop = {"target_id", "tce_plnt_num"} | set(sample.columns)
    keys = {"_t": F.col("target_id").cast("long"), "_p": F.col("tce_plnt_num").cast("long")}
    own = {"_t0": F.col("tic_id").cast("long"), "_p0": F.col("planet_number").cast("long")}
    if scope_by_run:
        keys["_r"] = normalize_run(run_of_uid(F.col("uid")))
        own["_r0"] = F.col(run_col) if run_col else sector_run(F.col("sector"))
    left, right = sample.withColumns(own), predictions.withColumns(keys).select(*keys, *[f"`{c}`" for c in predictions.columns if c not in drop])
    if partitions:
        left, right = left.repartition(partitions, *own), right.repartition(partitions, *keys)
    if check:
        left, right = require_unique(left, list(own), "sample"), require_unique(right, list(keys), "predictions")
    on = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(own, keys, strict=True)])
    return add_median_z_score(left.join(right, on, "left").drop(*own, *keys))


def count_suspect_joins(merged: DataFrame, score: str = "score", period: str = "tce_period") -> DataFrame:
    """One row: how many scored rows lack the score table's own period."""
    return merged.agg(F.count_if(F.col(score).isNotNull() & F.col(period).isNull()).alias("n_suspect"))


def attach_scores(rows: DataFrame, scores: DataFrame, order: list[Column], columns: tuple[str, ...] = ("score", "median_z_score", "EB_score")) -> DataFrame:
    """Left join of the score columns present, the first per (id, number); they replace columns of those names."""
    have = [c for c in columns if c in scores.columns]
    right = keep_first(scores, ["tic_id", "planet_number"], order).select("tic_id", "planet_number", *have)
    return rows.drop(*have).join(right, ["tic_id", "planet_number"], "left")
