"""Choosing, ordering and showing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import report_url, sector_run
from ..functions.nulls import true
from .flags import survivors
from .joins import attach_scores

#: The columns a survivor is shown with, where they exist.
SURVIVOR_COLUMNS = ["tic_id", "planet_number", "sector", "orbital_period_days", "transit_depth_ppm", "tess_mag", "effective_temp", "model_chi_square_reduced", "model_fit_snr", "toi_id"]


def survivor_table(df: DataFrame, scores: DataFrame | None = None, score_order: list[Column] | None = None) -> DataFrame:
    """Unflagged rows with display columns, scores, annotation and report address; by score, unscored last."""
    rows = survivors(df)
    extra = [c for c in ("annotation_kostov_candidate",) if c in df.columns]
    shown = [c for c in SURVIVOR_COLUMNS if c in df.columns]
    scored: list[str] = []
    if scores is not None and {"tic_id", "planet_number"} <= set(scores.columns):
        scored = [c for c in ("score", "median_z_score", "EB_score") if c in scores.columns]
        rows = attach_scores(rows, scores, score_order or [F.col(c).asc_nulls_last() for c in scored] or [F.lit(1)])
    if {"tic_id", "sector"} <= set(df.columns):
        rows = rows.withColumn("report_url", report_url(F.col("tic_id"), F.col("sector")))
        extra.append("report_url")
    out = rows.select(*shown, *scored, *extra)
    keys = [F.col(c) for c in ("tic_id", "planet_number", "sector") if c in shown]
    return out.orderBy(F.col("score").asc_nulls_last(), *keys) if "score" in scored else out.orderBy(*keys)


def sorted_page(df: DataFrame, by: str, *, descending: bool = False, size: int | None = None, offset: int = 0, ties: tuple[str, ...] = ("tic_id", "planet_number")) -> DataFrame:
    """Rows in the order of a column, missing values last, ties by key; optionally one page."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    out = df.orderBy(first, *[F.col(t) for t in ties if t != by])
    return out if size is None else out.offset(offset).limit(size)


def page_after(df: DataFrame, by: str, last: tuple | None = None, *, descending: bool = False, size: int = 50, ties: tuple[str, ...] = ("tic_id", "planet_number")) -> DataFrame:
    """The page that follows a row given by its (value of `by`, *ties), or the first; the order of `sorted_page`.

    Rows up to the cursor are filtered away before anything is sorted, and of the rest each task keeps `size`
    rows: a deep page costs no more than the first, where an offset sorts all rows before it. The ties must make
    rows unique and not be null, or rows equal to the cursor are left out.
    """
    ties = tuple(t for t in ties if t != by)
    out = df
    if last is not None:
        value, *rest = last
        beyond = F.lit(False)
        for i in reversed(range(len(ties))):  # by the first tie, then the second where the first is equal
            beyond = (F.col(ties[i]) > F.lit(rest[i])) | ((F.col(ties[i]) == F.lit(rest[i])) & beyond)
        if value is None:
            out = df.filter(F.col(by).isNull() & beyond)
        else:
            further = F.col(by) < F.lit(value) if descending else F.col(by) > F.lit(value)
            out = df.filter(further | ((F.col(by) == F.lit(value)) & beyond) | F.col(by).isNull())
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return out.orderBy(first, *[F.col(t) for t in ties]).limit(size)


def cursor_of(page: DataFrame, by: str, ties: tuple[str, ...] = ("tic_id", "planet_number")) -> tuple | None:
    """What `page_after` needs to go on after a page: its last row; None after an empty page."""
    rows = page.select(by, *[t for t in ties if t != by]).collect()
    return tuple(rows[-1]) if rows else None


def work_list(rows: DataFrame, sector_col: str = "sector") -> DataFrame:
    """Distinct (tic_id, sector_run): what an external scorer has to look at."""
    for c in ("tic_id", sector_col):
        if c not in rows.columns:
            raise KeyError(f"{c} is missing")
    return rows.select("tic_id", sector_run(F.col(sector_col)).alias("sector_run")).distinct()


def select_candidates(df: DataFrame, top_n: int | None = None, *, passes: str = "passes_all_filters", score: str = "anomaly_score", keys: tuple[str, ...] = ("tic_id", "planet_number", "sector"), control: int = 0, seed: int = 42) -> DataFrame:
    """Passing rows, the top_n by score or all, and optionally a control sample of failed rows, tagged is_control_sample."""
    good = df.filter(true(F.col(passes)))
    if top_n is not None:
        good = good.orderBy(F.col(score).desc_nulls_last(), *keys).limit(top_n)
    good = good.withColumn("is_control_sample", F.lit(False))
    return good.unionByName(control_sample(df, control, passes=passes, keys=keys, seed=seed)) if control else good


def control_sample(df: DataFrame, size: int = 50, *, passes: str = "passes_all_filters", keys: tuple[str, ...] = ("tic_id", "planet_number", "sector"), seed: int = 42) -> DataFrame:
    """A reproducible sample of failed rows: the smallest MD5 of seed and key (null: empty), whatever the layout of the data."""
    failed = df.filter(~true(F.col(passes)))
    drawn = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return failed.orderBy(drawn, *keys).limit(size).withColumn("is_control_sample", F.lit(True))
