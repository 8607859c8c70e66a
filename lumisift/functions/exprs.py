"""Column expressions of detection tables. All stay inside generated code; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import over, present, root, to_long


def decode_bitmask(mask: Column, first_is: str = "right") -> Column:
    """1-based positions of the ones, counted from the right (or the left); null, empty or other text gives []."""
    clean = F.trim(mask)
    bits = F.reverse(clean) if first_is == "right" else clean
    places = F.sequence(F.lit(1), F.length(clean))
    hit = F.filter(places, lambda i: F.substring(bits, i, F.lit(1)) == "1")
    return F.when(clean.rlike("^[01]+$"), hit).otherwise(F.array().cast("array<int>"))


def run_type(images: Column) -> Column:
    return F.when(images > 1, F.lit("multi_sector")).otherwise(F.lit("single_sector"))


def classify_run_type(df: DataFrame, images_col: str = "n_difference_images") -> DataFrame:
    """Add run_type; a missing count or column is a single sector."""
    return df.withColumn("run_type", run_type(F.col(images_col)) if images_col in df.columns else F.lit("single_sector"))


def _metric(df: DataFrame, out: str, how: Callable[..., Column], *needs: str) -> DataFrame:
    """Add how(columns); null where a column is absent."""
    given = set(needs) <= set(df.columns)
    return df.withColumn(out, how(*[F.col(n) for n in needs]) if given else F.lit(None).cast("double"))


def add_reduced_chi_square(df: DataFrame) -> DataFrame:
    return _metric(df, "model_chi_square_reduced", over, "model_chi_square", "model_degrees_of_freedom")


def add_odd_even_depth_sig(df: DataFrame) -> DataFrame:
    return _metric(df, "odd_even_depth_sig", root, "odd_even_depth_statistic")


def add_ghost_diagnostic_ratio(df: DataFrame) -> DataFrame:
    return _metric(df, "ghost_diagnostic_ratio", over, "ghost_core_correlation", "ghost_halo_correlation")


def sector_run(sector: Column) -> Column:
    """55 -> '55-55'."""
    whole = sector.cast("int")
    return F.when(whole.isNotNull(), F.concat_ws("-", whole, whole))


def run_of_uid(uid: Column) -> Column:
    """The run of '<target>-<n>-S47' or '<target>-<n>-S36-S69'; null if there is none."""
    parts = F.split(uid, "-")
    runs = F.filter(parts, lambda p, i: (i >= 2) & p.startswith("S"))
    return F.when(F.size(runs) > 0, F.array_join(runs, "-"))


def normalize_run(run: Column) -> Column:
    """'S47' -> '47-47', 'S36-S69' -> '36-69'; null if any part is not a number."""
    parts = F.transform(F.split(run, "-"), lambda p: F.regexp_replace(p, "^S", ""))
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int").cast("string")
    return F.when(F.forall(parts, lambda p: p.rlike("^[0-9]+$")), F.concat_ws("-", number(1), number(-1)))


def row_median(columns: list[Column]) -> Column:
    """Median of a row's values, missing ones left out; null without any."""
    kept = F.array_sort(F.filter(F.array(*[c.cast("double") for c in columns]), lambda v: present(v)))
    n = F.size(kept)
    return F.when(n > 0, (F.element_at(kept, F.floor((n + 1) / 2).cast("int")) + F.element_at(kept, F.floor(n / 2).cast("int") + 1)) / 2)


def add_median_z_score(df: DataFrame, prefix: str = "z_shape_", out: str = "median_z_score") -> DataFrame:
    """Add the row-wise median of the columns of a prefix; null where there is no such column."""
    found = sorted(c for c in df.columns if c.startswith(prefix))
    return df.withColumn(out, row_median([F.col(f"`{c}`") for c in found]) if found else F.lit(None).cast("double"))


def report_url(entity: Column, sector: Column) -> Column:
    """Address of a target's report: the id in 16 digits, cut in fours, and the sector in four; null if either is no integer.

    Fixed values: the archive's public address pattern.
    """
    digits = F.lpad(to_long(entity.cast("string")).cast("string"), 16, "0")
    run = F.concat(F.lit("s"), F.lpad(to_long(sector.cast("string")).cast("string"), 4, "0"))
    path = F.concat_ws("/", *[F.substring(digits, i, 4) for i in (1, 5, 9, 13)])
    return F.concat(
        F.lit("https://mast.stsci.edu/api/v0.1/Download/file/?uri=mast:HLSP/tess-spoc/"), run, F.lit("/target/"), path,
        F.lit("/hlsp_tess-spoc_tess_phot_"), digits, F.lit("-"), run, F.lit("-"), run, F.lit("_tess_v1_dvm.pdf"))


def find_id_column(names: list[str], wanted: str = "tic") -> str | None:
    """A column whose name is the wanted one apart from case and punctuation, else the first that contains it."""
    plain = {n: "".join(ch for ch in n.lower() if ch.isalnum()) for n in names}
    exact = [n for n in names if plain[n] in (wanted, f"{wanted}id")]
    return next(iter(exact or [n for n in names if wanted in plain[n]]), None)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Prefix all columns but some."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def with_provenance(df: DataFrame, version: str, package_version: str) -> DataFrame:
    """Version of the configuration and package, and the time of the build."""
    return df.withColumns({"sample_version": F.lit(version), "built_with_package_version": F.lit(package_version), "built_at": F.current_timestamp()})
