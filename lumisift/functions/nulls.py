"""One contract for missing values: NaN becomes null on the way in, and a missing value never raises a flag.

Spark sorts and compares NaN above every number and raises on a division by zero; both would turn
missing data into evidence, so every operator goes through these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float or double column with NaN turned into null."""
    floats = [c for c, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def true(cond: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(cond, F.lit(False))


def present(value: Column) -> Column:
    """Not null and not NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def to_double(text: Column) -> Column:
    """A number from text; empty, unparseable and NaN are null."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def to_long(text: Column) -> Column:
    """An integer from text; whole decimals count, everything else is null."""
    value = F.nullif(text, F.lit(""))
    number = value.try_cast("double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.try_cast("long"))
    return F.coalesce(value.try_cast("long"), whole)


def to_bool(text: Column) -> Column:
    """`true` in any case is true, other text false, missing or empty null."""
    return F.when(F.nullif(text, F.lit("")).isNotNull(), F.trim(text).rlike(r"^(?i:true)\z"))


def over(value: Column, by: Column) -> Column:
    """A quotient; null where either is missing or the divisor is zero."""
    return F.try_divide(value, by)


def root(value: Column) -> Column:
    """A square root; null below zero."""
    return F.when(value >= 0, F.sqrt(value))


def log10_positive(value: Column) -> Column:
    """log10 of positive values; null for others."""
    return F.when(value > 0, F.log10(value))
