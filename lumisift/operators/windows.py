"""Operators over the rows of one entity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import true


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in an explicit order (there is no file order to rely on)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def matching_entities(df: DataFrame, tol_days: float = 0.01, *, period_col: str = "orbital_period_days", partition_keys: tuple[str, ...] = ("tic_id",)) -> DataFrame:
    """The keys, once each, of entities that have two periods less than tol_days apart.

    Periods fall into bands one and a half tolerances wide, so three in a band always hold a match, two
    are compared, and otherwise only the last of a band and the first of the next can match. Each period is
    sent to its own band and, as a predecessor, to the next: counts, ends and predecessors of a band are one
    aggregation, summed per task before the one shuffle. An entity of any number of rows is spread over its
    bands and no task sorts or holds its rows. Missing keys and missing or infinite periods match nothing.
    """
    p, width = F.col("_p"), 1.5 * tol_days
    inside = reduce(Column.__and__, [F.col(k).isNotNull() for k in partition_keys])
    rows = df.filter(inside).select(*partition_keys, F.col(period_col).cast("double").alias("_p")).filter(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")))
    # Where doubles lie further apart than a band is wide, a value is a band of its own and precedes none.
    fine = F.abs(p) < width * 2.0**52
    band = F.when(fine, F.floor(p / width).cast("double")).otherwise(p)
    own, before = F.struct(band.alias("band"), p.alias("p"), F.lit(None).cast("double").alias("before")), F.struct((band + 1).alias("band"), F.lit(None).cast("double").alias("p"), p.alias("before"))
    bands = rows.select(*partition_keys, F.explode(F.when(fine, F.array(own, before)).otherwise(F.array(own))).alias("x")).groupBy(*partition_keys, F.col("x.band").alias("_band")).agg(
        F.count("x.p").alias("_n"), F.min("x.p").alias("_low"), F.max("x.p").alias("_high"), F.max("x.before").alias("_before"))
    # With one value in a band, its ends are the same value.
    match = (F.col("_n") > 2) | ((F.col("_n") == 2) & (F.col("_high") - F.col("_low") < tol_days)) | (F.col("_low") - F.col("_before") < tol_days)
    return bands.filter(true(match)).select(*partition_keys).distinct()


def add_matching_period_signals(df: DataFrame, tol_days: float = 0.01, *, period_col: str = "orbital_period_days", partition_keys: tuple[str, ...] = ("tic_id",), out: str = "matching_period_signals", periods: DataFrame | None = None) -> DataFrame:
    """True on all rows of an entity that has two periods less than tol_days apart.

    The entities are found from keys and periods alone and joined back, so a hot entity's rows are never
    brought together. Where df is dear to compute, `periods` names a cheaper table of the same keys and
    periods, such as the one df was joined from. A missing key is nobody's entity: False. An absent column: False.
    """
    if not {period_col, *partition_keys} <= set(df.columns):
        return df.withColumn(out, F.lit(False))
    named = [f"_match_{k}" for k in partition_keys]
    found = matching_entities(df if periods is None else periods, tol_days, period_col=period_col, partition_keys=partition_keys).withColumnsRenamed(dict(zip(partition_keys, named, strict=True)))
    same = reduce(Column.__and__, [F.col(k) == F.col(n) for k, n in zip(partition_keys, named, strict=True)])
    return df.join(found, same, "left").withColumn(out, F.col(named[0]).isNotNull()).drop(*named)


#: The period ratios that count as related.
HARMONICS = (1.0, 2.0, 0.5, 3.0, 1.0 / 3.0)


def flag_period_harmonics(df: DataFrame, tolerance: float = 0.01, targets: tuple[float, ...] = HARMONICS, *, keys: tuple[str, ...] = ("tic_id", "planet_number", "sector"), entity: str = "tic_id", period_col: str = "orbital_period_days", periods: DataFrame | None = None) -> DataFrame:
    """Add period_harmonic_match and n_period_matches: an entity's other rows whose period ratio is within the tolerance of a target.

    Distinct periods of an entity meet through bands of the logarithm a few tolerances wide, so an
    entity with very many rows is spread over its bands, only near ratios are compared, and equal
    periods are one row with a count. A period is sent to the one or two bands per target that what
    matches it can lie in. Rows with a missing or non-positive period match nothing. `periods` names a
    cheaper table of the same entities and periods, such as the one df was joined from.
    """
    # Logarithms of matches lie within half of `near_by` of the target's; the rest is room for rounding.
    near_by = -2 * math.log1p(-tolerance)
    width, reach = 4 * near_by, 0.625 * near_by
    periods = (df if periods is None else periods).filter(F.col(entity).isNotNull() & (F.col(period_col) > 0)).groupBy(F.col(entity).alias("_e"), F.col(period_col).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    right = periods.select(F.col("_e").alias("_f"), F.col("_p").alias("_q"), F.col("_n").alias("_m"), F.floor(F.log("_p") / width).alias("_band"))
    bands = [F.floor((F.log("_p") - math.log(t) + side) / width) for t in targets for side in (-reach, reach)]
    left = periods.select("_e", "_p", F.explode(F.array_distinct(F.array(*bands))).alias("_b"))
    ratio = F.col("_p") / F.col("_q")
    near = F.lit(False)
    for t in targets:
        near = near | (F.abs(ratio - t) / t < tolerance)
    met = left.join(right, (F.col("_e") == F.col("_f")) & (F.col("_b") == F.col("_band"))).filter(near)
    self_match = any(abs(1.0 - t) / t < tolerance for t in targets)
    peers = met.groupBy("_e", "_p").agg(F.sum("_m").alias("_peers"))
    out = df.join(peers, (F.col(entity) == F.col("_e")) & (F.col(period_col) == F.col("_p")), "left")
    count = F.coalesce(F.col("_peers") - (1 if self_match else 0), F.lit(0)).cast("int")
    return out.withColumns({"n_period_matches": count, "period_harmonic_match": count > 0}).drop("_e", "_p", "_peers")
