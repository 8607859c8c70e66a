"""Reports: every count of a table in one pass."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import log10_positive, true


def long_form(row: DataFrame, names: list[str], key: str = "metric", value: str = "n") -> DataFrame:
    """One row of counts as (metric, n)."""
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"`{n}`").cast("long").alias(value)) for n in names])
    return row.select(F.explode(pairs).alias("x")).select(f"x.{key}", f"x.{value}")


def bool_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n): true values per column, missing ones not counted."""
    return long_form(df.agg(*[F.count_if(F.col(c)).alias(c) for c in columns]), columns)


def sample_summary(df: DataFrame, entity: str = "tic_id", marker: str = "has_doyle_params", approximate: bool = False) -> DataFrame:
    """(metric, n, pct): rows, entities, catalog matches, clean rows, every passed_* and flag_* column, unflagged rows.

    approximate=True estimates the entities by a sketch (0.7 % standard error) and shuffles none of them.
    """
    flags = [c for c in df.columns if c.startswith(("passed_", "flag_"))]
    counts: dict[str, Column] = {"rows": F.count(F.lit(1)), "entities": F.hll_sketch_estimate(F.hll_sketch_agg(entity, 14)) if approximate else F.countDistinct(entity)}
    counts |= {c: F.count_if(F.col(c)) for c in (marker, "in_clean_sample", *flags) if c in df.columns}
    if "any_diagnostic_flag" in df.columns:
        counts["unflagged"] = F.count(F.lit(1)) - F.count_if(F.col("any_diagnostic_flag"))
    row = df.agg(*[v.alias(k) for k, v in counts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("n"), F.try_divide(F.col(k) * 100.0, F.col("rows")).alias("pct")) for k in counts])
    return row.select(F.explode(pairs).alias("x")).select("x.metric", "x.n", "x.pct")


def entity_sketches(df: DataFrame, by: str = "sector", entity: str = "tic_id", lg_k: int = 14) -> DataFrame:
    """(by, sketch, n_rows): a mergeable sketch of the distinct entities of each part, to be stored beside the part.

    A sketch takes at most 2^lg_k bytes, however many entities it has seen, so that a new part adds one row.
    """
    return df.groupBy(by).agg(F.hll_sketch_agg(entity, lg_k).alias("sketch"), F.count(F.lit(1)).alias("n_rows"))


def entities_of_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_entities, n_rows) from stored sketches: distinct entities over all parts (or by the columns given), rows of old parts not read again.

    The count is an estimate; at lg_k 14 its standard error is 0.7 %. `sample_summary` counts exactly.
    """
    return sketches.groupBy(*(by or [])).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n_entities"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def run_type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("run_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run_type")


def summary_gates(df: DataFrame) -> DataFrame:
    """One row: total, clean, unflagged by diagnostics, unflagged by catalogs, survivors."""
    from .flags import CATALOG_FLAG, DIAGNOSTIC_FLAGS

    some = lambda names: reduce(Column.__or__, [true(F.col(c)) for c in names if c in df.columns], F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        (F.count_if(F.col("in_clean_sample")) if "in_clean_sample" in df.columns else F.lit(0).cast("long")).alias("n_clean"),
        F.count_if(~some(DIAGNOSTIC_FLAGS)).alias("n_unflagged_diagnostics"),
        F.count_if(~some([CATALOG_FLAG])).alias("n_unflagged_catalog"),
        F.count_if(~some(["any_diagnostic_flag"])).alias("n_survivors"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30, log_x: bool = False) -> DataFrame:
    """(bin, low, high, n): equal-width bins closed on the right, empty ones included, the lowest edge widened by 0.1 % of the range.

    Two passes over one column: its range (one scalar subquery, bound once as a struct), then its counts,
    which carry the range along. One value only: both edges move by 0.1 % of it. No values: no rows.
    """
    value = F.col(column).cast("double")
    value = log10_positive(value) if log_x else value
    v = df.select(F.when(~F.isnan(value), value).alias("v")).filter("v is not null")
    lo, hi = F.col("lo"), F.col("hi")
    room = F.when(lo < hi, 0.0).when(lo == 0, 0.001).otherwise(0.001 * F.abs(lo))
    first = F.when(lo < hi, lo - 0.001 * (hi - lo)).otherwise(lo - room)
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.struct((lo - room).alias("low"), first.alias("first"), ((hi + room - (lo - room)) / bins).alias("width")).alias("r"))
    low, first, width = (F.col(f"r.{c}") for c in ("low", "first", "width"))
    guess = F.ceil((F.col("v") - low) / width)
    # The quotient may round across an edge; the edges themselves decide.
    exact = F.when(F.col("v") <= low + (guess - 1) * width, guess - 1).when(F.col("v") > low + guess * width, guess + 1).otherwise(guess)
    at = F.greatest(F.lit(1), F.least(F.lit(bins), exact)).cast("int")
    counts = v.withColumn("r", ends.scalar()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("r").alias("r"))
    # At most `bins` rows: they become one, and one row per bin again.
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.first("r").alias("r")).filter(F.col("r").isNotNull())
    every = whole.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "m", "r")
    left = F.when(F.col("bin") == 1, first).otherwise(low + (F.col("bin") - 1) * width)
    return every.select("bin", left.alias("low"), (low + F.col("bin") * width).alias("high"), F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("long").alias("n"))


#: Values of a column that may meet in the one task which settles its median.
MEDIAN_VALUES = 100_000


def _at_rank(rank: int, below: int, c: dict) -> str:
    """Where a rank lies: at the first quantile, between the two, at the second, or outside."""
    for place in ("first", "between", "second"):
        if below <= rank < below + c[place]:
            return place
        below += c[place]
    return "outside"


def median_ranges(df: DataFrame, value: dict[str, Column], *, accuracy: int = 10_000, most: int = MEDIAN_VALUES) -> dict[str, dict]:
    """Per column n, low, high and either the middle values m0, m1, or an open range a..b that holds both, with `inside` values in it and `below` up to a.

    A range of more than `most` values is narrowed: two quantiles close around the middle ranks are found
    among its values (a sketch of bounded size), and the values below, at and between them are counted
    exactly. A middle rank at a quantile is settled; else the open range between the two goes on. Each round
    leaves about 20 / accuracy of the values, whatever their distribution, so `inside` does not grow with n.
    Quantiles that miss the middle are widened. The driver sees one row a pass.
    """
    first = [F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, [0.5 - 10 / accuracy, 0.5 + 10 / accuracy], accuracy).alias("near")).alias(c) for c, v in value.items()]
    row = df.agg(*first).first()
    found = {c: {"n": row[c]["n"], "low": row[c]["low"], "high": row[c]["high"], "a": None, "b": None, "below": 0, "inside": row[c]["n"]} for c in value}
    near, slack = {c: row[c]["near"] for c in value}, dict.fromkeys(value, 10 / accuracy)
    while wide := [c for c, r in found.items() if "m0" not in r and r["inside"] > most]:
        held = {c: value[c] if found[c]["a"] is None else F.when((value[c] > found[c]["a"]) & (value[c] < found[c]["b"]), value[c]) for c in wide}
        if asked := [c for c in wide if near[c] is None]:
            shares = {c: [min(1.0, max(0.0, (k - found[c]["below"]) / found[c]["inside"] + s)) for k, s in (((found[c]["n"] - 1) // 2, -slack[c]), (found[c]["n"] // 2 + 1, slack[c]))] for c in asked}
            got = df.agg(*[F.percentile_approx(held[c], shares[c], accuracy).alias(c) for c in asked]).first()
            near |= {c: got[c] for c in asked}
        tally = lambda c: F.struct(
            F.count_if(held[c] < near[c][0]).alias("under"), F.count_if(held[c] == near[c][0]).alias("first"), F.count_if((held[c] > near[c][0]) & (held[c] < near[c][1])).alias("between"),
            F.count_if((held[c] == near[c][1]) & (near[c][1] > near[c][0])).alias("second"), F.min(F.when(held[c] > near[c][0], held[c])).alias("after"), F.max(F.when(held[c] < near[c][1], held[c])).alias("before")).alias(c)
        counts = df.agg(*[tally(c) for c in wide]).first()
        for c in wide:
            r, got, (q0, q1) = found[c], counts[c].asDict(), near[c]
            base = r["below"] + got["under"]
            lower, upper = (_at_rank(k, base, got) for k in ((r["n"] - 1) // 2, r["n"] // 2))
            near[c] = None
            if "outside" in (lower, upper):
                slack[c] *= 4
            elif lower == upper == "between":
                found[c] = r | {"a": q0, "b": q1, "below": base + got["first"], "inside": got["between"]}
            else:  # ranks are neighbours, so a change of place between them names the neighbouring value
                found[c] = r | {"m0": q0 if lower == "first" else q1 if lower == "second" else got["before"], "m1": q1 if upper == "second" else q0 if upper == "first" else got["after"]}
    return found


def distribution_stats(df: DataFrame, columns: list[str], approximate: bool = False, accuracy: int = 10_000, most: int = MEDIAN_VALUES) -> DataFrame:
    """(metric, n, median, low, high) per column, on raw values; no values: n is 0, the rest null.

    Medians are exact: a range around the middle is narrowed until it holds at most `most` values, then
    only these meet in a task. Ranges are found while the query is built: one pass, and from there one or two
    passes for every thousandfold of `most`; each computes df anew, so store columns that are dear to compute
    (`sources.scratch.stored`). approximate=True gives the nearest of 10 * accuracy quantiles, in one lazy pass.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    if approximate:
        stats = [F.struct(F.lit(c).alias("metric"), F.count(v).alias("n"), F.percentile_approx(v, 0.5, 10 * accuracy).alias("median"), F.min(v).alias("low"), F.max(v).alias("high")) for c, v in value.items()]
        return df.agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    found = median_ranges(df, value, accuracy=accuracy, most=most)
    known = [(c, r["n"], r["below"], r["low"], r["high"], r["m0"] * 0.5 + r["m1"] * 0.5 if "m0" in r else None) for c, r in found.items()]
    ends = df.sparkSession.createDataFrame(known, "metric string, n long, below long, low double, high double, settled double")
    inside = lambda c, v: v if found[c]["a"] is None else F.when((v > found[c]["a"]) & (v < found[c]["b"]), v)
    held = [F.struct(F.lit(c).alias("of"), inside(c, v).alias("v")) for c, v in value.items() if found[c]["n"] and "m0" not in found[c]]
    if not held:
        return ends.select("metric", "n", F.col("settled").alias("median"), "low", "high")
    counts = df.select(F.explode(F.array(*held)).alias("x")).select("x.*").filter("v is not null").groupBy("of", "v").agg(F.count(F.lit(1)).alias("rows"))
    upto = counts.withColumn("upto", F.sum("rows").over(Window.partitionBy("of").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    # One row per column to broadcast.
    placed = upto.join(F.broadcast(ends.select("metric", "n", "below")), F.col("of") == F.col("metric")).withColumn("upto", F.col("upto") + F.col("below"))
    middle = [F.min(F.when(F.col("upto") > rank, F.col("v"))) for rank in (F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))]
    medians = placed.groupBy("of").agg((middle[0] * 0.5 + middle[1] * 0.5).alias("found"))
    return ends.join(F.broadcast(medians), F.col("metric") == F.col("of"), "left").select("metric", "n", F.coalesce("settled", "found").alias("median"), "low", "high")


def cooccurrence(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag_a, flag_b, both, share): rows with both flags, and that over the rows with the first; one pass for all pairs."""
    pairs = list(combinations_with_replacement(flags, 2))
    row = df.agg(*[F.count_if(true(F.col(a)) & true(F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    mirrored = pairs + [(b, a) for a, b in pairs if a != b]
    at = lambda a, b: F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`")
    cells = F.array(*[F.struct(F.lit(a).alias("flag_a"), F.lit(b).alias("flag_b"), at(a, b).alias("both"), (at(a, b) / F.greatest(at(a, a), F.lit(1))).alias("share")) for a, b in mirrored])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def sectors_seen(df: DataFrame, sector: str = "sector") -> DataFrame:
    """One row: the sorted distinct sectors."""
    return df.agg(F.sort_array(F.collect_set(sector)).alias("sectors"))


def density2d(df: DataFrame, x: str, y: str, bins: int = 20, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """(xbin, ybin, n): counts on a grid over the pairs with both values (positive ones on a log axis). A dump of points would not scale."""
    raw = [log10_positive(F.col(c).cast("double")) if log else F.col(c).cast("double") for c, log in ((x, log_x), (y, log_y))]
    v = df.select(*[F.when(~F.isnan(r), r).alias(n) for r, n in zip(raw, "xy", strict=True)]).filter("x is not null and y is not null")
    spread = lambda c: F.when(F.max(c) > F.min(c), F.max(c) - F.min(c)).otherwise(1.0) / bins
    ends = v.agg(F.struct(F.min("x").alias("x0"), spread("x").alias("xw"), F.min("y").alias("y0"), spread("y").alias("yw")).alias("r"))
    at = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"r.{c}0")) / F.col(f"r.{c}w"))).cast("int")
    cells = v.withColumn("r", ends.scalar()).select(at("x").alias("xbin"), at("y").alias("ybin"))
    return cells.groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))


def score_coverage(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count(score).alias("n_scored"), (F.count(F.lit(1)) - F.count(score)).alias("n_unscored"))
