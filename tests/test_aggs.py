"""Reports over awkward distributions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumisift.operators import aggs


def values(kind, n, seed=0):
    rng = random.Random(seed)
    make = {
        "uniform": rng.random, "heavy": lambda: 10 ** rng.uniform(-300, 300), "atoms": lambda: rng.choice([1.0, 2.0]), "one": lambda: 4.5, "ends": lambda: rng.choice([1.0] * 5 + [2.0] * 5 + [rng.uniform(1, 2)]),
        "signs": lambda: rng.gauss(0, 1e-9), "few": lambda: float(rng.randrange(7)),
    }[kind]
    return [make() for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 5000, 5001])
@pytest.mark.parametrize("kind", ["uniform", "heavy", "atoms", "one", "ends", "signs", "few"])
def test_medians_are_exact(spark, kind, n):
    if n == 0 and kind != "one":
        return
    v = values(kind, n)
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = aggs.distribution_stats(df, ["x"], accuracy=100, most=60).first()
    want = statistics.median(v) if v else None
    assert got["n"] == n and got["median"] == pytest.approx(want, rel=1e-15) if v else got["median"] is None
    assert (got["low"], got["high"]) == ((min(v), max(v)) if v else (None, None))


def test_the_last_range_does_not_grow_with_n(spark):
    """Ten times the values: the range that one task settles holds no more than the limit, in all distributions."""
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.rand(3).alias("even"), F.exp(F.randn(4) * 50).alias("skewed"), F.floor(F.rand(5) * 3).cast("double").alias("ties"))
        ranges = aggs.median_ranges(df, {c: F.col(c) for c in df.columns}, accuracy=1000, most=500)
        assert all(r.get("m0") is not None or 0 < r["inside"] <= 500 for r in ranges.values())
        exact = df.agg(*[F.median(c).alias(c) for c in df.columns]).first()
        got = {r["metric"]: r["median"] for r in aggs.distribution_stats(df, df.columns, accuracy=1000, most=500).collect()}
        assert all(got[c] == pytest.approx(exact[c], rel=1e-12) for c in df.columns)


@pytest.mark.parametrize("make", [lambda df: aggs.histogram(df, "l_quantity"), lambda df: aggs.histogram(df, "l_quantity", log_x=True), lambda df: aggs.density2d(df, "l_quantity", "l_discount")])
def test_a_histogram_holds_its_input_twice(spark, data, make):
    """Once for the range and once for the counts, however often an expression uses the range."""
    plan = make(spark.read.parquet(f"{data}/lineitem.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation spark") <= 2 and plan.count("scalar-subquery#") <= 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (float("nan"),)], "x double")
    got = aggs.histogram(df, "x", bins=3).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in got] == [(1, 2), (2, 0), (3, 1)] and got[0]["low"] == pytest.approx(0.997) and got[2]["high"] == 4.0
    one = aggs.histogram(df.filter("x = 2"), "x", bins=4).collect()
    assert sum(r["n"] for r in one) == 1 and len(one) == 4
    assert aggs.histogram(df.filter("x > 9"), "x").count() == 0 and aggs.density2d(df.filter("x > 9"), "x", "x").count() == 0
