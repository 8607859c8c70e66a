"""Every registered query against its SQL on the small tables."""

import pytest

from lumisift.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], ORACLES[name])


def test_control_sample_is_reproducible_and_failed(spark, data):
    query = registry.queries()["control_sample"]
    a, b = query(spark, data).collect(), query(spark, data).collect()
    assert a == b and len(a) == 50 and all(r["is_control_sample"] for r in a)


def test_all_queries_have_an_oracle():
    assert set(registry.queries()) == set(ORACLES)


def test_planning_runs_no_job(spark, data):
    """Histograms and grids find their ranges inside the plan."""
    from lumisift.operators import aggs

    rows = spark.read.parquet(f"{data}/lineitem.parquet")
    spark.sparkContext.setJobGroup("planning", "planning")
    aggs.histogram(rows, "l_quantity"), aggs.density2d(rows, "l_quantity", "l_discount")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_partitions_follow_the_lines(spark, data, monkeypatch):
    """Detections are dealt by order in partitions of so many lines, whatever the session's number of shuffle partitions; the wide rows are shuffled by order once."""
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_OF_A_TASK", 500)
    rows = proxy.tce(spark, data)
    n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)
    assert rows.count() > 500 and n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n})") >= 1 and plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_files_of_a_status_follow_the_orders(spark, data, same, monkeypatch):
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_OF_A_TASK", 200)
    same(registry.queries()["machine_readable"], ORACLES["machine_readable"])
    got = registry.queries()["machine_readable"](spark, data)
    assert len(got.inputFiles()) > 3


def test_shuffles_of_lines_are_written_straight_through(spark, data, same, monkeypatch):
    """However many lines there are, lines are dealt in as many partitions as a task writes without holding its rows, and results stay."""
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_OF_A_TASK", 10)
    assert spark.read.parquet(f"{data}/lineitem.parquet").count() > 200 * 10
    plan = proxy.tce(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 200), REPARTITION_BY_NUM") == 1
    same(registry.queries()["derived_metrics"], ORACLES["derived_metrics"])


def test_statistics_join_their_rows_once(spark, data, monkeypatch):
    """The passes over the metrics read stored columns; the tables are read while these are written, and not again."""
    from lumisift.operators import aggs

    seen = []
    inner = aggs.median_ranges
    monkeypatch.setattr(aggs, "median_ranges", lambda df, *a, **k: seen.append(df) or inner(df, *a, **k))
    got = registry.queries()["distribution_stats"](spark, data)
    assert len(seen) == 1 and not any("lineitem" in f for f in seen[0].inputFiles()) and not any("lineitem" in f for f in got.inputFiles())
    assert seen[0].count() == spark.read.parquet(f"{data}/lineitem.parquet").count()


def test_report_builds_its_sample_once(spark, data, monkeypatch):
    from lumisift.plans import pipelines

    seen = []
    inner = pipelines.report
    monkeypatch.setattr(pipelines, "report", lambda df, scores: seen.append(df) or inner(df, scores))
    registry.queries()["report_tables"](spark, data)
    assert len(seen) == 1 and seen[0].inputFiles() and not any("lineitem" in f or "orders" in f for f in seen[0].inputFiles())


@pytest.mark.parametrize("name", ["score_round_trip", "sample_sink", "survivor_table"])
def test_rows_of_a_task_have_a_bound(spark, data, same, monkeypatch, name):
    """Where 200 partitions would give a task more rows than it may take, there are more partitions, and results stay."""
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_OF_A_TASK", 10)
    monkeypatch.setattr(proxy, "MOST_ROWS_OF_A_TASK", 25)
    n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 25)
    assert n > 200 and proxy.tce(spark, data)._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") == 1
    same(registry.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", ["build_sample", "diagnostic_flags", "top_n"])
def test_joins_with_many_parts_follow_the_lines(spark, data, same, monkeypatch, name):
    """Lines meet parts, and orders customers, that are too many to broadcast in partitions of so many rows, whatever the session's number."""
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_OF_A_TASK", 100)
    monkeypatch.setattr(proxy, "ROWS_TO_BROADCAST", 10)
    plan = proxy.tce(spark, data)._jdf.queryExecution().executedPlan().toString()
    for table, key in (("lineitem", "l_partkey"), ("orders", "o_custkey")):
        n = -(-spark.read.parquet(f"{data}/{table}.parquet").count() // 100)
        assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and len([x for x in plan.splitlines() if f"hashpartitioning({key}" in x and f", {n}), REPARTITION_BY_NUM" in x]) == 1
    same(registry.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", ["score_round_trip", "merge_predictions_scoped", "merge_predictions_unscoped"])
def test_scores_meet_rows_in_partitions_that_follow_the_lines(spark, data, same, monkeypatch, name):
    """Both sides of the join with scores are dealt in partitions of so many rows, whatever the session's number."""
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_OF_A_TASK", 100)
    n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 100)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < n <= 200
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "hashpartitioning(_t" in x and f", {n}), REPARTITION_BY_NUM" in x]) == 2 and not [x for x in plan.splitlines() if "hashpartitioning(_t" in x and f", {n})" not in x]
    same(registry.queries()[name], ORACLES[name])


def test_many_parts_are_not_broadcast_for_few_columns(spark, data, same, monkeypatch):
    """Keys alone are few bytes a row, but too many rows still are no broadcast."""
    from lumisift.plans import proxy

    monkeypatch.setattr(proxy, "ROWS_TO_BROADCAST", 10)
    plan = proxy.tce(spark, data).select("tic_id", "orbital_period_days")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [l_partkey") == 1 and plan.count("SortMergeJoin [o_custkey") == 1
    same(registry.queries()["build_sample"], ORACLES["build_sample"])
