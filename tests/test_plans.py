"""Plan checks: no Python UDFs, pushed filters, map-side group limits, no single-partition windows."""

import pytest

from retenta.plans.catalog import QUERIES
from retenta.operators import kpis

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchange_below(lines: list[str], at: int) -> str:
    """The first exchange under a node, wherever it stands: the nodes under it are those
    printed deeper until one of the node's own depth."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*()0123456789"))
    for line in lines[at + 1 :]:
        if depth(line) <= depth(lines[at]) or "Exchange" in line:
            return line if "Exchange" in line else ""
    return ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_and_no_single_partition_window(spark, name):
    p = plan(QUERIES[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p, f"{name} runs Python: {node}"
    # a window whose input is gathered into one partition would not scale
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "Window []" not in line:
            assert "SinglePartition" not in exchange_below(lines, i), f"{name}: window over a single partition"


@pytest.mark.parametrize("name", ["client_transactions", "client_transactions_page2"])
def test_per_client_page_uses_group_limit(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_top_per_month_uses_group_limit(spark):
    p = plan(QUERIES["top_inputs_by_month"](spark, SF))
    assert "WindowGroupLimit" in p


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["high_risk_top"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["income_sample"](spark, SF))


def test_month_filter_reaches_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "kpi.parquet")
    from retenta.plans.catalog import kpi_table

    kpi_table(spark, SF).write.parquet(path)
    p = plan(kpis.global_kpis(spark.read.parquet(path), "1998-03"))
    assert "PushedFilters: [IsNotNull(mes), GreaterThanOrEqual(mes,1998-02-01), LessThan(mes,1998-04-01)]" in p


@pytest.mark.parametrize("name, since, first, last", [("global_kpis", "1997-08-04", "1998-02-01", "1998-04-01"), ("global_kpis_first_month", "1994-06-03", "1994-12-01", "1995-02-01")])
def test_month_range_reaches_the_scans_of_a_registered_query(spark, name, since, first, last):
    scans = [x for x in plan(QUERIES[name](spark, SF)).splitlines() if "PushedFilters" in x]
    ranged = [x for x in scans if f"GreaterThanOrEqual(o_orderdate,{first}T00:00), LessThan(o_orderdate,{last[0]}" in x]  # the plan's text is cut
    events = [x for x in scans if f"GreaterThanOrEqual(ts,{first}T00:00), LessThan(ts,{last}T00:00)" in x]
    recent = [x for x in scans if f"GreaterThanOrEqual(o_orderdate,{since}T00:00)" in x]
    assert ranged and events and recent and not [x for x in scans if "PushedFilters: []" in x]


@pytest.mark.parametrize("month", ["1995-01", "1995-07", "1998-03", "2001-08", "2003-01", "1990-05"])
def test_kpis_of_a_month_alone_equal_those_of_the_whole_table(spark, month):
    from retenta.plans.catalog import kpi_table, month_kpis

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(month_kpis(spark, SF, month)) == rows(kpis.global_kpis(kpi_table(spark, SF), month))


def test_scans_are_pruned(spark):
    p = plan(QUERIES["churn_scores"](spark, SF))
    # the lineitem scan reads only the columns the product count needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_returnflag:string>" in p
    # the return flag is a condition of the count: every line is read
    assert "EqualTo(l_returnflag" not in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hash_aggregates_run_in_generated_code(spark, name):
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    nodes = [re.sub(r"^[\s:|+\-]*", "", line) for line in p.splitlines()]
    interpreted = [n[:80] for n in nodes if n.startswith("HashAggregate")]
    assert not interpreted, interpreted
