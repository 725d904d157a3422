"""Physical-plan checks: the properties the design relies on at scale."""

import pandas as pd
import pytest

from conftest import SF001
from helpers import daily, traffic
from tarmac.operators import summary as S
from tarmac.plans.prepare import PreparedTraffic, prepare


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows():
    """One airport holds almost a third of all rows (31%) and a larger one sits
    above it, so the quartile edges stay distinct."""
    rows = daily("HOT", "Big", "2017-01-01", 1800, lambda d: 900 + d.day)
    rows += daily("BIG2", "Big", "2018-01-01", 1000, lambda d: 2000 + d.day)
    for i in range(30):
        rows += daily(f"C{i:02d}", f"L{i % 5}", "2018-06-01", 50, lambda d, i=i: 5 + i)
        rows += daily(f"C{i:02d}", f"L{i % 5}", "2021-06-01", 50, lambda d, i=i: 3 + i)
    return rows


def test_lookups_are_broadcast_not_shuffled(spark):
    p = prepare(traffic(spark, hot_rows()), materialize="cache")
    raw = prepare(traffic(spark, hot_rows())).features  # lazy plan, same lookups
    text = plan(raw)
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text
    assert p.monthly_rows > 0


def test_lookup_falls_back_to_shuffle_join_beyond_limit(spark):
    rows = hot_rows()
    small = prepare(traffic(spark, rows), materialize="cache").features
    spark.conf.set("tarmac.broadcast.maxRows", "5")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = prepare(traffic(spark, rows))
        text = plan(big.features)
        assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
        cols = ["APT_ICAO", "FLT_DATE", "avg_pre_pandemic_monthly_traffic",
                "avg_traffic_pre_pandemic_overall", "airport_volume_category"]
        assert sorted(big.features.select(*cols).collect()) == sorted(small.select(*cols).collect())
    finally:
        spark.conf.unset("tarmac.broadcast.maxRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_airport_results_match_pandas(spark):
    rows = hot_rows()
    p = prepare(traffic(spark, rows), materialize="cache")
    pdf = pd.DataFrame(rows, columns=["YEAR", "MONTH_NUM", "FLT_DATE", "APT_ICAO", "STATE_NAME",
                                      "FLT_DEP_1", "FLT_ARR_1", "FLT_TOT_1"])
    pre = pdf[pdf["YEAR"] < 2020]
    want = pre.groupby("APT_ICAO")["FLT_TOT_1"].mean()
    got = {r[0]: r[1] for r in p.overall.collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    sel = pdf[(pdf["FLT_DATE"] >= pd.Timestamp("2019-01-01").date())
              & (pdf["FLT_DATE"] <= pd.Timestamp("2019-03-31").date())]
    top = sel.groupby("APT_ICAO")["FLT_TOT_1"].sum().sort_values(ascending=False).head(10)
    par = S.pareto_airports(p.features, "2019-01-01", "2019-03-31", fold=False).collect()
    assert [r["APT_ICAO"] for r in par][:2] == ["BIG2", "HOT"]
    assert [r["total"] for r in par] == list(top.values)


def test_topk_and_pruning_in_plans(spark):
    p = PreparedTraffic.cached(spark, SF001)
    pareto = S.pareto_airports(p.features, "2022-01-01", "2022-01-31")
    assert "TakeOrderedAndProject" in plan(pareto)
    totals = S.kpi_totals(p.features, "2022-01-01", "2022-01-31")
    text = plan(totals)
    if "flt_year" in p.features.columns and "InMemoryTableScan" not in text:
        part = text[text.index("PartitionFilters: [") + len("PartitionFilters: ["):]
        assert "flt_year" in part[:part.index("]")]
        assert "PushedFilters: [IsNotNull(FLT_DATE)" in text
    scan = plan(p.features.select("FLT_DATE", "FLT_TOT_1"))
    assert "ReadSchema: struct<FLT_DATE:date,FLT_TOT_1:bigint>" in scan or "InMemoryTableScan" in scan


def test_change_against_2019_is_one_scan(spark):
    p = PreparedTraffic.cached(spark, SF001)
    df = S.kpi_change(p.features, "2022-01-01", "2022-01-31")
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") + final.count("InMemoryTableScan") == 1


def test_no_query_plans_a_cross_or_nested_loop_join(spark):
    from tarmac.plans.catalog import SQL_QUERIES
    offenders = []
    for name, fn in SQL_QUERIES.items():
        text = plan(fn(spark, SF001))
        if "CartesianProduct" in text or "NestedLoopJoin" in text:
            offenders.append(name)
    assert offenders == []
