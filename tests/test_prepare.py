
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import daily, row, traffic
from tarmac.operators.baselines import (airport_month_stats, baseline_monthly, baseline_overall,
                                        global_mean)
from tarmac.operators.bins import volume_bins, weighted_airport_values
from tarmac.plans.prepare import prepare


def edge_case_rows():
    rows = []
    rows += daily("AAA", "Alpha", "2019-01-01", 40, lambda d: 10 + d.day % 3)
    rows += daily("BBB", "Beta", "2019-01-01", 40, lambda d: 30 + d.day % 5)
    rows += daily("CCC", "Gamma", "2019-02-01", 20, lambda d: 50)
    rows += daily("DDD", "Delta", "2019-01-15", 30, lambda d: 70 + d.day % 2)
    rows += daily("EEE", "Beta", "2018-03-01", 25, lambda d: 20 + d.day % 4)
    rows += daily("FFF", "Gamma", "2018-05-01", 25, lambda d: 40 + d.day % 6)
    rows += daily("GGG", "Delta", "2017-07-01", 25, lambda d: 60 + d.day % 7)
    rows += daily("NEW", "Alpha", "2021-03-01", 10, lambda d: 5)      # only after the baseline
    rows += daily("AAA", "Alpha", "2021-06-01", 10, lambda d: 8)
    rows.append(row(None, "Alpha", "2019-01-05", 100))                  # null airport
    rows.append(row("AAA", "Alpha", "2019-01-06", None))                # null total
    rows.append(row("BBB", None, "2019-01-07", 31))                     # null country
    rows.append(row("BBB", "Beta", "2019-01-08", 32, year=None))        # null year
    return rows


@pytest.fixture(scope="module")
def edge(spark):
    return traffic(spark, edge_case_rows())


def pandas_reference(rows):
    pdf = pd.DataFrame(rows, columns=["YEAR", "MONTH_NUM", "FLT_DATE", "APT_ICAO", "STATE_NAME",
                                      "FLT_DEP_1", "FLT_ARR_1", "FLT_TOT_1"])
    pdf["FLT_TOT_1"] = pdf["FLT_TOT_1"].astype("float")
    pdf["YEAR"] = pdf["YEAR"].astype("float")
    pre = pdf[pdf["YEAR"] < 2020]
    monthly = pre.groupby(["APT_ICAO", "MONTH_NUM"])["FLT_TOT_1"].mean()
    overall = pre.groupby("APT_ICAO")["FLT_TOT_1"].mean()
    g = pre["FLT_TOT_1"].mean()
    merged = pdf.merge(overall.rename("o").reset_index(), on="APT_ICAO", how="left")
    merged["o"] = merged["o"].fillna(g)
    _, bins = pd.qcut(merged["o"].dropna(), q=4, labels=False, duplicates="drop", retbins=True)
    return monthly, overall, g, list(bins)


def test_baselines_match_pandas(spark, edge):
    monthly, overall, g, bins = pandas_reference(edge_case_rows())
    stats = airport_month_stats(edge)
    got_m = {(r[0], r[1]): r[2] for r in baseline_monthly(stats).collect()}
    got_o = {r[0]: r[1] for r in baseline_overall(stats).collect()}
    assert set(got_m) == set(monthly.index)
    for k, v in monthly.items():
        assert got_m[k] == pytest.approx(v, rel=1e-12)
    assert set(got_o) == set(overall.index)          # null airport and NEW left out
    for k, v in overall.items():
        assert got_o[k] == pytest.approx(v, rel=1e-12)
    gm = global_mean(stats)
    assert gm == pytest.approx(g, rel=1e-12)         # includes the null-airport row
    edges = volume_bins(weighted_airport_values(stats, gm))
    assert edges == pytest.approx(bins, rel=1e-12)   # row-weighted quartiles


def test_enriched_rows_fill_and_category(spark, edge):
    p = prepare(edge)
    f = p.features
    new = f.where(F.col("APT_ICAO") == "NEW").select(
        "avg_pre_pandemic_monthly_traffic", "avg_traffic_pre_pandemic_overall").distinct().collect()
    assert len(new) == 1 and new[0][0] == pytest.approx(p.global_mean) \
        and new[0][1] == pytest.approx(p.global_mean)
    nul = f.where(F.col("APT_ICAO").isNull()).first()
    assert nul["avg_traffic_pre_pandemic_overall"] == pytest.approx(p.global_mean)
    assert nul["apt_group"] == "Other"
    # every row gets a category (values lie within the edges)
    assert f.where(F.col("airport_volume_category").isNull()).count() == 0
    # null year: phase Other, not a baseline row
    assert f.where(F.col("YEAR").isNull()).first()["pandemic_phase"] == "Other"
    assert f.count() == len(edge_case_rows())


def test_duplicate_edges_raise(spark):
    rows = daily("AAA", "X", "2019-01-01", 30, lambda d: 10) + daily("BBB", "X", "2019-01-01", 30, lambda d: 10)
    with pytest.raises(ValueError, match="duplicates"):
        prepare(traffic(spark, rows))


def test_no_pre_2020_rows_raise(spark):
    with pytest.raises(ValueError, match="before 2020"):
        prepare(traffic(spark, daily("AAA", "X", "2021-01-01", 5, lambda d: 3)))


def test_materialize_modes_agree(spark, edge):
    lazy = prepare(edge)
    table = prepare(edge, materialize="table")
    cols = ["APT_ICAO", "FLT_DATE", "avg_pre_pandemic_monthly_traffic", "airport_volume_category",
            "apt_group", "pandemic_phase"]
    a = sorted(lazy.features.select(*cols).collect(), key=str)
    b = sorted(table.features.select(*cols).collect(), key=str)
    assert a == b
    assert table.monthly_rows == lazy.monthly.count()


def test_release_deletes_written_tables(spark, edge):
    import os
    p = prepare(edge, materialize="table")
    paths = list(p.tables)
    assert len(paths) == 2
    local = [q.replace("file:", "") for q in paths]
    assert all(os.path.exists(q) for q in local)
    p.release()
    assert not any(os.path.exists(q) for q in local) and p.tables == []


def test_rows_are_dealt_to_years_while_narrow(spark, monkeypatch):
    """Finished rows are shuffled only where the lookups are; the rows are the same."""
    from helpers import daily, traffic
    from tarmac.plans import prepare as PR
    plans, write = [], PR.write_table

    def seen(df, name, *a, **k):
        if name == "features":
            plans.append((k["dealt"], df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, *a, **k)
    monkeypatch.setattr(PR, "write_table", seen)
    rows = [r for i, b in enumerate([20, 45, 90, 160, 300]) for r in daily(f"A{i}", f"L{i % 2}", "2018-11-01", 500, lambda d, b=b: b + d.day)]
    got = []
    try:
        for limit in (None, "1"):
            spark.conf.set("tarmac.broadcast.maxRows", limit) if limit else None
            f = PR.prepare(traffic(spark, rows), materialize="table").features
            got.append((f.columns, sorted(map(str, f.collect()))))
    finally:
        spark.conf.unset("tarmac.broadcast.maxRows")
    assert got[0] == got[1] and len(got[0][1]) == len(rows)
    assert [d for d, _ in plans] == [True, False]
    assert "RebalancePartitions" in plans[0][1] and "RebalancePartitions" not in plans[1][1]
    assert plans[0][1].index("Join") < plans[0][1].index("RebalancePartitions")      # below the joins
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 9      # years of a task, without a sort
