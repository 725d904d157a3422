import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from helpers import daily, row, traffic
from tarmac.operators import explore as X
from tarmac.operators import summary as S
from tarmac.plans.prepare import PreparedTraffic, prepare


def base_rows():
    rows = []
    # 12 airports with distinct sizes, two years apart
    for i in range(12):
        rows += daily(f"A{i:02d}", "Land" + str(i % 3), "2019-01-01", 60, lambda d, i=i: 10 + 3 * i)
        rows += daily(f"A{i:02d}", "Land" + str(i % 3), "2022-01-01", 60, lambda d, i=i: 12 + 3 * i)
    # ties for rank 10: T1 and T2 have the same total in 2022-01
    rows += daily("T2", "Land0", "2022-01-01", 31, lambda d: 40)
    rows += daily("T1", "Land0", "2022-01-01", 31, lambda d: 40)
    rows += daily("T1", "Land0", "2019-01-01", 31, lambda d: 40)
    rows += daily("T2", "Land0", "2019-01-01", 31, lambda d: 40)
    rows.append(row("A00", "Land0", "2020-02-29", 77))
    rows.append(row("A00", "Land0", "2019-02-28", 11))
    return rows


@pytest.fixture(scope="module")
def feats(spark):
    return prepare(traffic(spark, base_rows()), materialize="cache").features


def test_empty_range(feats):
    k = S.kpi_totals(feats, "2030-01-01", "2030-01-31").first()
    assert (k["total_ops"], k["total_arrivals"], k["total_departures"]) == (0, 0, 0)
    c = S.kpi_change(feats, "2030-01-01", "2030-01-31").first()
    assert c["change_pct"] is None
    labels = S.kpi_labels(feats, "2030-01-01", "2030-01-31").first()
    assert labels["total_label"] == "0" and labels["change_text"] == "-"
    assert labels["change_class"] == "kpi-change-neutral"
    assert S.pareto_airports(feats, "2030-01-01", "2030-01-31").count() == 0
    assert S.daily_ops(feats, "2030-01-01", "2030-01-31").count() == 0
    vs = S.volume_share(feats, "2030-01-01", "2030-01-31").collect()
    assert [r["total"] for r in vs] == [0, 0, 0, 0] and all(r["share_pct"] is None for r in vs)


def test_change_against_2019(feats):
    c = S.kpi_change(feats, "2022-01-01", "2022-01-31").first()
    cur = sum(12 + 3 * i for i in range(12)) * 31 + 80 * 31
    ref = sum(10 + 3 * i for i in range(12)) * 31 + 80 * 31
    assert (c["total_ops"], c["total_ops_2019"]) == (cur, ref)
    assert c["change_pct"] == pytest.approx((cur - ref) / ref * 100)


def test_feb29_range_is_clamped(feats):
    c = S.kpi_change(feats, "2020-02-29", "2020-02-29").first()
    feb28 = sum(r[7] for r in base_rows() if r[2] == dt.date(2019, 2, 28))
    assert c["total_ops"] == 77 and c["total_ops_2019"] == feb28 == 318 + 11


def test_range_over_new_year_has_no_reference(feats):
    c = S.kpi_change(feats, "2021-12-20", "2022-01-10").first()
    assert c["total_ops"] > 0 and c["total_ops_2019"] == 0 and c["change_pct"] is None


def test_pareto_ties_and_properties(feats):
    p = S.pareto_airports(feats, "2022-01-01", "2022-01-31", fold=False).collect()
    assert [r["rank"] for r in p] == list(range(1, 11))
    totals = [r["total"] for r in p]
    assert totals == sorted(totals, reverse=True)
    cum = [r["cumulative_pct"] for r in p]
    assert cum == sorted(cum) and cum[-1] <= 100.0
    keys = [r["APT_ICAO"] for r in p]
    # T1 and T2 tie on 1240; the smaller key ranks first
    assert keys.index("T1") + 1 == keys.index("T2")
    grand = S.kpi_totals(feats, "2022-01-01", "2022-01-31").first()["total_ops"]
    assert cum[0] == pytest.approx(totals[0] / grand * 100)


def test_shares_sum_to_100(feats):
    for df in (S.volume_share(feats, "2022-01-01", "2022-01-31"),
               S.daytype_share(feats, "2022-01-01", "2022-01-31")):
        assert sum(r["share_pct"] for r in df.collect()) == pytest.approx(100.0)
    fr = S.daytype_share(feats, "2022-01-01", "2022-01-31", lang="fr").collect()
    assert {r["day_type"] for r in fr} == {"Weekend", "Jour de semaine"}


def test_volume_share_keeps_absent_categories(spark, feats):
    only_small = feats.where(F.col("airport_volume_category") == "Small")
    vs = S.volume_share(only_small, "2022-01-01", "2022-01-31").collect()
    assert [r["airport_volume_category"] for r in vs] == ["Small", "Medium", "Large", "Very Large"]
    assert [r["total"] > 0 for r in vs] == [True, False, False, False]
    lv = X.log_by_volume(only_small).collect()
    assert lv[0]["mean_log_total"] is not None and all(r["mean_log_total"] is None for r in lv[1:])


def test_monthly_series_fills_empty_months(feats):
    train = feats.where(F.col("FLT_DATE") < F.lit("2021-02-01").cast("date"))
    ms = X.monthly_series(train).collect()
    months = [r["month_end"] for r in ms]
    assert months[0] == dt.date(2019, 1, 31) and months[-1] == dt.date(2020, 2, 29)
    assert len(months) == 14
    by = {r["month_end"]: r["total"] for r in ms}
    assert by[dt.date(2019, 6, 30)] == 0 and by[dt.date(2020, 2, 29)] == 77


def test_split_partitions_rows(spark):
    p = PreparedTraffic.cached(spark, SF001)
    assert p.train().count() + p.test().count() == p.features.count()


def test_fold_other_ranks(spark):
    p = PreparedTraffic.cached(spark, SF001)
    folded = p.features.select("apt_group").distinct().count()
    assert folded <= 41


def test_phase_groups_keep_other_last(spark):
    from tarmac.operators import explore as X
    rows = []
    for i, n in enumerate([15, 20, 25, 30, 35]):
        rows += daily(f"A{i}", "L", "2019-01-01", n, lambda d, i=i: 10 + 7 * i)
    rows += daily("C", "L", "2020-04-01", 20, lambda d: 5)
    rows.append(row("A0", "L", "2019-05-05", 7, year=None))
    f = prepare(traffic(spark, rows)).features
    got = X.log_by_phase(f).collect()
    assert [r["pandemic_phase"] for r in got] == [
        "Pre-Pandemic (2016-2019)", "Pandemic Peak Drop (Spring 2020)", "Other"]
    assert got[-1]["phase_rank"] is None
    assert [r["pandemic_phase"] for r in X.spread_by_phase(f).collect()][-1] == "Other"


def test_volume_share_can_leave_absent_out(feats):
    only = feats.where(F.col("airport_volume_category") == "Large")
    got = S.volume_share(only, "2022-01-01", "2022-01-31", keep_absent=False).collect()
    assert [r["airport_volume_category"] for r in got] == ["Large"]
    assert got[0]["share_pct"] == pytest.approx(100.0)


def test_fold_rare_and_report(spark, feats):
    from tarmac.operators.folding import fold_rare
    folded = fold_rare(feats, "APT_ICAO", 3, out="grp")
    groups = {r["grp"] for r in folded.select("grp").distinct().collect()}
    assert len(groups) == 4 and "Other" in groups
    report = S.summary_report(feats, "2022-01-01", "2022-01-31")
    assert set(report) >= {"kpi_totals", "pareto_airports", "volume_share"}
    assert report["kpi_totals"].first()["total_ops"] > 0


def test_unfolded_pareto_total_includes_null_airports(spark):
    rows = []
    for i in range(8):
        rows += daily(f"A{i}", "L", "2019-01-01", 20, lambda d, i=i: 10 + 7 * i)
    rows.append(row(None, "L", "2019-01-03", 1000))
    f = prepare(traffic(spark, rows)).features
    p = S.pareto_airports(f, "2019-01-01", "2019-01-31", fold=False).collect()
    assert None not in [r["APT_ICAO"] for r in p]
    grand = S.kpi_totals(f, "2019-01-01", "2019-01-31").first()["total_ops"]
    assert p[0]["cumulative_pct"] == pytest.approx(p[0]["total"] / grand * 100)
    folded = S.pareto_airports(f, "2019-01-01", "2019-01-31", fold=True).collect()
    assert {r["APT_ICAO"]: r["total"] for r in folded}["Other"] == 1000
