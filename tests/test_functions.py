import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarmac.functions import PHASE_ORDER, calendar_columns, cyclic_columns, phase, volume_category
from tarmac.functions.labels import change_class, with_compact, with_signed_percent


def test_phase_rules(spark):
    cases = [
        (2016, 5, PHASE_ORDER[0]), (2019, 12, PHASE_ORDER[0]),
        (2020, 1, PHASE_ORDER[3]), (2020, 2, PHASE_ORDER[3]),   # Jan/Feb 2020: second wave
        (2020, 3, PHASE_ORDER[1]), (2020, 5, PHASE_ORDER[1]),
        (2020, 6, PHASE_ORDER[2]), (2020, 8, PHASE_ORDER[2]),
        (2020, 9, PHASE_ORDER[3]), (2020, 12, PHASE_ORDER[3]),
        (2021, 1, PHASE_ORDER[4]), (2021, 4, PHASE_ORDER[4]),
        (2021, 5, PHASE_ORDER[5]), (2021, 8, PHASE_ORDER[5]),
        (2021, 9, PHASE_ORDER[6]), (2022, 7, PHASE_ORDER[7]),
        (2023, 1, PHASE_ORDER[8]), (2031, 6, PHASE_ORDER[8]),
        (None, 3, "Other"), (2020, None, PHASE_ORDER[3]),
    ]
    df = spark.createDataFrame([(y, m) for y, m, _ in cases], "y int, m int")
    got = [r[0] for r in df.select(phase(F.col("y"), F.col("m"))).collect()]
    assert got == [label for _, _, label in cases]


def test_calendar_monday_zero_iso_week(spark):
    days = [dt.date(2024, 1, 1), dt.date(2021, 1, 3), dt.date(2022, 12, 31), dt.date(2020, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(*[c.alias(k) for k, c in calendar_columns(F.col("d")).items()]).collect()
    for d, r in zip(days, rows):
        assert r["day_of_week"] == d.weekday()
        assert r["week_of_year"] == d.isocalendar()[1]
        assert r["day_of_year"] == d.timetuple().tm_yday
        assert r["quarter"] == (d.month - 1) // 3 + 1
        assert r["is_weekend"] == int(d.weekday() >= 5)
        assert r["day_of_month"] == d.day


def test_cyclic(spark):
    df = spark.createDataFrame([(100, 7)], "doy int, m int")
    r = df.select(*[c.alias(k) for k, c in cyclic_columns(F.col("doy"), F.col("m")).items()]).first()
    assert r["day_of_year_sin"] == pytest.approx(math.sin(2 * math.pi * 100 / 365.25), abs=1e-15)
    assert r["day_of_year_cos"] == pytest.approx(math.cos(2 * math.pi * 100 / 365.25), abs=1e-15)
    assert r["month_sin"] == pytest.approx(math.sin(2 * math.pi * 7 / 12), abs=1e-15)
    assert r["month_cos"] == pytest.approx(math.cos(2 * math.pi * 7 / 12), abs=1e-15)


def test_volume_category_right_closed_lowest_included(spark):
    edges = [10.0, 20.0, 30.0, 40.0, 50.0]
    values = [10.0, 15.0, 20.0, 20.000001, 30.0, 40.0, 45.0, 50.0, 9.99, 50.01, None]
    want = ["Small", "Small", "Small", "Medium", "Medium", "Large", "Very Large", "Very Large",
            None, None, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(volume_category(F.col("x"), edges)).collect()]
    assert got == want


def test_volume_category_needs_distinct_edges():
    with pytest.raises(ValueError):
        volume_category(F.col("x"), [1.0, 1.0, 2.0, 3.0, 4.0])
    with pytest.raises(ValueError):
        volume_category(F.col("x"), [1.0, 2.0, 3.0])


@pytest.mark.parametrize("n", [0, 7, 999, 1000, 1250, 1350, 12350, 99949, 999999, 1000000,
                               1250000, 2350000, -1500, -999, 123456789])
def test_compact_matches_python(spark, n):
    def py(v):
        return f"{v / 1e6:.1f}M" if abs(v) >= 1e6 else f"{v / 1e3:.1f}K" if abs(v) >= 1e3 else str(v)
    got = with_compact(spark.createDataFrame([(n,)], "n bigint"), "n", "t").first()["t"]
    assert got == py(n)


@pytest.mark.parametrize("pct", [12.35, 0.25, -0.04, 0.0, 3.651512609741095, -100.0, None])
def test_signed_percent_and_class(spark, pct):
    r = with_signed_percent(spark.createDataFrame([(pct,)], "p double"), "p", "t") \
        .select("t", change_class(F.col("p")).alias("c")).first()
    assert r["t"] == ("-" if pct is None else f"{pct:+.1f}%")
    want = ("kpi-change-neutral" if pct is None or pct == 0
            else "kpi-change-positive" if pct > 0 else "kpi-change-negative")
    assert r["c"] == want
