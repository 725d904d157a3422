import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tarmac.sources.schema import DROPPED_COLUMNS, TRAFFIC_COLUMNS
from tarmac.sources.traffic import (fixture_raw, fixture_traffic, parse_flight_date,
                                    read_traffic_csv, scan_traffic)

HEADER = ("YEAR,MONTH_NUM,MONTH_MON,FLT_DATE,APT_ICAO,APT_NAME,STATE_NAME,FLT_DEP_1,FLT_ARR_1,"
          "FLT_TOT_1,FLT_DEP_IFR_2,FLT_ARR_IFR_2,FLT_TOT_IFR_2,Pivot Label")


def test_csv_scan_drops_and_parses(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "flights.csv")
    with open(path, "w") as f:
        f.write(HEADER + "\n")
        f.write("2019,3,MAR,2019-03-15T00:00:00Z,EDDF,Frankfurt,Germany,600,610,1210,,,,EDDF (Germany)\n")
        f.write("2019,3,MAR,2019-03-15 23:30:00-02:00,EHAM,Amsterdam,Netherlands,1,2,3,1.0,2.0,3.0,x\n")
        f.write("2020,1,JAN,2020-01-01,LFPG,Paris,France,,5,5,,,,y\n")
    df = scan_traffic(read_traffic_csv(spark, path))
    assert df.columns == TRAFFIC_COLUMNS
    assert not set(DROPPED_COLUMNS) & set(df.columns)
    rows = {r["APT_ICAO"]: r for r in df.collect()}
    assert rows["EDDF"]["FLT_DATE"] == dt.date(2019, 3, 15)
    # 23:30 at UTC-2 is 01:30 UTC on the next day
    assert rows["EHAM"]["FLT_DATE"] == dt.date(2019, 3, 16)
    assert rows["LFPG"]["FLT_DEP_1"] is None and rows["LFPG"]["FLT_TOT_1"] == 5
    assert dict(df.dtypes)["FLT_TOT_1"] == "bigint"


def test_parse_flight_date_from_timestamp(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 2, 1, 5, 0),)], "t timestamp")
    got = df.select(parse_flight_date(F.col("t"), df.schema["t"].dataType)).first()[0]
    assert got == dt.date(2021, 2, 1)


def test_fixture_view_sizes(spark):
    raw = fixture_raw(spark, SF001)
    assert set(DROPPED_COLUMNS) <= set(raw.columns)
    t = fixture_traffic(spark, SF001)
    agg = t.agg(F.count("*").alias("n"), F.min("FLT_DATE").alias("lo"),
                F.max("FLT_DATE").alias("hi"),
                F.sum(F.col("FLT_ARR_1") + F.col("FLT_DEP_1") - F.col("FLT_TOT_1")).alias("diff")).first()
    assert agg["lo"] >= dt.date(2016, 1, 1) and agg["hi"] <= dt.date(2022, 12, 31)
    assert agg["diff"] == 0  # arrivals + departures = total
    # late openers (supplier key ending in 9) have no rows before 2020
    late = t.where(F.col("APT_ICAO").endswith("9") & (F.col("YEAR") < 2020)).count()
    assert late == 0


def test_scan_keeps_nulls(spark):
    from helpers import row, traffic
    df = traffic(spark, [row(None, None, "2019-01-01", None), row("A", "X", "2019-01-01", 3)])
    assert scan_traffic(df).count() == 2


def test_csv_by_name_any_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "reordered.csv")
    cols = HEADER.split(",")
    order = list(reversed(cols)) + ["EXTRA"]
    values = dict(zip(cols, "2019,3,MAR,2019-03-15,EDDF,Frankfurt,Germany,600,610,1210,,,,x".split(",")))
    values["FLT_TOT_1"] = "12x"  # malformed -> NULL
    with open(path, "w") as f:
        f.write(",".join(order) + "\n")
        f.write(",".join(values.get(c, "junk") for c in order) + "\n")
    r = scan_traffic(read_traffic_csv(spark, path)).first()
    assert (r["APT_ICAO"], r["FLT_DEP_1"], r["FLT_ARR_1"]) == ("EDDF", 600, 610)
    assert r["FLT_TOT_1"] is None
    bad = os.path.join(tmpdir_path, "bad.csv")
    with open(bad, "w") as f:
        f.write("YEAR,FLT_DATE\n2019,2019-01-01\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_traffic_csv(spark, bad)


def test_csv_round_trip_gives_the_same_features(spark, tmpdir_path):
    from tarmac.plans.prepare import prepare
    raw = fixture_raw(spark, SF001)
    path = os.path.join(tmpdir_path, "flights_csv")
    (raw.withColumn("FLT_DATE", F.date_format("FLT_DATE", "yyyy-MM-dd'T'00:00:00'Z'"))
        .write.option("header", True).csv(path))
    from_csv = prepare(scan_traffic(read_traffic_csv(spark, path)))
    from_parquet = prepare(fixture_traffic(spark, SF001))
    assert from_csv.edges == pytest.approx(from_parquet.edges)
    cols = ["APT_ICAO", "FLT_DATE", "FLT_TOT_1", "avg_pre_pandemic_monthly_traffic",
            "airport_volume_category", "pandemic_phase", "apt_group"]
    a = from_csv.features.select(*cols).exceptAll(from_parquet.features.select(*cols)).count()
    b = from_parquet.features.select(*cols).exceptAll(from_csv.features.select(*cols)).count()
    assert a == 0 and b == 0


def test_unparseable_date_is_null_not_an_error(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad_date.csv")
    with open(path, "w") as f:
        f.write(HEADER + "\n")
        f.write("2019,3,MAR,sometime in March,EDDF,Frankfurt,Germany,1,2,3,,,,x\n")
        f.write("2019,3,MAR,2019-03-15,EDDF,Frankfurt,Germany,1,2,3,,,,x\n")
    dates = sorted((r["FLT_DATE"] for r in scan_traffic(read_traffic_csv(spark, path)).collect()),
                   key=lambda d: (d is not None, d))
    assert dates == [None, dt.date(2019, 3, 15)]


def test_typed_source_with_nan_counts(spark):
    df = spark.createDataFrame(
        [(2019, 1, dt.date(2019, 1, 2), "A", "X", float("nan"), 2.0, 7.0)],
        "YEAR int, MONTH_NUM int, FLT_DATE date, APT_ICAO string, STATE_NAME string, "
        "FLT_DEP_1 double, FLT_ARR_1 double, FLT_TOT_1 double")
    r = scan_traffic(df).first()
    assert r["FLT_DEP_1"] is None and r["FLT_ARR_1"] == 2 and r["FLT_TOT_1"] == 7


def test_no_line_is_lost(spark):
    from tarmac.sources.traffic import fixture_traffic
    flights = fixture_traffic(spark, SF001).agg(F.sum("FLT_TOT_1")).first()[0]
    assert flights == spark.read.parquet(f"{SF001}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]


def test_whole_numbers_and_missing_years(spark):
    from tarmac.sources.traffic import whole_number
    rows = spark.createDataFrame([("1234.0",), ("12",), ("1.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(whole_number(F.col("v"), "bigint")).collect()] == [1234, 12, None, None, None]
