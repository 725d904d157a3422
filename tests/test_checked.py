import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tarmac.sources import checked as C
from tarmac.sources.schema import TRAFFIC_COLUMNS
from tarmac.sources.traffic import whole_number

HEADER = ("FLT_DATE,YEAR,MONTH_NUM,MONTH_MON,APT_ICAO,APT_NAME,STATE_NAME,FLT_DEP_1,FLT_ARR_1,FLT_TOT_1,"
          "FLT_DEP_IFR_2,FLT_ARR_IFR_2,FLT_TOT_IFR_2,Pivot Label")


def line(date, apt, total="10", year="2019", month="3"):
    return f"{date},{year},{month},MAR,{apt},name,Land,5,5,{total},,,,x"


LINES = [line("2019-03-15T00:00:00Z", "iso"), line("2019-03-15 23:30:00-02:00", "offset"), line("05/03/2019", "slash"),
         line("7 March 2019", "words"), line("soon", "junk"), line("31/02/2019", "no day"), line("", "no date", year="", month=""),
         line("2019-03-01", "half", "10.5"), line("2019-03-02", "float", "12.0"), line("2019-03-03", "two wrong", "many", "year"),
         line("2019-03-04", "nan", "NaN"), "2019-03-05,2019,3", line("2019-03-06", "long") + ",more,fields", line("2019-03-07", "early", "8", "", "")]


@pytest.fixture()
def folder(tmpdir_path):
    for k in range(2):        # two files
        with open(os.path.join(tmpdir_path, f"part{k}.csv"), "w") as f:
            f.write("\n".join([HEADER, *LINES[k::2]]) + "\n")
    return tmpdir_path


def test_every_row_is_accounted_for(spark, folder):
    got = C.read_traffic_checked(spark, folder, ["dd/MM/yyyy", "d MMMM yyyy"], max_reject_rate=0.9)
    assert got.traffic.columns == TRAFFIC_COLUMNS and got.rows == len(LINES)
    rows = {r.APT_ICAO: r for r in got.traffic.collect()}
    assert set(rows) == {"iso", "offset", "slash", "words", "no date", "float", "nan", "early"}
    assert rows["offset"].FLT_DATE == dt.date(2019, 3, 16) and rows["slash"].FLT_DATE == dt.date(2019, 3, 5)
    assert rows["words"].FLT_DATE == dt.date(2019, 3, 7) and rows["no date"].FLT_DATE is None
    assert rows["float"].FLT_TOT_1 == 12 and rows["nan"].FLT_TOT_1 is None
    assert (rows["early"].YEAR, rows["early"].MONTH_NUM) == (2019, 3)
    want = {"FLT_DATE: no date": 2, "FLT_TOT_1: no whole number": 2, "YEAR: no whole number": 1, C.BROKEN: 2}
    assert got.reasons == want and got.rejected == 6
    assert {r.reason: r.rows for r in got.reason_table().collect()} == want
    assert got.rejects.count() + got.traffic.count() == got.rows
    text = {r.APT_ICAO: r for r in got.rejects.collect()}
    assert text["two wrong"].FLT_TOT_1 == "many" and sorted(text["two wrong"].reasons) == ["FLT_TOT_1: no whole number", "YEAR: no whole number"]


def test_formats_are_asked_for_and_tried_in_order(spark):
    df = spark.createDataFrame([("01/02/2016",)], "t string")
    assert df.select(C.parse_date(F.col("t"))).first()[0] is None
    assert df.select(C.parse_date(F.col("t"), ["dd/MM/yyyy", "MM/dd/yyyy"])).first()[0] == dt.date(2016, 2, 1)
    assert df.select(C.parse_date(F.col("t"), ["MM/dd/yyyy", "dd/MM/yyyy"])).first()[0] == dt.date(2016, 1, 2)


def test_too_many_rejects_are_an_error(spark, folder):
    with pytest.raises(ValueError, match="8 of 14 rows do not parse.*FLT_DATE: no date"):
        C.read_traffic_checked(spark, folder)
    with pytest.raises(ValueError, match="missing columns"):
        C.check_traffic(spark.createDataFrame([("x",)], "APT_ICAO string"))


def test_all_good_and_empty(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "a.csv")
    with open(path, "w") as f:
        f.write("\n".join([HEADER, line("2019-03-01", "a")]) + "\n")
    got = C.read_traffic_checked(spark, path)
    assert got.traffic.count() == 1 and got.rejects.count() == 0 and got.reason_table().count() == 0
    with open(path, "w") as f:
        f.write(HEADER + "\n")
    got = C.read_traffic_checked(spark, path)
    assert (got.rows, got.traffic.count(), got.rejects.count()) == (0, 0, 0)


def test_the_code_of_a_row_is_small_enough_to_be_compiled(spark):
    """The JVM interprets methods of more than 8000 bytes for good, which took nine tenths of the parsing."""
    text = spark.range(1).select(*[F.col("id").cast("string").alias(f.name) for f in C.READ_COLUMNS])
    checked = C.check_columns(text, ["dd/MM/yyyy", "dd MMM yyyy"])
    made = checked._jdf.queryExecution().debug().codegenToSeq()
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("dtype", ["int", "bigint"])
def test_whole_numbers_of_any_spelling(spark, dtype):
    good = {"12": 12, "12.0": 12, "-3": -3, "+4": 4, " 5 ": 5, "1e3": 1000, "1.": 1, "-0": 0, "\u007f7": 7}
    bad = ["10.5", "x", "", "1e40", "99999999999999999999", "12 flights", "NaN", "1_0"]
    df = spark.createDataFrame([(v,) for v in [*good, *bad]], "t string")
    got = {r.t: r.n for r in df.select("t", whole_number(F.col("t"), dtype).alias("n")).collect()}
    assert got == good | dict.fromkeys(bad)
