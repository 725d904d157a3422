"""Reading daily traffic: the raw CSV/Parquet file and the TPC-H based fixture view.

Everything here is lazy; Catalyst prunes the columns and pushes the filters
into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import DROPPED_COLUMNS, RAW_SCHEMA, TRAFFIC_COLUMNS

# Fixed values of the fixture mapping (see FIXTURES.md): ship dates move by
# 7670 days so that 1995-01-01 becomes 2016-01-01; suppliers whose key ends in
# 9 open in 2020: their earlier days move into the 1000 days from then on, so
# they have no baseline rows and no line is lost.
FIXTURE_DAY_SHIFT = 7670
FIXTURE_FIRST_DATE = "2016-01-01"
LATE_OPENER_DIGIT = 9
LATE_OPENING_DATE = "2020-01-01"
LATE_OPENING_DAYS = 1000


def read_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, typed by name (no inference, no reliance on
    the column order; extra columns are ignored, malformed values become
    NULL, a missing column is an error)."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in RAW_SCHEMA.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return text.select(*[(whole_number(F.col(f"`{f.name}`"), f.dataType) if isinstance(f.dataType, T.IntegralType)
                          else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name)
                         if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                         for f in RAW_SCHEMA.fields])


def whole_number(col: Column, dtype: T.DataType | str) -> Column:
    """``col`` as an integer; text like ``1234.0`` counts, a fraction or junk is NULL."""
    return whole_of(col, exact_number(col), dtype)


def exact_number(col: Column) -> Column:
    return col.try_cast("decimal(38,6)")


def whole_of(col: Column, exact: Column, dtype: T.DataType | str) -> Column:
    """``whole_number`` of ``col`` and its ``exact_number``, which comes first: a failed integer cast of ``1234.0``
    costs an exception a row."""
    return F.when(exact.isNull(), col.try_cast(dtype)).otherwise(F.when(exact == F.floor(exact), exact.try_cast(dtype)))


def read_traffic_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_flight_date(col: Column, dtype: T.DataType) -> Column:
    """Date text or timestamp to a UTC calendar date.

    Naive text is taken as UTC, text with an offset is converted to UTC (the
    session time zone is UTC, see ``tarmac.session``); text that does not
    parse gives NULL instead of failing the scan."""
    if isinstance(dtype, T.DateType):
        return col
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    return F.to_date(F.try_to_timestamp(col))


def scan_traffic(raw: DataFrame) -> DataFrame:
    """Drop the redundant columns, parse the date and fix the column types
    (a value that does not fit, such as a NaN count, becomes NULL; a missing
    year or month comes from the date)."""
    df = raw.drop(*[c for c in DROPPED_COLUMNS if c in raw.columns])
    day = parse_flight_date(F.col("FLT_DATE"), df.schema["FLT_DATE"].dataType)
    return df.select(
        F.coalesce(F.col("YEAR").try_cast("int"), F.year(day)).alias("YEAR"),
        F.coalesce(F.col("MONTH_NUM").try_cast("int"), F.month(day)).alias("MONTH_NUM"),
        day.alias("FLT_DATE"),
        F.col("APT_ICAO").cast("string").alias("APT_ICAO"),
        F.col("STATE_NAME").cast("string").alias("STATE_NAME"),
        F.col("FLT_DEP_1").try_cast("bigint").alias("FLT_DEP_1"),
        F.col("FLT_ARR_1").try_cast("bigint").alias("FLT_ARR_1"),
        F.col("FLT_TOT_1").try_cast("bigint").alias("FLT_TOT_1"),
    ).select(*TRAFFIC_COLUMNS)


def fixture_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw traffic rows derived from the driver's TPC-H tables.

    supplier = airport, nation = country, shipped quantity = flights; lines
    with status F are arrivals, the others departures.  The result has the
    raw file's columns, so it goes through ``scan_traffic`` like a real file.
    Dimension joins carry no hints: supplier and nation are scanned from files
    whose size Spark knows, so the planner (and AQE at run time) broadcasts
    them only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    day = F.date_add(F.to_date("l_shipdate"), FIXTURE_DAY_SHIFT)
    opening = F.lit(LATE_OPENING_DATE).cast("date")
    early = (F.col("l_suppkey") % 10 == LATE_OPENER_DIGIT) & (day < opening)
    moved = F.date_add(opening, F.datediff(day, F.lit(FIXTURE_FIRST_DATE).cast("date")) % LATE_OPENING_DAYS)
    arrival = F.col("l_linestatus") == "F"
    # by supplier key and day first: hot suppliers combine map-side on an integer, and only daily
    # rows meet the dimensions
    lines = (lineitem
             .select("l_suppkey", "l_quantity", "l_linestatus", F.when(early, moved).otherwise(day).alias("FLT_DATE"))
             .groupBy("l_suppkey", "FLT_DATE")
             .agg(F.sum("l_quantity").alias("total"),
                  F.sum(F.when(arrival, F.col("l_quantity")).otherwise(0.0)).alias("arrivals"),
                  F.sum(F.when(~arrival, F.col("l_quantity")).otherwise(0.0)).alias("departures")))
    daily = (lines
             .join(supplier.select("s_suppkey", "s_name", "s_nationkey"),
                   F.col("l_suppkey") == F.col("s_suppkey"))
             .join(nation.select("n_nationkey", "n_name"),
                   F.col("s_nationkey") == F.col("n_nationkey"))
             .groupBy(F.col("s_name").alias("APT_ICAO"),
                      F.col("n_name").alias("STATE_NAME"), "FLT_DATE")
             .agg(F.round(F.sum("total")).cast("bigint").alias("FLT_TOT_1"),
                  F.round(F.sum("arrivals")).cast("bigint").alias("FLT_ARR_1"),
                  F.round(F.sum("departures")).cast("bigint").alias("FLT_DEP_1")))
    return daily.select(
        F.year("FLT_DATE").alias("YEAR"),
        F.month("FLT_DATE").alias("MONTH_NUM"),
        F.upper(F.date_format("FLT_DATE", "MMM")).alias("MONTH_MON"),
        "FLT_DATE", "APT_ICAO",
        F.concat(F.lit("Airport "), F.col("APT_ICAO")).alias("APT_NAME"),
        "STATE_NAME", "FLT_DEP_1", "FLT_ARR_1", "FLT_TOT_1",
        F.lit(None).cast("double").alias("FLT_DEP_IFR_2"),
        F.lit(None).cast("double").alias("FLT_ARR_IFR_2"),
        F.lit(None).cast("double").alias("FLT_TOT_IFR_2"),
        F.concat_ws(" - ", "APT_ICAO", "STATE_NAME").alias("Pivot Label"),
    )


def fixture_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture view as the analysis sees it (after ``scan_traffic``)."""
    return scan_traffic(fixture_raw(spark, sf_dir))
