import datetime as dt

from pyspark.sql import types as T

TRAFFIC_SCHEMA = T.StructType([
    T.StructField("YEAR", T.IntegerType()),
    T.StructField("MONTH_NUM", T.IntegerType()),
    T.StructField("FLT_DATE", T.DateType()),
    T.StructField("APT_ICAO", T.StringType()),
    T.StructField("STATE_NAME", T.StringType()),
    T.StructField("FLT_DEP_1", T.LongType()),
    T.StructField("FLT_ARR_1", T.LongType()),
    T.StructField("FLT_TOT_1", T.LongType()),
])


def row(apt, state, day, total, arr=None, year=..., month=...):
    """One traffic row; arrivals default to half the total."""
    d = dt.date.fromisoformat(day) if isinstance(day, str) else day
    y = (d.year if d else None) if year is ... else year
    m = (d.month if d else None) if month is ... else month
    if arr is None and total is not None:
        arr = total // 2
    dep = None if total is None else total - (arr or 0)
    return (y, m, d, apt, state, dep, arr, total)


def traffic(spark, rows):
    return spark.createDataFrame(rows, TRAFFIC_SCHEMA)


def daily(apt, state, start, days, fn):
    """Rows for consecutive days; fn(date) gives the total."""
    d0 = dt.date.fromisoformat(start)
    return [row(apt, state, d0 + dt.timedelta(days=i), fn(d0 + dt.timedelta(days=i)))
            for i in range(days)]
