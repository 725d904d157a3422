"""Schema of the daily airport-traffic file and of the prepared feature table."""

from __future__ import annotations

from pyspark.sql import types as T

# The lists of this module must hold exactly these columns.
# Raw file, one row per airport and day, in the published column order.
RAW_SCHEMA = T.StructType([
    T.StructField("YEAR", T.IntegerType()),
    T.StructField("MONTH_NUM", T.IntegerType()),
    T.StructField("MONTH_MON", T.StringType()),
    T.StructField("FLT_DATE", T.StringType()),
    T.StructField("APT_ICAO", T.StringType()),
    T.StructField("APT_NAME", T.StringType()),
    T.StructField("STATE_NAME", T.StringType()),
    T.StructField("FLT_DEP_1", T.LongType()),
    T.StructField("FLT_ARR_1", T.LongType()),
    T.StructField("FLT_TOT_1", T.LongType()),
    T.StructField("FLT_DEP_IFR_2", T.DoubleType()),
    T.StructField("FLT_ARR_IFR_2", T.DoubleType()),
    T.StructField("FLT_TOT_IFR_2", T.DoubleType()),
    T.StructField("Pivot Label", T.StringType()),
])

# Columns the analysis never uses (redundant or mostly empty).
DROPPED_COLUMNS = [
    "FLT_DEP_IFR_2", "FLT_ARR_IFR_2", "FLT_TOT_IFR_2",
    "MONTH_MON", "Pivot Label", "APT_NAME",
]

# Columns kept after the scan, in output order.
TRAFFIC_COLUMNS = [
    "YEAR", "MONTH_NUM", "FLT_DATE", "APT_ICAO", "STATE_NAME",
    "FLT_DEP_1", "FLT_ARR_1", "FLT_TOT_1",
]

# Model feature sets.
NUMERICAL_FEATURES = [
    "YEAR", "day_of_month", "is_weekend",
    "avg_pre_pandemic_monthly_traffic", "avg_traffic_pre_pandemic_overall",
    "day_of_year_sin", "day_of_year_cos", "month_sin", "month_cos",
]
CATEGORICAL_FEATURES = [
    "APT_ICAO", "STATE_NAME", "day_of_week", "quarter",
    "pandemic_phase", "airport_volume_category",
]
FEATURES = NUMERICAL_FEATURES + CATEGORICAL_FEATURES

# The earlier OLS script used a different set.
EARLIER_NUMERICAL_FEATURES = [
    "YEAR", "day_of_month", "day_of_year", "week_of_year", "is_weekend",
    "avg_pre_pandemic_monthly_traffic", "avg_traffic_pre_pandemic_overall",
]
EARLIER_CATEGORICAL_FEATURES = [
    "APT_ICAO", "STATE_NAME", "MONTH_NUM", "day_of_week", "quarter",
    "pandemic_phase", "airport_volume_category",
]

TARGET = "FLT_TOT_1"
LOG_TARGET = "FLT_TOT_1_log"
