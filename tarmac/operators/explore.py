"""Exploration of the training rows and the airport dimension: monthly
series, log means and spreads by group, correlations, map and directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import VOLUME_LABELS, volume_levels
from ..functions.labels import airport_label
from ..functions.phases import phase_levels
from ..sources.literal import literal_table
from ..sources.schema import LOG_TARGET
from .baselines import OVERALL_COL
from .joins import lookup_join
from .quantiles import exact_quantiles

SPREAD_PROBABILITIES = [0.25, 0.5, 0.75]


def monthly_series(train: DataFrame) -> DataFrame:
    """Total flights per calendar month (labelled by its last day); months
    without rows between the first and the last give 0.

    The span is the first and last month of the sums; Catalyst turns it into
    a min/max over the rows that reads only the date column, so the second
    pass over the rows is a one-column scan."""
    sums = (train.where(F.col("FLT_DATE").isNotNull())
            .groupBy(F.last_day("FLT_DATE").alias("month_end"))
            .agg(F.sum("FLT_TOT_1").alias("total")))
    span = sums.agg(F.trunc(F.min("month_end"), "month").alias("lo"),
                    F.trunc(F.max("month_end"), "month").alias("hi"))
    calendar = span.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month_start")
    ).select(F.last_day("month_start").alias("month_end"))
    # The calendar has one row per month of the span: small by construction.
    return (lookup_join(calendar, sums, ["month_end"], "left", known_small=True)
            .select("month_end", F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total"))
            .orderBy("month_end"))


def log_by(train: DataFrame, key: str) -> DataFrame:
    """Mean log total per value of ``key`` (NULL keys left out)."""
    return (train.where(F.col(key).isNotNull())
            .groupBy(key).agg(F.avg(LOG_TARGET).alias("mean_log_total")).orderBy(key))


def log_by_dow(train: DataFrame) -> DataFrame:
    return (train.where(F.col("day_of_week").isNotNull())
            .groupBy("day_of_week").agg(F.avg(LOG_TARGET).alias("mean_log_total"))
            .orderBy("day_of_week"))


def log_by_phase(train: DataFrame) -> DataFrame:
    """Observed phases only, in phase order; ``Other`` (rows without a year)
    is not a level: it keeps a NULL rank and sorts last."""
    means = (train.where(F.col("pandemic_phase").isNotNull())
             .groupBy("pandemic_phase").agg(F.avg(LOG_TARGET).alias("mean_log_total")))
    levels = phase_levels(train.sparkSession)
    return (lookup_join(means, levels, ["pandemic_phase"], "left", known_small=True)
            .select("phase_rank", "pandemic_phase", "mean_log_total")
            .orderBy(F.asc_nulls_last("phase_rank")))


def log_by_volume(train: DataFrame, labels=VOLUME_LABELS) -> DataFrame:
    """Every volume level; levels without rows give NULL."""
    means = (train.where(F.col("airport_volume_category").isNotNull())
             .groupBy("airport_volume_category").agg(F.avg(LOG_TARGET).alias("mean_log_total")))
    levels = volume_levels(train.sparkSession, labels)
    return (lookup_join(levels, means, ["airport_volume_category"], "left", known_small=True)
            .select("volume_rank", "airport_volume_category", "mean_log_total")
            .orderBy("volume_rank"))


def _spread(train: DataFrame, key: str) -> DataFrame:
    """min, quartiles (linear interpolation) and max of the log total, exact by
    radix descent: no group's values are gathered anywhere."""
    found = exact_quantiles(train.where(F.col(key).isNotNull()), F.col(LOG_TARGET), [0.0, *SPREAD_PROBABILITIES, 1.0], by=key)
    names = ["min_log", "q1_log", "median_log", "q3_log", "max_log"]
    return literal_table(train.sparkSession, [(key, train.schema[key].dataType), *[(n, T.DoubleType()) for n in names]],
                         [(k, *values) for k, values in found.items()])


def spread_by_dow(train: DataFrame) -> DataFrame:
    return _spread(train, "day_of_week").orderBy("day_of_week")


def spread_by_phase(train: DataFrame) -> DataFrame:
    levels = phase_levels(train.sparkSession)
    return (lookup_join(_spread(train, "pandemic_phase"), levels, ["pandemic_phase"], "left",
                        known_small=True).orderBy(F.asc_nulls_last("phase_rank")))


def spread_by_volume(train: DataFrame, labels=VOLUME_LABELS) -> DataFrame:
    levels = volume_levels(train.sparkSession, labels)
    return (lookup_join(levels, _spread(train, "airport_volume_category"),
                        ["airport_volume_category"], "left", known_small=True)
            .orderBy("volume_rank"))


def target_correlation(train: DataFrame, columns, target: str = LOG_TARGET) -> DataFrame:
    """Pearson correlation of each column with the target (pairwise complete
    rows), one aggregation for all columns, unpivoted and sorted descending."""
    cols = list(columns) + [target]
    one_row = train.agg(*[F.corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in cols])
    long = one_row.unpivot([], cols, "feature", "correlation")
    return long.orderBy(F.desc_nulls_last("correlation"), F.asc("feature"))


def airport_map(overall: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Airports with a baseline and known coordinates (misses dropped).

    The coordinate and label dimensions are literal tables or file scans whose
    size Spark knows, so these joins carry no hint: the planner (and AQE at
    run time) broadcasts them only under ``autoBroadcastJoinThreshold``."""
    coords = (coordinates.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
              .select(F.col("airport").alias("APT_ICAO"), "lat", "lon"))
    return (overall.join(coords, ["APT_ICAO"], "inner")
            .select("APT_ICAO", OVERALL_COL, "lat", "lon").orderBy("APT_ICAO"))


def airport_countries(stats: DataFrame) -> DataFrame:
    """Distinct (APT_ICAO, STATE_NAME) pairs of the data, NULL airport left out."""
    return (stats.where(F.col("APT_ICAO").isNotNull())
            .select("APT_ICAO", "STATE_NAME").distinct())


def mapped_airports(stats: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Distinct (airport, country) pairs whose airport has coordinates."""
    keys = coordinates.select(F.col("airport").alias("APT_ICAO"))
    return (airport_countries(stats).join(keys, ["APT_ICAO"], "left_semi")
            .orderBy("APT_ICAO", "STATE_NAME"))


def airport_directory(stats: DataFrame, country_labels: DataFrame, lang: str = "en") -> DataFrame:
    """Dropdown entries: ``ICAO (Country)`` with the country translated when a
    translation exists, else shown as is."""
    labels = (country_labels.where(F.col("lang") == lang)
              .select(F.col("name").alias("STATE_NAME"), F.col("label").alias("country_label")))
    joined = airport_countries(stats).join(labels, ["STATE_NAME"], "left")
    country = F.coalesce(F.col("country_label"), F.col("STATE_NAME"))
    return (joined.select("APT_ICAO", "STATE_NAME", country.alias("country_label"),
                          airport_label(F.col("APT_ICAO"), country).alias("label"))
            .orderBy("APT_ICAO", "STATE_NAME"))


def fold_rare_keys(features: DataFrame) -> DataFrame:
    """Rows and flights per dashboard group (top airports and countries by
    row count keep their names, the rest is ``Other``)."""
    return (features.groupBy(F.col("apt_group").alias("APT_ICAO"),
                             F.col("state_group").alias("STATE_NAME"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("FLT_TOT_1").alias("total"))
            .orderBy("APT_ICAO", "STATE_NAME"))
