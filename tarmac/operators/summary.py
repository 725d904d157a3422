"""Operations summary for a date range: KPIs, change against 2019, daily
series, Pareto of airports, top countries, volume and day-type shares."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import VOLUME_LABELS, volume_levels
from ..functions.labels import change_class, with_labels
from .joins import lookup_join

REFERENCE_YEAR = 2019

# Day-type labels per language.
DAY_TYPE_LABELS = {
    "en": {"weekend": "Weekend", "weekday": "Weekday"},
    "fr": {"weekend": "Weekend", "weekday": "Jour de semaine"},
}


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def same_day_in_year(day: dt.date, year: int) -> dt.date:
    """``day`` moved to ``year``; 29 February becomes 28 February."""
    if day.month == 2 and day.day == 29:
        return dt.date(year, 2, 28)
    return day.replace(year=year)


def between_dates(start, end, df: DataFrame | None = None) -> Column:
    """start <= FLT_DATE <= end.  When ``df`` carries the ``flt_year``
    partition column, the same bound on it lets the scan skip other years."""
    start, end = as_date(start), as_date(end)
    cond = F.col("FLT_DATE").between(F.lit(start), F.lit(end))
    if df is not None and "flt_year" in df.columns:
        cond = cond & F.col("flt_year").between(start.year, end.year)
    return cond


def in_range(features: DataFrame, start, end) -> DataFrame:
    """Rows with start <= FLT_DATE <= end (both days included)."""
    return features.where(between_dates(start, end, features))


def _sum0(col: Column, name: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint").alias(name)


def kpi_totals(features: DataFrame, start, end) -> DataFrame:
    """One row: total, arrivals, departures (0 for an empty range)."""
    return in_range(features, start, end).agg(
        _sum0(F.col("FLT_TOT_1"), "total_ops"),
        _sum0(F.col("FLT_ARR_1"), "total_arrivals"),
        _sum0(F.col("FLT_DEP_1"), "total_departures"))


def _range_sums(features: DataFrame, start, end) -> DataFrame:
    """One scan, one row: sums of the range and the total of the same days of
    2019 (the filter keeps both ranges, conditional sums split them)."""
    start, end = as_date(start), as_date(end)
    ref_start = same_day_in_year(start, REFERENCE_YEAR)
    ref_end = same_day_in_year(end, REFERENCE_YEAR)
    current = between_dates(start, end, features)
    reference = between_dates(ref_start, ref_end, features)
    return features.where(current | reference).agg(
        _sum0(F.when(current, F.col("FLT_TOT_1")), "total_ops"),
        _sum0(F.when(current, F.col("FLT_ARR_1")), "total_arrivals"),
        _sum0(F.when(current, F.col("FLT_DEP_1")), "total_departures"),
        _sum0(F.when(reference, F.col("FLT_TOT_1")), "total_ops_2019"),
        F.count(F.when(current, 1)).alias("rows_in_range"))


def _change_pct() -> Column:
    """NULL for an empty range (the card shows "-") or without 2019 traffic."""
    ref = F.col("total_ops_2019")
    return F.when((ref > 0) & (F.col("rows_in_range") > 0),
                  (F.col("total_ops") - ref) / ref * 100)


def kpi_change(features: DataFrame, start, end) -> DataFrame:
    """Total of the range, total of the same days of 2019 and the percent
    change; NULL change when the range has no rows or the 2019 total is not
    positive.  A range over New Year maps to an empty 2019 range, hence a NULL
    change."""
    return (_range_sums(features, start, end)
            .select("total_ops", "total_ops_2019", _change_pct().alias("change_pct")))


def kpi_labels(features: DataFrame, start, end) -> DataFrame:
    """Card texts: compact totals, signed change and its style class."""
    sums = _range_sums(features, start, end).withColumn("change_pct", _change_pct())
    sums = with_labels(sums,
                       compact={"total_ops": "total_label", "total_arrivals": "arrivals_label",
                                "total_departures": "departures_label"},
                       signed_percent={"change_pct": "change_text"})
    return sums.select("total_label", "arrivals_label", "departures_label", "change_text",
                       change_class(F.col("change_pct")).alias("change_class"))


def daily_ops(features: DataFrame, start, end) -> DataFrame:
    """Arrivals and departures per day of the range."""
    return (in_range(features, start, end)
            .groupBy("FLT_DATE")
            .agg(_sum0(F.col("FLT_ARR_1"), "arrivals"), _sum0(F.col("FLT_DEP_1"), "departures"))
            .orderBy("FLT_DATE"))


def _ranked_with_total(selection: DataFrame, key: str, k: int, rank_nulls: bool) -> DataFrame:
    """Top ``k`` keys by total and the grand total of the whole selection
    (rows with a NULL key count in the total even when they are not ranked).

    The per-key aggregate is computed once (its exchange is reused by both
    branches); the top-k plans as TakeOrderedAndProject and the grand total is
    a one-row union member, so the final window sees at most k + 1 rows."""
    per_key = selection.groupBy(key).agg(_sum0(F.col("FLT_TOT_1"), "total"))
    ranked = per_key if rank_nulls else per_key.where(F.col(key).isNotNull())
    top = (ranked.orderBy(F.desc("total"), F.asc(key)).limit(k)
           .withColumn("__is_total", F.lit(False)))
    grand = (per_key.agg(_sum0(F.col("total"), "total"))
             .select(F.lit(None).cast("string").alias(key), "total",
                     F.lit(True).alias("__is_total")))
    return top.unionByName(grand)


def pareto_airports(features: DataFrame, start, end, fold: bool = True, k: int = 10) -> DataFrame:
    """Top ``k`` airports of the range by total, with the running total as a
    percent of the whole range.  ``fold=True`` ranks the dashboard groups (40
    busiest airports, the rest as ``Other``); ``fold=False`` ranks every
    airport (NULL airports are not ranked but count in the total)."""
    sel = in_range(features, start, end)
    if fold:
        sel = sel.withColumn("APT_ICAO", F.col("apt_group"))
    both = _ranked_with_total(sel, "APT_ICAO", k, rank_nulls=fold)
    order = Window.orderBy(F.col("__is_total"), F.desc("total"), F.asc("APT_ICAO"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grand = F.max(F.when(F.col("__is_total"), F.col("total"))).over(Window.partitionBy())
    running = F.sum(F.when(~F.col("__is_total"), F.col("total"))).over(upto)
    ranked = both.select("APT_ICAO", "total", "__is_total",
                         F.row_number().over(order).alias("rank"),
                         (running / grand * 100).alias("cumulative_pct"))
    return (ranked.where(~F.col("__is_total"))
            .select("rank", "APT_ICAO", "total", "cumulative_pct").orderBy("rank"))


def top_countries(features: DataFrame, start, end, k: int = 15, fold: bool = True) -> DataFrame:
    """The ``k`` countries with most flights in the range."""
    sel = in_range(features, start, end)
    if fold:
        sel = sel.withColumn("STATE_NAME", F.col("state_group"))
    else:
        sel = sel.where(F.col("STATE_NAME").isNotNull())
    return (sel.groupBy("STATE_NAME").agg(_sum0(F.col("FLT_TOT_1"), "total"))
            .orderBy(F.desc("total"), F.asc("STATE_NAME")).limit(k))


def _with_share(df: DataFrame) -> DataFrame:
    """Percent of the sum over all rows of ``df`` (a handful of slices)."""
    grand = F.sum("total").over(Window.partitionBy())
    return df.withColumn("share_pct", F.when(grand > 0, F.col("total") / grand * 100))


def volume_share(features: DataFrame, start, end, labels=VOLUME_LABELS,
                 keep_absent: bool = True) -> DataFrame:
    """Flights per volume category; categories without rows give 0, or are
    left out with ``keep_absent=False`` (the earlier dashboard)."""
    sums = (in_range(features, start, end)
            .where(F.col("airport_volume_category").isNotNull())
            .groupBy("airport_volume_category")
            .agg(_sum0(F.col("FLT_TOT_1"), "total")))
    levels = volume_levels(features.sparkSession, labels)
    out = (lookup_join(levels, sums, ["airport_volume_category"],
                       "left" if keep_absent else "inner", known_small=True)
           .select("volume_rank", "airport_volume_category",
                   F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total")))
    return _with_share(out).orderBy("volume_rank")


def daytype_share(features: DataFrame, start, end, lang: str = "en") -> DataFrame:
    """Flights on weekends and weekdays (only the types present)."""
    text = DAY_TYPE_LABELS[lang]
    day_type = F.when(F.col("is_weekend") == 1, text["weekend"]).otherwise(text["weekday"])
    sums = (in_range(features, start, end).groupBy(day_type.alias("day_type"))
            .agg(_sum0(F.col("FLT_TOT_1"), "total")))
    return _with_share(sums).orderBy("day_type")


def summary_report(features: DataFrame, start, end, lang: str = "en",
                   fold: bool = True) -> dict[str, DataFrame]:
    """Everything the operations tab shows for one range, as lazy DataFrames
    (nothing runs until each one is used)."""
    return {
        "kpi_totals": kpi_totals(features, start, end),
        "kpi_change": kpi_change(features, start, end),
        "kpi_labels": kpi_labels(features, start, end),
        "daily_ops": daily_ops(features, start, end),
        "pareto_airports": pareto_airports(features, start, end, fold=fold),
        "top_countries": top_countries(features, start, end, fold=fold),
        "volume_share": volume_share(features, start, end),
        "daytype_share": daytype_share(features, start, end, lang),
    }
