"""Historical baselines: mean daily flights per airport and month, and per
airport, over the years before 2020, with the global mean as the fallback.

One aggregation over the traffic rows, at (airport, country, month) grain,
feeds every baseline, the bin weights, the fold ranks and the directory: the
fact table is read once and only partial aggregates are shuffled, so a hot
airport is combined map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join

BASELINE_END_YEAR = 2020  # baselines use YEAR < 2020

MONTHLY_COL = "avg_pre_pandemic_monthly_traffic"
OVERALL_COL = "avg_traffic_pre_pandemic_overall"


def _pre(col: Column) -> Column:
    return F.when(F.col("YEAR") < BASELINE_END_YEAR, col)


def airport_month_stats(traffic: DataFrame) -> DataFrame:
    """Per (APT_ICAO, STATE_NAME, MONTH_NUM): row counts and integer sums of
    total flights before 2020 and over all years.  NULL keys are kept here and
    dropped by the consumers that group like the reference did."""
    tot = F.col("FLT_TOT_1")
    return traffic.groupBy("APT_ICAO", "STATE_NAME", "MONTH_NUM").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(_pre(F.lit(1))).alias("pre_rows"),
        F.sum(_pre(tot)).alias("pre_sum"),
        F.count(_pre(tot)).alias("pre_count"),
        F.sum(tot).alias("all_sum"),
        F.count(tot).alias("all_count"),
    )


def _mean(sum_col: str, count_col: str) -> Column:
    return F.when(F.col(count_col) > 0, F.col(sum_col) / F.col(count_col))


def baseline_monthly(stats: DataFrame, scope: str = "pre") -> DataFrame:
    """(APT_ICAO, MONTH_NUM, avg_pre_pandemic_monthly_traffic).

    ``scope='pre'`` averages the years before 2020 (training); ``'all'``
    averages every year (the earlier script's lookup tables)."""
    s, c, present = _scope_cols(scope)
    return (stats.where(F.col("APT_ICAO").isNotNull() & F.col("MONTH_NUM").isNotNull()
                        & (F.col(present) > 0))
            .groupBy("APT_ICAO", "MONTH_NUM")
            .agg(F.sum(s).alias(s), F.sum(c).alias(c))
            .select("APT_ICAO", "MONTH_NUM", _mean(s, c).alias(MONTHLY_COL)))


def baseline_overall(stats: DataFrame, scope: str = "pre") -> DataFrame:
    """(APT_ICAO, avg_traffic_pre_pandemic_overall)."""
    s, c, present = _scope_cols(scope)
    return (stats.where(F.col("APT_ICAO").isNotNull() & (F.col(present) > 0))
            .groupBy("APT_ICAO")
            .agg(F.sum(s).alias(s), F.sum(c).alias(c))
            .select("APT_ICAO", _mean(s, c).alias(OVERALL_COL)))


def _scope_cols(scope: str) -> tuple[str, str, str]:
    if scope == "pre":
        return "pre_sum", "pre_count", "pre_rows"
    if scope == "all":
        return "all_sum", "all_count", "rows"
    raise ValueError(f"scope must be 'pre' or 'all', got {scope!r}")


def stats_summary(stats: DataFrame) -> dict:
    """One aggregation over the statistics table: its row count, the row
    counts of both baseline tables (their broadcast proof) and the global
    mean before 2020."""
    pre = F.col("pre_rows") > 0
    apt, month = F.col("APT_ICAO"), F.col("MONTH_NUM")
    row = stats.agg(
        F.count(F.lit(1)).alias("stats_rows"),
        F.count_distinct(F.when(apt.isNotNull() & month.isNotNull() & pre,
                                F.struct(apt, month))).alias("monthly_rows"),
        F.count_distinct(F.when(apt.isNotNull() & pre, apt)).alias("overall_rows"),
        F.sum("pre_sum").alias("s"), F.sum("pre_count").alias("c")).first()
    if not row or not row["c"]:
        raise ValueError("no traffic rows before 2020: the historical baselines "
                         "and the volume bins are undefined")
    return {"stats_rows": row["stats_rows"], "monthly_rows": row["monthly_rows"],
            "overall_rows": row["overall_rows"], "global_mean": row["s"] / row["c"]}


def global_mean(stats: DataFrame) -> float:
    """Mean total flights over all rows before 2020 (one scalar to the driver)."""
    row = stats.agg(F.sum("pre_sum").alias("s"), F.sum("pre_count").alias("c")).first()
    if not row or not row["c"]:
        raise ValueError("no traffic rows before 2020: the historical baselines "
                         "and the volume bins are undefined")
    return row["s"] / row["c"]


def enrich_with_baselines(df: DataFrame, monthly: DataFrame, overall: DataFrame,
                          fill: float, monthly_small: bool | None = None,
                          overall_small: bool | None = None) -> DataFrame:
    """Left-join both baselines onto ``df`` and fill misses with ``fill``.

    Both lookups are at most #airports x 12 rows; they are broadcast when a
    row count proves it (``*_small`` passes a count made earlier), so the fact
    table is not shuffled for them."""
    out = lookup_join(df, monthly, ["APT_ICAO", "MONTH_NUM"], "left", small=monthly_small)
    out = lookup_join(out, overall, ["APT_ICAO"], "left", small=overall_small)
    return (out
            .withColumn(MONTHLY_COL, F.coalesce(F.col(MONTHLY_COL), F.lit(float(fill))))
            .withColumn(OVERALL_COL, F.coalesce(F.col(OVERALL_COL), F.lit(float(fill)))))
