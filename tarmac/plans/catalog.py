"""The query catalog: one Spark query per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the fixture
view of the driver's tables.  Parameters are the dashboard defaults: the
range 2022-01-01 .. 2022-01-31, English labels.  Doubles are rounded to six
places (and -0.0 printed as 0.0) so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import volume_category
from ..functions.phases import phase, phase_levels
from ..functions.numeric import inverse_log, log_target
from ..ml.least_squares import (correlation_matrix, fit_linear, metrics_by_name, scorecard,
                                standardized_summary)
from ..ml.scoring import forecast_context, scoring_features
from ..operators import explore as X
from ..operators import summary as S
from ..operators.baselines import OVERALL_COL, baseline_monthly, baseline_overall
from ..operators.bins import volume_bin_table, weighted_airport_values
from ..operators.joins import lookup_join
from ..operators.metrics import metric_table
from ..sources.checked import check_traffic
from ..sources.dims import fixture_coordinates, fixture_country_labels, fixture_requests
from ..sources.literal import literal_table
from ..sources.schema import LOG_TARGET, NUMERICAL_FEATURES, TRAFFIC_COLUMNS
from ..sources.traffic import fixture_raw, fixture_traffic, parse_flight_date
from .params import CORRELATION_FEATURES, EMPTY_RANGE, END, SPLIT, START, TWO_FEATURES
from .prepare import PreparedTraffic

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column; adding 0.0 turns -0.0 into 0.0."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(field.name), places) + F.lit(0.0)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def _prep(spark: SparkSession, sf_dir: str) -> PreparedTraffic:
    return PreparedTraffic.cached(spark, sf_dir)


def _features(spark, sf_dir) -> DataFrame:
    return _prep(spark, sf_dir).features


def _train(spark, sf_dir) -> DataFrame:
    return _prep(spark, sf_dir).train()


# -- sources, filters ---------------------------------------------------------

def q_scan_traffic(spark, sf_dir):
    return fixture_traffic(spark, sf_dir)


def q_date_bounds(spark, sf_dir):
    return _features(spark, sf_dir).agg(F.min("FLT_DATE").alias("first_day"),
                                        F.max("FLT_DATE").alias("last_day"))


def q_ops_in_range(spark, sf_dir):
    return S.in_range(_features(spark, sf_dir), START, END).select(*TRAFFIC_COLUMNS)


def q_split_profile(spark, sf_dir):
    d = F.col("FLT_DATE")
    split = F.lit(SPLIT).cast("date")
    counts = _features(spark, sf_dir).agg(
        F.count(F.when(d < split, 1)).alias("train_rows"),
        F.count(F.when(d >= split, 1)).alias("test_rows"),
        F.count(d).alias("n"))
    return rounded(counts.select("train_rows", "test_rows",
                                 (F.col("train_rows") / F.col("n")).alias("train_fraction")))


def q_utc_dates(spark, sf_dir):
    """Event time stamps, written as text with an offset, read back as UTC days."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    text = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
    return events.select("event_id", parse_flight_date(text, T.StringType()).alias("utc_day"))


# -- operations summary -------------------------------------------------------

def q_pareto_airports(spark, sf_dir):
    return rounded(S.pareto_airports(_features(spark, sf_dir), START, END, fold=True))


def q_pareto_airports_unfolded(spark, sf_dir):
    return rounded(S.pareto_airports(_features(spark, sf_dir), START, END, fold=False))


def q_kpi_totals(spark, sf_dir):
    return S.kpi_totals(_features(spark, sf_dir), START, END)


def q_kpi_empty_range(spark, sf_dir):
    """A range before the first day: no flights and no change, whatever 2019 had."""
    return rounded(S.kpi_change(_features(spark, sf_dir), *EMPTY_RANGE))


def q_kpi_change(spark, sf_dir):
    return rounded(S.kpi_change(_features(spark, sf_dir), START, END))


def q_kpi_labels(spark, sf_dir):
    return S.kpi_labels(_features(spark, sf_dir), START, END)


def q_daily_ops(spark, sf_dir):
    return S.daily_ops(_features(spark, sf_dir), START, END)


def q_top_countries(spark, sf_dir):
    return S.top_countries(_features(spark, sf_dir), START, END)


def q_top_countries_unfolded(spark, sf_dir):
    """The earlier dashboard: every country ranked, no folding."""
    return S.top_countries(_features(spark, sf_dir), START, END, fold=False)


def q_volume_share(spark, sf_dir):
    return rounded(S.volume_share(_features(spark, sf_dir), START, END))


def q_volume_share_observed(spark, sf_dir):
    """The earlier dashboard: categories without flights in the range are left out."""
    return rounded(S.volume_share(_features(spark, sf_dir), START, END, keep_absent=False))


def q_daytype_share(spark, sf_dir):
    return rounded(S.daytype_share(_features(spark, sf_dir), START, END))


def q_daytype_share_fr(spark, sf_dir):
    return rounded(S.daytype_share(_features(spark, sf_dir), START, END, lang="fr"))


# -- features -----------------------------------------------------------------

def q_calendar_features(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "APT_ICAO", "FLT_DATE", "day_of_week", "day_of_month", "day_of_year",
        "week_of_year", "quarter", "is_weekend")


def q_cyclic_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select(
        "APT_ICAO", "FLT_DATE", "day_of_year_sin", "day_of_year_cos", "month_sin", "month_cos"))


def q_phase_labels(spark, sf_dir):
    months = (_features(spark, sf_dir).select("YEAR", "MONTH_NUM").distinct()
              .withColumn("pandemic_phase", phase(F.col("YEAR"), F.col("MONTH_NUM"))))
    return lookup_join(months, phase_levels(spark), ["pandemic_phase"], "left", known_small=True) \
        .select("YEAR", "MONTH_NUM", "pandemic_phase", "phase_rank")


def q_log_roundtrip(spark, sf_dir):
    df = _features(spark, sf_dir)
    return rounded(df.select("APT_ICAO", "FLT_DATE", "FLT_TOT_1",
                             log_target(F.col("FLT_TOT_1")).alias(LOG_TARGET),
                             inverse_log(log_target(F.col("FLT_TOT_1"))).alias("roundtrip")))


def q_baseline_monthly(spark, sf_dir):
    return rounded(_prep(spark, sf_dir).monthly)


def q_baseline_overall(spark, sf_dir):
    return rounded(_prep(spark, sf_dir).overall)


def q_baseline_enriched(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select(
        "APT_ICAO", "FLT_DATE", "MONTH_NUM",
        "avg_pre_pandemic_monthly_traffic", "avg_traffic_pre_pandemic_overall"))


def q_lookup_all_years(spark, sf_dir):
    stats = _prep(spark, sf_dir).stats
    monthly = baseline_monthly(stats, scope="all").withColumnRenamed(
        "avg_pre_pandemic_monthly_traffic", "avg_monthly_all_years")
    overall = baseline_overall(stats, scope="all").withColumnRenamed(
        OVERALL_COL, "avg_overall_all_years")
    small = _prep(spark, sf_dir).stats_small()
    return rounded(lookup_join(monthly, overall, ["APT_ICAO"], "inner", small=small))


def q_volume_bins(spark, sf_dir):
    p = _prep(spark, sf_dir)
    return rounded(volume_bin_table(weighted_airport_values(p.stats, p.global_mean)))


def q_volume_category(spark, sf_dir):
    """Category of every airport, from the airport-level tables (no scan of
    the fact rows): the filled overall baseline binned with the stored edges."""
    p = _prep(spark, sf_dir)
    airports = p.stats.where(F.col("APT_ICAO").isNotNull()).select("APT_ICAO").distinct()
    value = F.coalesce(F.col(OVERALL_COL), F.lit(p.global_mean))
    out = (lookup_join(airports, p.overall, ["APT_ICAO"], "left", small=p.lookups_small()[1])
           .select("APT_ICAO", value.alias(OVERALL_COL),
                   volume_category(value, p.edges).alias("airport_volume_category")))
    return rounded(out)


# -- exploration --------------------------------------------------------------

def q_monthly_series(spark, sf_dir):
    return X.monthly_series(_train(spark, sf_dir))


def q_log_by_dow(spark, sf_dir):
    return rounded(X.log_by_dow(_train(spark, sf_dir)))


def q_log_by_phase(spark, sf_dir):
    return rounded(X.log_by_phase(_train(spark, sf_dir)))


def q_log_by_volume(spark, sf_dir):
    return rounded(X.log_by_volume(_train(spark, sf_dir)))


def q_spread_by_dow(spark, sf_dir):
    return rounded(X.spread_by_dow(_train(spark, sf_dir)))


def q_spread_by_phase(spark, sf_dir):
    return rounded(X.spread_by_phase(_train(spark, sf_dir)))


def q_spread_by_volume(spark, sf_dir):
    return rounded(X.spread_by_volume(_train(spark, sf_dir)))


def q_target_correlation(spark, sf_dir):
    return rounded(X.target_correlation(_train(spark, sf_dir), CORRELATION_FEATURES))


def q_airport_map(spark, sf_dir):
    return rounded(X.airport_map(_prep(spark, sf_dir).overall, fixture_coordinates(spark, sf_dir)))


def q_mapped_airports(spark, sf_dir):
    return X.mapped_airports(_prep(spark, sf_dir).stats, fixture_coordinates(spark, sf_dir))


def q_airport_directory(spark, sf_dir):
    return X.airport_directory(_prep(spark, sf_dir).stats, fixture_country_labels(spark, sf_dir), "en")


def q_airport_directory_fr(spark, sf_dir):
    return X.airport_directory(_prep(spark, sf_dir).stats, fixture_country_labels(spark, sf_dir), "fr")


def q_fold_rare_keys(spark, sf_dir):
    return X.fold_rare_keys(_features(spark, sf_dir))


def q_metric_table(spark, sf_dir):
    """Metrics of the monthly baseline used as the forecast (log1p of it)."""
    f = _features(spark, sf_dir).where(F.col("FLT_DATE").isNotNull() & F.col("FLT_TOT_1").isNotNull())
    scored = f.select(
        F.when(F.col("FLT_DATE") < F.lit(SPLIT).cast("date"), "train").otherwise("test").alias("split"),
        "FLT_TOT_1", F.col(LOG_TARGET),
        log_target(F.col("avg_pre_pandemic_monthly_traffic")).alias("baseline_log"))
    return rounded(metric_table(scored, "FLT_TOT_1", LOG_TARGET, "baseline_log"))


# -- checked reading ------------------------------------------------------------

def _spelled(spark, sf_dir) -> DataFrame:
    """The raw fixture rows as a file would hold them: text, with several spellings of dates and numbers."""
    raw = fixture_raw(spark, sf_dir)
    day = F.dayofmonth("FLT_DATE")
    date = (F.when(day % 5 == 1, F.date_format("FLT_DATE", "dd/MM/yyyy")).when(day % 5 == 2, F.date_format("FLT_DATE", "dd MMM yyyy"))
            .when(day == 13, "the 13th").otherwise(F.date_format("FLT_DATE", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    total = F.when(day == 28, F.concat(F.col("FLT_TOT_1"), F.lit(" flights"))).when(day == 29, F.lit("")) \
        .otherwise(F.concat(F.col("FLT_TOT_1"), F.lit(".0")))
    return raw.select(*[c for c in raw.columns if c not in ("FLT_DATE", "FLT_TOT_1")], date.alias("FLT_DATE"), total.alias("FLT_TOT_1"))


def _checked(spark, sf_dir):
    return check_traffic(_spelled(spark, sf_dir), ["dd/MM/yyyy", "dd MMM yyyy"], max_reject_rate=0.2)


def q_checked_scan(spark, sf_dir):
    """Accepted rows of a file of mixed spellings, per year."""
    return (_checked(spark, sf_dir).traffic.groupBy("YEAR").agg(F.count(F.lit(1)).alias("rows"), F.count("FLT_TOT_1").alias("with_total"),
                                                               F.sum("FLT_TOT_1").alias("total"), F.min("FLT_DATE").alias("first_day")))


def q_rejected_rows(spark, sf_dir):
    """The rejects of the same file, by reason."""
    return _checked(spark, sf_dir).reason_table()


# -- closed-form fits -----------------------------------------------------------

def _terms(spark, terms) -> DataFrame:
    return literal_table(spark, [("term", T.StringType()), ("coefficient", T.DoubleType())], terms)


def q_ols_two_features(spark, sf_dir):
    """Least squares of the log target on two features, on the columns' own scale."""
    return rounded(_terms(spark, fit_linear(_train(spark, sf_dir), TWO_FEATURES, [], LOG_TARGET).raw_terms()))


def q_ridge_two_features(spark, sf_dir):
    """Ridge (alpha 1) on the two standardized features."""
    m = fit_linear(_train(spark, sf_dir), TWO_FEATURES, [], LOG_TARGET, alpha=1.0)
    return rounded(_terms(spark, [("intercept", m.intercept), *zip(m.numerical, m.coefficients)]))


def q_correlation_matrix(spark, sf_dir):
    """Correlations of all pairs of numeric features and the log target."""
    return rounded(correlation_matrix(_train(spark, sf_dir), [*CORRELATION_FEATURES, LOG_TARGET]))


def _is_train():
    return F.col("FLT_DATE") < F.lit(SPLIT).cast("date")


def q_standardized_features(spark, sf_dir):
    """Mean and deviation of the standardized features on both splits."""
    rows = _features(spark, sf_dir).where(F.col("FLT_DATE").isNotNull())
    return rounded(standardized_summary(rows, _is_train(), NUMERICAL_FEATURES))


def _closed_form_scorecard(spark, sf_dir) -> DataFrame:
    train = _train(spark, sf_dir)
    rows = _features(spark, sf_dir).where(F.col("FLT_DATE").isNotNull() & F.col("FLT_TOT_1").isNotNull())
    rows = rows.withColumn("_baseline", log_target(F.col("avg_pre_pandemic_monthly_traffic")))
    for name, alpha in (("_ols", 0.0), ("_ridge", 1.0)):
        rows = fit_linear(train, TWO_FEATURES, [], LOG_TARGET, alpha).transform(rows, name)
    return scorecard(rows, F.when(_is_train(), "train").otherwise("test"),
                     {"Monthly baseline": F.col("_baseline"), "OLS two features": F.col("_ols"),
                      "Ridge two features": F.col("_ridge")}, "FLT_TOT_1", LOG_TARGET)


def q_closed_form_scorecard(spark, sf_dir):
    """R2, MAE, RMSE of three models on both splits and scales, from one scan."""
    return rounded(_closed_form_scorecard(spark, sf_dir))


def q_scorecard_by_name(spark, sf_dir):
    """The metrics of one model, by its name."""
    return rounded(metrics_by_name(_closed_form_scorecard(spark, sf_dir), "Ridge two features"))


# -- scoring ------------------------------------------------------------------

SCORING_COLUMNS = [
    "APT_ICAO", "FLT_DATE", "YEAR", "MONTH_NUM", "day_of_month", "is_weekend",
    "avg_pre_pandemic_monthly_traffic", "avg_traffic_pre_pandemic_overall",
    "day_of_year_sin", "day_of_year_cos", "month_sin", "month_cos",
    "STATE_NAME", "day_of_week", "quarter", "pandemic_phase", "airport_volume_category",
]


def q_scoring_features(spark, sf_dir):
    feats = scoring_features(fixture_requests(spark, sf_dir), _prep(spark, sf_dir))
    return rounded(feats.select(*SCORING_COLUMNS))


def q_forecast_context(spark, sf_dir):
    return rounded(forecast_context(fixture_requests(spark, sf_dir), _prep(spark, sf_dir)))


SQL_QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
