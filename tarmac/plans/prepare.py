"""The prepared traffic table: calendar, cyclic, phase, baselines, volume
category, fold groups and the log target, plus the lookup tables the
forecasts need (the reference's saved "artifacts").

``prepare`` builds it; ``PreparedTraffic.cached`` keeps one copy per session
and source so the dashboard queries reuse it, as the reference's dashboard
did with its in-memory frame.

Materialization (``tarmac.materialize``):

* ``table`` (default) – written as Parquet partitioned by ``flt_year`` under
  the shared ``spark.checkpoint.dir`` and read back: lineage is cut, an
  executor loss costs a re-read, and date-range queries prune whole years.
* ``cache`` – persisted MEMORY_AND_DISK; lost blocks are recomputed from
  lineage (handy for small interactive work).
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar_columns, cyclic_columns, log_target, phase, volume_category
from ..functions.binning import VOLUME_LABELS
from ..operators.baselines import (airport_month_stats, baseline_monthly, baseline_overall,
                                   enrich_with_baselines, stats_summary)
from ..operators.bins import volume_bins, weighted_airport_values
from ..operators.folding import fold_column, top_keys_by_rows
from ..operators.joins import broadcast_limit
from ..session import ensure_checkpoint_dir
from ..sources.schema import LOG_TARGET
from ..sources.traffic import fixture_traffic

TOP_AIRPORTS = 40
TOP_COUNTRIES = 15
SPLIT_DATE = "2021-02-01"  # train < split <= test
PARTITION_COLUMN = "flt_year"


@dataclass
class PreparedTraffic:
    features: DataFrame
    stats: DataFrame
    monthly: DataFrame
    overall: DataFrame
    global_mean: float
    edges: list[float]
    monthly_rows: int | None = None
    overall_rows: int | None = None
    stats_rows: int | None = None
    labels: list[str] = field(default_factory=lambda: list(VOLUME_LABELS))
    tables: list[str] = field(default_factory=list)  # paths written by ``prepare``

    @property
    def spark(self) -> SparkSession:
        return self.features.sparkSession

    def train(self) -> DataFrame:
        """Rows before the split date (the year bound prunes partitions)."""
        cond = F.col("FLT_DATE") < F.lit(SPLIT_DATE).cast("date")
        if PARTITION_COLUMN in self.features.columns:
            cond = cond & (F.col(PARTITION_COLUMN) <= int(SPLIT_DATE[:4]))
        return self.features.where(cond)

    def test(self) -> DataFrame:
        cond = F.col("FLT_DATE") >= F.lit(SPLIT_DATE).cast("date")
        if PARTITION_COLUMN in self.features.columns:
            cond = cond & (F.col(PARTITION_COLUMN) >= int(SPLIT_DATE[:4]))
        return self.features.where(cond)

    def lookups_small(self) -> tuple[bool | None, bool | None]:
        """Whether the monthly / overall lookups are small enough to broadcast,
        from the counts made at preparation (None: not counted yet)."""
        limit = broadcast_limit(self.features)
        return (None if self.monthly_rows is None else self.monthly_rows <= limit,
                None if self.overall_rows is None else self.overall_rows <= limit)

    def stats_small(self) -> bool | None:
        """Any per-airport or per-(airport, month) table derived from the
        statistics has at most ``stats_rows`` rows: a proven broadcast bound."""
        if self.stats_rows is None:
            return None
        return self.stats_rows <= broadcast_limit(self.features)

    def countries_small(self) -> bool | None:
        """The airport -> country table has at most ``stats_rows`` rows."""
        return self.stats_small()

    @property
    def countries(self) -> DataFrame:
        """(APT_ICAO, STATE_NAME): the first (smallest) country per airport."""
        return (self.stats.where(F.col("APT_ICAO").isNotNull())
                .groupBy("APT_ICAO").agg(F.min("STATE_NAME").alias("STATE_NAME")))

    def unpersist(self) -> None:
        for df in (self.features, self.stats, self.monthly, self.overall):
            df.unpersist()

    def release(self) -> None:
        """Unpersist and delete the tables this preparation wrote (explicit;
        nothing calls it for you, as queries may still read them)."""
        self.unpersist()
        for path in self.tables:
            delete_path(self.spark, path)
        self.tables.clear()

    @classmethod
    def cached(cls, spark: SparkSession, sf_dir: str) -> "PreparedTraffic":
        """One prepared copy per session and fixture folder."""
        key = (spark.sparkContext.applicationId, sf_dir)
        with _CACHE_LOCK:
            hit = _CACHE.get(key)
            if hit is None:
                mode = spark.conf.get("tarmac.materialize", "table")
                hit = prepare(fixture_traffic(spark, sf_dir), materialize=mode)
                _CACHE[key] = hit
            return hit


_CACHE: dict = {}
_CACHE_LOCK = threading.Lock()


def add_calendar(df: DataFrame) -> DataFrame:
    df = df.withColumns(calendar_columns(F.col("FLT_DATE")))
    return df.withColumns(cyclic_columns(F.col("day_of_year"), F.col("MONTH_NUM")))


def delete_path(spark: SparkSession, path: str) -> None:
    """Recursive delete through Hadoop's FileSystem (any shared store)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                written: list[str] | None = None, spread: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and return
    the re-read table (lineage cut, column pruning and partition pruning).

    The ``rebalance`` hint clusters rows by the partition columns before the
    write, and AQE splits oversized and merges small shuffle partitions, so
    each year gets a few right-sized files instead of one small file per
    task, and a big year does not end up in a single task.  ``spread`` asks for
    that many files instead, for a table that many small jobs read; ``dealt`` rows
    are rebalanced already."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tarmac-tables/{name}-{uuid.uuid4().hex}"
    if not dealt:
        df = df.repartition(spread) if spread else df.hint("rebalance", *(partition_by or []))
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.parquet(path)


def prepare(traffic: DataFrame, materialize: str | None = None,
            top_airports: int = TOP_AIRPORTS, top_countries: int = TOP_COUNTRIES,
            edges: list[float] | None = None) -> PreparedTraffic:
    """Feature engineering of the training script.

    The fact rows are read twice: once for the (airport, country, month)
    statistics, once to build the feature rows; everything else (baselines,
    global mean, five bin edges, top-k fold keys) is derived from the small
    statistics table.  ``materialize`` is None (lazy), ``'cache'`` or
    ``'table'``.  ``edges`` reuses stored bin edges (e.g. ``load_artifacts``)
    instead of recomputing them, as the dashboard reused the trained bins."""
    if materialize not in (None, "cache", "table"):
        raise ValueError(f"materialize must be None, 'cache' or 'table', got {materialize!r}")
    level = StorageLevel.MEMORY_AND_DISK
    written: list[str] = []
    if materialize:
        traffic = traffic.persist(level)
    stats = airport_month_stats(traffic)
    if materialize == "table":
        stats = write_table(stats, "airport-month-stats", written=written)
    elif materialize == "cache":
        stats = stats.persist(level)
    monthly = baseline_monthly(stats)
    overall = baseline_overall(stats)
    if materialize:
        monthly, overall = monthly.persist(level), overall.persist(level)
    summary = stats_summary(stats)
    monthly_rows, overall_rows = summary["monthly_rows"], summary["overall_rows"]
    stats_rows, fill = summary["stats_rows"], summary["global_mean"]
    if edges is None:
        edges = volume_bins(weighted_airport_values(stats, fill))
    edges = [float(e) for e in edges]

    limit = broadcast_limit(traffic)
    # rows are dealt to years while they are narrow; lookups too large to broadcast would deal them
    # anew, so the finished rows are dealt then
    early = materialize == "table" and max(monthly_rows, overall_rows) <= limit
    df = traffic.withColumn(PARTITION_COLUMN, F.year("FLT_DATE"))
    if early:
        df = df.hint("rebalance", PARTITION_COLUMN)
    df = add_calendar(df)
    df = df.withColumn("pandemic_phase", phase(F.col("YEAR"), F.col("MONTH_NUM")))
    df = enrich_with_baselines(df, monthly, overall, fill,
                               monthly_small=monthly_rows <= limit,
                               overall_small=overall_rows <= limit)
    df = df.withColumn("airport_volume_category",
                       volume_category(F.col("avg_traffic_pre_pandemic_overall"), edges))
    df = df.withColumn(LOG_TARGET, log_target(F.col("FLT_TOT_1")))
    # Dashboard grouping: the 40 airports and 15 countries with most rows keep
    # their name, everything else (NULL included) becomes "Other".
    df = fold_column(df, "APT_ICAO", "apt_group",
                     top_keys_by_rows(stats, "APT_ICAO", top_airports))
    df = fold_column(df, "STATE_NAME", "state_group",
                     top_keys_by_rows(stats, "STATE_NAME", top_countries))
    df = df.select(*[c for c in df.columns if c != PARTITION_COLUMN], PARTITION_COLUMN)
    if materialize == "table":
        df = write_table(df, "features", [PARTITION_COLUMN], written=written, dealt=early)
        traffic.unpersist()
    elif materialize == "cache":
        df = df.persist(level)
        df.count()
        traffic.unpersist()
    return PreparedTraffic(df, stats, monthly, overall, fill, edges, monthly_rows, overall_rows,
                           stats_rows, tables=written)
