"""Artifacts of a training run: lookup tables, bin edges, scalars, feature
lists, fitted pipelines and their metrics, stored as Parquet tables and
``PipelineModel`` directories.

Every save goes to a new ``version-<n>`` folder whose ``complete`` marker is
written last; loading takes the newest complete version.  A save that is cut
short therefore never replaces or mixes with an earlier one."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import VOLUME_LABELS
from ..functions.phases import PHASE_ORDER
from ..ml.boosting import BoostedModel
from ..ml.least_squares import LinearModel
from ..operators.joins import broadcast_limit
from .schema import CATEGORICAL_FEATURES, NUMERICAL_FEATURES


@dataclass
class Artifacts:
    monthly: DataFrame
    overall: DataFrame
    countries: DataFrame
    global_mean: float
    edges: list[float]
    labels: list[str]
    models: dict[str, PipelineModel | BoostedModel | LinearModel] = field(default_factory=dict)
    metrics: DataFrame | None = None
    monthly_rows: int | None = None
    overall_rows: int | None = None
    countries_rows: int | None = None
    stats: DataFrame | None = None
    stats_rows: int | None = None
    numerical: list[str] = field(default_factory=lambda: list(NUMERICAL_FEATURES))
    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL_FEATURES))
    phases: list[str] = field(default_factory=lambda: list(PHASE_ORDER))

    def stats_small(self) -> bool | None:
        if self.stats is None or self.stats_rows is None:
            return None
        return self.stats_rows <= broadcast_limit(self.stats)

    def countries_small(self) -> bool | None:
        if self.countries_rows is None:
            return None
        return self.countries_rows <= broadcast_limit(self.countries)

    def lookups_small(self) -> tuple[bool | None, bool | None]:
        """Broadcast proofs for the two baseline tables (counted at load)."""
        limit = broadcast_limit(self.monthly)
        return (None if self.monthly_rows is None else self.monthly_rows <= limit,
                None if self.overall_rows is None else self.overall_rows <= limit)


def _slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def save_artifacts(path: str, lookups, models: dict | None = None,
                   metrics: DataFrame | None = None) -> str:
    """Write the lookup and statistics tables of ``lookups`` (a
    PreparedTraffic or Artifacts), the fitted models and the metrics table as
    a new version under ``path``; returns the version's folder."""
    spark = lookups.monthly.sparkSession
    home, path = path, f"{path}/version-{time.time_ns():020d}"
    lookups.monthly.write.mode("overwrite").parquet(f"{path}/baseline_monthly")
    lookups.overall.write.mode("overwrite").parquet(f"{path}/baseline_overall")
    lookups.countries.write.mode("overwrite").parquet(f"{path}/airport_countries")
    if lookups.stats is not None:
        lookups.stats.write.mode("overwrite").parquet(f"{path}/airport_month_stats")
    labels = list(getattr(lookups, "labels", VOLUME_LABELS))
    bins = [(i, float(e), labels[i - 1] if i > 0 else None) for i, e in enumerate(lookups.edges)]
    spark.createDataFrame(bins, "edge_index int, edge double, label string") \
        .write.mode("overwrite").parquet(f"{path}/volume_bins")
    spark.createDataFrame([("overall_pre_pandemic_mean", float(lookups.global_mean))],
                          "name string, value double").write.mode("overwrite").parquet(f"{path}/scalars")
    spark.createDataFrame([(i + 1, p) for i, p in enumerate(PHASE_ORDER)],
                          "phase_rank int, pandemic_phase string") \
        .write.mode("overwrite").parquet(f"{path}/phase_order")
    feats = ([("numerical", i, c) for i, c in enumerate(NUMERICAL_FEATURES)]
             + [("categorical", i, c) for i, c in enumerate(CATEGORICAL_FEATURES)])
    spark.createDataFrame(feats, "kind string, position int, feature string") \
        .write.mode("overwrite").parquet(f"{path}/features")
    names = []
    for name, model in (models or {}).items():
        kind = {BoostedModel: "boosted", LinearModel: "linear"}.get(type(model), "pipeline")
        if kind == "boosted":
            model.save(f"{path}/models/{_slug(name)}")
        elif kind == "linear":
            model.save(f"{path}/models/{_slug(name)}", spark)
        else:
            model.write().overwrite().save(f"{path}/models/{_slug(name)}")
        names.append((name, _slug(name), kind))
    if names:
        spark.createDataFrame(names, "model string, directory string, kind string") \
            .write.mode("overwrite").parquet(f"{path}/model_index")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    spark.createDataFrame([(home,)], "home string").write.parquet(f"{path}/complete")
    return path


def _filesystem(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _filesystem(spark, path)
    return fs.exists(hpath)


def latest_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest complete version under ``path``."""
    fs, hpath = _filesystem(spark, path)
    if not fs.exists(hpath):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(hpath)), reverse=True)
    return next((f"{path}/{n}" for n in names
                 if n.startswith("version-") and _exists(spark, f"{path}/{n}/complete/_SUCCESS")), None)


def load_artifacts(spark: SparkSession, path: str, with_models: bool = True) -> Artifacts:
    """Read the newest complete version ``save_artifacts`` wrote; no such version is a clear error."""
    version = latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(
            f"no training artifacts under {path!r}: run the training job first "
            "(tarmac.plans.training_job)")
    path = version
    monthly = spark.read.parquet(f"{path}/baseline_monthly").persist()
    overall = spark.read.parquet(f"{path}/baseline_overall").persist()
    countries = spark.read.parquet(f"{path}/airport_countries").persist()
    bins = spark.read.parquet(f"{path}/volume_bins").orderBy("edge_index").collect()
    scalars = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/scalars").collect()}
    models, metrics = {}, None
    if with_models and _exists(spark, f"{path}/model_index"):
        for row in spark.read.parquet(f"{path}/model_index").collect():
            load = {"boosted": partial(BoostedModel.load, spark), "linear": partial(LinearModel.load, spark)}.get(
                row.asDict().get("kind"), PipelineModel.load)
            models[row["model"]] = load(f"{path}/models/{row['directory']}")
    if _exists(spark, f"{path}/metrics"):
        metrics = spark.read.parquet(f"{path}/metrics")
    stats = None
    if _exists(spark, f"{path}/airport_month_stats"):
        stats = spark.read.parquet(f"{path}/airport_month_stats")
    features = spark.read.parquet(f"{path}/features").orderBy("kind", "position").collect()
    phases = spark.read.parquet(f"{path}/phase_order").orderBy("phase_rank").collect()
    return Artifacts(
        monthly=monthly, overall=overall, countries=countries,
        global_mean=float(scalars["overall_pre_pandemic_mean"]),
        edges=[float(r["edge"]) for r in bins],
        labels=[r["label"] for r in bins if r["label"] is not None],
        models=models, metrics=metrics,
        monthly_rows=monthly.count(), overall_rows=overall.count(),
        countries_rows=countries.count(),
        stats=stats, stats_rows=None if stats is None else stats.count(),
        numerical=[r["feature"] for r in features if r["kind"] == "numerical"],
        categorical=[r["feature"] for r in features if r["kind"] == "categorical"],
        phases=[r["pandemic_phase"] for r in phases])


def model_metrics(artifacts: Artifacts, model: str) -> DataFrame:
    """The metrics of one model by name (split, scale, metric, value)."""
    if artifacts.metrics is None:
        raise ValueError("the artifacts hold no metrics table")
    return (artifacts.metrics.where(F.col("model") == model)
            .select("split", "scale", "metric", "value"))
