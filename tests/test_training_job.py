import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from helpers import daily, traffic
from tarmac.ml.scoring import score_requests, scoring_features
from tarmac.operators import explore as X
from tarmac.plans.training_job import run_training
from tarmac.sources.artifacts import load_artifacts, model_metrics
from tarmac.sources.dims import (AIRPORT_COORDINATES, COUNTRY_NAMES, reference_coordinates,
                                 reference_country_labels)
from tarmac.sources.traffic import fixture_traffic


def test_training_job_end_to_end(spark, tmpdir_path):
    out = f"{tmpdir_path}/models"
    run_training(spark, fixture_traffic(spark, SF001), out, gbt_rounds=3)
    art = load_artifacts(spark, out)
    assert set(art.models) == {"Ridge Regression", "Tuned GBT"}
    assert model_metrics(art, "Tuned GBT").count() == 12
    assert len(art.edges) == 5 and art.labels == ["Small", "Medium", "Large", "Very Large"]
    curve = spark.read.parquet(f"{out}/gbt_error_curve")
    assert curve.count() == 3 and curve.where("is_best").count() == 1
    req = spark.createDataFrame([("Supplier#000000001", dt.date(2023, 6, 3)),
                                 ("NOWHERE", dt.date(2024, 2, 29))], "airport string, flt_date date")
    feats = scoring_features(req, art)
    for name in art.models:
        preds = score_requests(art.models[name], feats).collect()
        assert len(preds) == 2 and all(p["predicted_flights"] >= 0 for p in preds)


def test_reference_dimensions(spark):
    coords = reference_coordinates(spark)
    assert coords.count() == len(AIRPORT_COORDINATES) == 37
    labels = reference_country_labels(spark)
    assert labels.count() == 2 * len(COUNTRY_NAMES) == 46
    rows = (daily("EDDF", "Germany", "2019-01-01", 40, lambda d: 1300 + d.day)
            + daily("ZZZZ", "Atlantis", "2019-01-01", 40, lambda d: 10))
    t = traffic(spark, rows)
    from tarmac.operators.baselines import airport_month_stats, baseline_overall
    stats = airport_month_stats(t)
    m = X.airport_map(baseline_overall(stats), coords).collect()
    assert [r["APT_ICAO"] for r in m] == ["EDDF"]           # unknown coordinates dropped
    assert m[0]["lat"] == pytest.approx(50.033333)
    d = {r["APT_ICAO"]: r["label"] for r in X.airport_directory(stats, labels, "fr").collect()}
    assert d == {"EDDF": "EDDF (Allemagne)", "ZZZZ": "ZZZZ (Atlantis)"}  # fallback to the name
    uk = labels.where((F.col("lang") == "en") & (F.col("name") == "United Kingdom")).first()
    assert uk["label"] == "UK"


def test_dashboard_reuses_stored_bins(spark, tmpdir_path):
    from tarmac.plans.prepare import prepare
    out = f"{tmpdir_path}/models"
    run_training(spark, fixture_traffic(spark, SF001), out, gbt_rounds=2)
    art = load_artifacts(spark, out, with_models=False)
    shifted = [e + 0.5 for e in art.edges]            # stored edges win over recomputed ones
    p = prepare(fixture_traffic(spark, SF001), edges=shifted)
    assert p.edges == shifted
    assert prepare(fixture_traffic(spark, SF001), edges=art.edges).edges == art.edges
