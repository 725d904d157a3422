import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from helpers import daily, traffic
from tarmac.ml import training as TR
from tarmac.ml.scoring import forecast_context, score_requests, scoring_features
from tarmac.operators.metrics import metric_table
from tarmac.plans.prepare import prepare
from tarmac.sources.artifacts import load_artifacts, model_metrics, save_artifacts
from tarmac.sources.schema import CATEGORICAL_FEATURES, LOG_TARGET, NUMERICAL_FEATURES

BASE = {"AAA": 20, "BBB": 45, "CCC": 90, "DDD": 160, "EEE": 300, "FFF": 600}


def planted_rows():
    rows = []
    for i, (apt, base) in enumerate(BASE.items()):
        def total(d, base=base):
            weekday = 1.3 if d.weekday() < 5 else 0.6
            season = 1 + 0.25 * math.sin(2 * math.pi * d.month / 12)
            return int(round(base * weekday * season))
        rows += daily(apt, "Land" + str(i % 2), "2018-01-01", 1300, total)
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    return prepare(traffic(spark, planted_rows()), materialize="cache")


@pytest.fixture(scope="module")
def ridge(planted):
    return TR.fit_ridge(planted)


def test_planted_signal_is_learned(ridge):
    m = {(r["split"], r["scale"], r["metric"]): r["value"] for r in ridge.metrics.collect()}
    assert m[("train", "log_scale", "R2")] > 0.95
    assert m[("test", "log_scale", "R2")] > 0.9
    assert m[("train", "log_scale", "RMSE")] < 0.2


def test_ridge_penalty_matches_closed_form(spark, planted, ridge):
    """regParam = alpha * std(y) / n reproduces argmin ||y - Xw - b||^2 + alpha ||w||^2."""
    train = TR.model_rows(planted.train(), NUMERICAL_FEATURES, CATEGORICAL_FEATURES)
    design = PipelineModel(ridge.model.stages[:-1]).transform(train).select("features", LOG_TARGET)
    rows = design.collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r[LOG_TARGET] for r in rows])
    Xc, yc = X - X.mean(axis=0), y - y.mean()
    w = np.linalg.lstsq(Xc.T @ Xc + 1.0 * np.eye(X.shape[1]), Xc.T @ yc, rcond=None)[0]
    b = y.mean() - X.mean(axis=0) @ w
    got = np.array([r["prediction"] for r in ridge.model.transform(train).select("prediction").collect()])
    np.testing.assert_allclose(got, X @ w + b, rtol=1e-6, atol=1e-6)


def test_unknown_levels_encode_as_zeros(spark, planted, ridge):
    req = spark.createDataFrame([("ZZZ", dt.date(2021, 3, 3)), ("AAA", dt.date(2021, 3, 3))],
                                "airport string, flt_date date")
    feats = scoring_features(req, planted)
    enc = PipelineModel(ridge.model.stages[:-1]).transform(feats)
    vecs = {r["APT_ICAO"]: r["APT_ICAO__ohe"] for r in enc.select("APT_ICAO", "APT_ICAO__ohe").collect()}
    assert vecs["ZZZ"].numNonzeros() == 0
    assert vecs["AAA"].numNonzeros() == 1
    assert vecs["ZZZ"].size == len(BASE)  # every known level keeps a slot
    states = {r["APT_ICAO"]: r["STATE_NAME"] for r in feats.collect()}
    assert states["ZZZ"] == "Other" and states["AAA"] == "Land0"


def test_metric_table_by_hand(spark):
    y = [1.0, 4.0, 9.0, 16.0, 0.0]
    p = [1.5, 3.0, 10.0, 15.0, -2.0]
    rows = [("train", float(math.expm1(a)), a, b) for a, b in zip(y, p)]
    df = spark.createDataFrame(rows, "split string, tot double, y double, p double")
    m = {(r["scale"], r["metric"]): r["value"] for r in metric_table(df, "tot", "y", "p").collect()}
    ya, pa = np.array(y), np.array(p)
    assert m[("log_scale", "MAE")] == pytest.approx(np.mean(np.abs(ya - pa)))
    assert m[("log_scale", "RMSE")] == pytest.approx(np.sqrt(np.mean((ya - pa) ** 2)))
    assert m[("log_scale", "R2")] == pytest.approx(1 - np.sum((ya - pa) ** 2) / np.sum((ya - ya.mean()) ** 2))
    yo, po = np.expm1(ya), np.maximum(0, np.expm1(pa))
    assert m[("original_scale", "MAE")] == pytest.approx(np.mean(np.abs(yo - po)))
    assert m[("original_scale", "R2")] == pytest.approx(
        1 - np.sum((yo - po) ** 2) / np.sum((yo - yo.mean()) ** 2), rel=1e-9)


def test_best_round_patience():
    errs = [5, 4, 3, 3.5, 3.6, 3.7, 2.9, 4, 4, 4]
    assert TR.best_round(errs, patience=100) == 6
    assert TR.best_round(errs, patience=3) == 2     # stops at round 6 (index 5) before 2.9
    assert TR.best_round([1.0], patience=3) == 0
    nan = float("nan")
    assert TR.best_round([nan, nan, nan]) == 2               # no validation rows: keep all
    assert TR.best_round([nan, 2.0, 1.0, 3.0]) == 2


def test_gbt_curve_and_refit(planted):
    fitted, curve = TR.fit_gbt(planted, max_iter=6, max_depth=3)
    rows = curve.orderBy("iteration").collect()
    assert [r["iteration"] for r in rows] == list(range(1, 7))
    assert sum(r["is_best"] for r in rows) == 1
    best = [r["iteration"] for r in rows if r["is_best"]][0]
    assert fitted.model.stages[-1].getNumTrees == best
    m = {(r["split"], r["scale"], r["metric"]) for r in fitted.metrics.collect()}
    assert len(m) == 12


def test_scoring_is_non_negative_and_round_trips(spark, planted, ridge, tmpdir_path):
    req = spark.createDataFrame(
        [(a, dt.date(2023, 6, d)) for a in list(BASE) + ["NEW1"] for d in (1, 3, 5)],
        "airport string, flt_date date")
    feats = scoring_features(req, planted)
    before = {(r[0], r[1]): r[3] for r in score_requests(ridge.model, feats).collect()}
    assert all(v >= 0 for v in before.values())
    path = f"{tmpdir_path}/artifacts"
    save_artifacts(path, planted, {ridge.name: ridge.model}, ridge.metrics)
    art = load_artifacts(spark, path)
    assert art.edges == pytest.approx(planted.edges)
    assert art.global_mean == pytest.approx(planted.global_mean)
    feats2 = scoring_features(req, art)
    after = {(r[0], r[1]): r[3] for r in score_requests(art.models[ridge.name], feats2).collect()}
    assert after.keys() == before.keys()
    for k in before:
        assert after[k] == pytest.approx(before[k], rel=1e-9)
    assert model_metrics(art, ridge.name).count() == 12
    assert art.numerical == NUMERICAL_FEATURES and art.categorical == CATEGORICAL_FEATURES
    wide = {(r["APT_ICAO"], r["FLT_DATE"]): r["avg_pre_pandemic_monthly_traffic"]
            for r in scoring_features(req, planted, scope="all").collect()}
    for r in scoring_features(req, art, scope="all").collect():
        assert r["avg_pre_pandemic_monthly_traffic"] == pytest.approx(wide[(r["APT_ICAO"], r["FLT_DATE"])])
    # a save that never finished is not loaded
    spark.range(1).write.parquet(f"{path}/version-99999999999999999999/scalars")
    assert load_artifacts(spark, path, with_models=False).edges == art.edges
    ctx = {r["APT_ICAO"]: r for r in forecast_context(req, art).collect()}
    assert ctx["NEW1"]["historical_avg"] is None and ctx["AAA"]["month_name"] == "June"


def test_forecast_by_model_name(spark, planted, ridge):
    from tarmac.ml.scoring import forecast
    req = spark.createDataFrame([("AAA", dt.date(2023, 6, 1)), ("NEW1", dt.date(2023, 6, 1))],
                                "airport string, flt_date date")
    rows = forecast(req, planted, {"a": ridge.model, "b": ridge.model}).collect()
    assert sorted((r["model"], r["APT_ICAO"]) for r in rows) == [("a", "AAA"), ("a", "NEW1"), ("b", "AAA"), ("b", "NEW1")]
    want = {r["APT_ICAO"]: r["predicted_flights"]
            for r in score_requests(ridge.model, scoring_features(req, planted)).collect()}
    context = {r["APT_ICAO"]: r["historical_avg"] for r in forecast_context(req, planted).collect()}
    for r in rows:
        assert r["predicted_flights"] == pytest.approx(want[r["APT_ICAO"]])
        assert r["historical_avg"] == context[r["APT_ICAO"]] and r["month_name"] == "June"
    with pytest.raises(ValueError):
        forecast(req, planted, {})


def test_missing_artifacts_is_clear_error(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError, match="training job"):
        load_artifacts(spark, f"{tmpdir_path}/nothing-here")


def test_scoring_all_year_scope(spark, planted):
    req = spark.createDataFrame([("AAA", dt.date(2023, 6, 1))], "airport string, flt_date date")
    pre = scoring_features(req, planted).first()
    allyears = scoring_features(req, planted, scope="all").first()
    want = (planted.features.where((F.col("APT_ICAO") == "AAA") & (F.col("MONTH_NUM") == 6))
            .agg(F.avg("FLT_TOT_1")).first()[0])
    assert allyears["avg_pre_pandemic_monthly_traffic"] == pytest.approx(want)
    assert pre["avg_pre_pandemic_monthly_traffic"] != pytest.approx(want)
    with pytest.raises(ValueError):
        scoring_features(req, planted, scope="future")


def test_gbt_can_watch_the_test_split(planted):
    fitted, curve = TR.fit_gbt(planted, max_iter=3, max_depth=2, validation="test")
    assert curve.count() == 3 and fitted.metrics.count() == 12
    with pytest.raises(ValueError):
        TR.fit_gbt(planted, max_iter=2, validation="nothing")


def test_standardizer_uses_population_deviation(spark, planted, ridge):
    train = TR.model_rows(planted.train(), NUMERICAL_FEATURES, CATEGORICAL_FEATURES)
    out = ridge.model.stages[0].transform(train)
    for c in ["YEAR", "day_of_month", "avg_traffic_pre_pandemic_overall"]:
        r = out.agg(F.avg(f"{c}__z").alias("m"), F.stddev_pop(f"{c}__z").alias("s")).first()
        assert r["m"] == pytest.approx(0.0, abs=1e-9)
        assert r["s"] == pytest.approx(1.0, rel=1e-9)


def test_the_solver_never_follows_the_width_of_the_design(spark):
    from tarmac.ml import pipelines as P
    assert P.ridge_pipeline(0.1, n_features=4096).getStages()[-1].getSolver() == "normal"
    for make in (P.ols_pipeline, lambda **k: P.ridge_pipeline(0.1, **k)):
        with pytest.raises(ValueError, match="l-bfgs"):
            make(n_features=4097)
        assert make(n_features=4097, solver="l-bfgs").getStages()[-1].getSolver() == "l-bfgs"
        with pytest.raises(ValueError, match="solver"):
            make(n_features=10, solver="other")


@pytest.mark.parametrize("fit", [TR.fit_ridge, TR.fit_ols])
def test_both_solvers_give_the_same_predictions(planted, fit):
    rows = planted.train()
    got = []
    for solver in ("normal", "l-bfgs"):
        scored = fit(planted, solver=solver).model.transform(rows)
        got.append({(r[0], r[1]): r[2] for r in scored.select("APT_ICAO", "FLT_DATE", "prediction").collect()})
    assert got[0].keys() == got[1].keys()
    assert max(abs(got[0][k] - got[1][k]) for k in got[0]) < 1e-6


def test_ols_matches_least_squares_on_the_fixture(spark):
    """OLS on the earlier feature set equals numpy's least squares on the
    same (collinear) design: predictions are unique even if weights are not."""
    from conftest import SF001
    from tarmac.plans.prepare import PreparedTraffic
    from tarmac.sources.schema import EARLIER_CATEGORICAL_FEATURES, EARLIER_NUMERICAL_FEATURES
    p = PreparedTraffic.cached(spark, SF001)
    fitted = TR.fit_ols(p)
    train = TR.model_rows(p.train(), EARLIER_NUMERICAL_FEATURES, EARLIER_CATEGORICAL_FEATURES)
    scored = fitted.model.transform(train).select("features", LOG_TARGET, "prediction").collect()
    X = np.array([r["features"].toArray() for r in scored])
    X1 = np.hstack([X, np.ones((X.shape[0], 1))])
    y = np.array([r[LOG_TARGET] for r in scored])
    w = np.linalg.lstsq(X1, y, rcond=None)[0]
    np.testing.assert_allclose([r["prediction"] for r in scored], X1 @ w, rtol=1e-6, atol=1e-6)


def test_malformed_requests_go_to_the_error_table(spark, planted, ridge):
    from tarmac.ml.scoring import validate_requests
    req = spark.createDataFrame(
        [("AAA", "2023-06-01"), (None, "2023-06-01"), ("  ", "2023-06-01"),
         ("BBB", None), ("CCC", "not a date"), (" DDD ", "2024-02-29")],
        "airport string, flt_date string")
    valid, errors = validate_requests(req)
    assert sorted(r["airport"] for r in valid.collect()) == ["AAA", "DDD"]
    reasons = sorted(r["error"] for r in errors.collect())
    assert reasons == ["invalid date", "missing airport", "missing airport", "missing date"]
    preds = score_requests(ridge.model, scoring_features(valid, planted)).collect()
    assert len(preds) == 2


def test_fit_and_score_any_pipeline(planted):
    from pyspark.ml.regression import DecisionTreeRegressor
    from tarmac.ml import pipelines as P
    train, test = TR.splits(planted, NUMERICAL_FEATURES, CATEGORICAL_FEATURES)
    indexer, counts = P.fit_indexer(train, CATEGORICAL_FEATURES)
    from pyspark.ml import Pipeline
    tree = DecisionTreeRegressor(labelCol=LOG_TARGET, maxDepth=6, maxBins=64)
    pipe = Pipeline(stages=P.tree_stages(NUMERICAL_FEATURES, CATEGORICAL_FEATURES, indexer) + [tree])
    fitted = TR.fit_and_score(pipe, "tree", train, test)
    m = {(r["split"], r["scale"], r["metric"]): r["value"] for r in fitted.metrics.collect()}
    assert m[("train", "log_scale", "R2")] > 0.9 and len(m) == 12


def test_gbt_without_validation_rows_keeps_every_round(spark):
    rows = []
    for i, base in enumerate([20, 45, 90, 160, 300, 600]):
        rows += daily(f"A{i}", f"L{i % 2}", "2018-01-01", 900, lambda d, b=base: b + d.day % 7)
    p = prepare(traffic(spark, rows), materialize="cache")   # ends mid-2020: no holdout, no test
    fitted, curve = TR.fit_gbt(p, max_iter=3, max_depth=2)
    assert fitted.model.stages[-1].getNumTrees == 3
    assert [r["is_best"] for r in curve.orderBy("iteration").collect()] == [False, False, True]
    assert fitted.metrics.where("split = 'test'").count() == 0


def test_registry_entries_follow_the_object_not_its_id(planted):
    import weakref
    a = TR.ModelRegistry.get(planted, "Ridge Regression")
    assert TR.ModelRegistry.get(planted, "Ridge Regression") is a   # cached for the same object
    key = (id(planted), "Ridge Regression")
    ref, fitted = TR.ModelRegistry._fitted[key]
    TR.ModelRegistry._fitted[key] = (weakref.ref(TR), fitted)       # simulate a reused id
    b = TR.ModelRegistry.get(planted, "Ridge Regression")
    assert b is not fitted                                            # refitted, not reused


def test_trees_take_a_wide_category_by_its_level_means(spark, planted, monkeypatch):
    from tarmac.ml import pipelines as P
    assert P.tree_bins({"a": 6, "b": 40}) == (41, []) and P.tree_bins({"a": 6, "b": 60_000}) == (P.WIDE_BINS, ["b"])
    monkeypatch.setattr(P, "TREE_MAX_LEVELS", 5)
    fitted, curve = TR.fit_gbt(planted, max_iter=3, max_depth=3)
    assert fitted.model.stages[-1].getMaxBins() == P.WIDE_BINS and curve.count() == 3 and fitted.metrics.count() == 12
    req = spark.createDataFrame([("ZZZ", dt.date(2021, 3, 3)), ("AAA", dt.date(2021, 3, 3)), ("FFF", dt.date(2021, 3, 3))],
                                "airport string, flt_date date")
    scored = fitted.model.transform(scoring_features(req, planted))
    kinds = scored.schema["features"].metadata["ml_attr"]["attrs"]
    assert "APT_ICAO__mean" in [a["name"] for a in kinds["numeric"]] and "STATE_NAME__idx" in [a["name"] for a in kinds["nominal"]]
    rows = {r["APT_ICAO"]: r for r in scored.collect()}
    assert rows["AAA"]["APT_ICAO__mean"] < rows["ZZZ"]["APT_ICAO__mean"] < rows["FFF"]["APT_ICAO__mean"]
    assert rows["AAA"]["prediction"] < rows["FFF"]["prediction"]
