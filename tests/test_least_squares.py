import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.ml import least_squares as L
from tarmac.ml import training as TR
from tarmac.plans.prepare import prepare
from tarmac.sources.schema import (CATEGORICAL_FEATURES, EARLIER_CATEGORICAL_FEATURES, EARLIER_NUMERICAL_FEATURES, LOG_TARGET,
                                   NUMERICAL_FEATURES)
from helpers import traffic
from test_ml import planted_rows


@pytest.fixture(scope="module")
def planted(spark):
    return prepare(traffic(spark, planted_rows()), materialize="cache")


def mixed(n=2000, seed=2):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"a": 1e9 + rng.normal(size=n), "b": rng.uniform(size=n), "k": np.full(n, 3.0),
                       "c": rng.choice(["x", "y", "z"], n), "d": rng.choice(["p", "q"], n)})
    df["y"] = 2 * (df.a - 1e9) - df.b + df.c.map({"x": 0.0, "y": 1.0, "z": -2.0}) + 0.1 * rng.normal(size=n)
    return df


def design(df):
    z = df[["a", "b", "k"]].to_numpy()
    s = z.std(axis=0)
    z = (z - z.mean(axis=0)) / np.where(s > 1e-9, s, 1.0)
    hot = [(df[c] == v).to_numpy(float) for c in ("c", "d") for v in sorted(df[c].dropna().unique())]
    return np.column_stack([z, *hot])


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_equal_to_the_closed_form(spark, alpha):
    df = mixed()
    df.loc[::17, "c"] = None
    rows = spark.createDataFrame(df)
    model = L.fit_linear(rows, ["a", "b", "k"], ["c", "d"], "y", alpha)
    x, y = design(df), df.y.to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.lstsq(np.vstack([xc, np.sqrt(alpha) * np.eye(x.shape[1])]), np.r_[yc, np.zeros(x.shape[1])], rcond=1e-9)[0]
    got = model.transform(rows).toPandas()
    np.testing.assert_allclose(got.sort_values("a").prediction, (y.mean() + xc @ w)[np.argsort(df.a.to_numpy(), kind="stable")], atol=1e-6)


def test_missing_unknown_and_too_wide(spark, monkeypatch, tmpdir_path):
    df = mixed(200)
    rows = spark.createDataFrame(df)
    extra = spark.createDataFrame([(None, 0.5, 3.0, "x", "p", 1.0), (1e9, 0.5, 3.0, "x", "p", None),
                                   (1e9, float("nan"), 3.0, "x", "p", 5.0)], rows.schema)
    model = L.fit_linear(rows.unionByName(extra), ["a", "b", "k"], ["c", "d"], "y", 1.0)
    assert model.rows == 200                                     # rows without label or own columns take no part
    odd = model.transform(spark.createDataFrame([(1e9, 0.5, 3.0, "new", None, 0.0), (None, 0.5, 3.0, "x", "p", 0.0)], rows.schema)).collect()
    assert odd[0].prediction is not None and odd[1].prediction is None
    model.save(tmpdir_path, spark)
    again = L.LinearModel.load(spark, tmpdir_path)
    a, b = (m.transform(rows).orderBy("b").toPandas().prediction for m in (model, again))
    assert np.array_equal(a, b)
    with pytest.raises(ValueError, match="no rows"):
        L.fit_linear(rows.limit(0), ["a"], [], "y")
    monkeypatch.setattr(L, "MAX_WIDTH", 4)
    with pytest.raises(ValueError, match="too many"):
        L.fit_linear(rows, ["a"], ["c", "d"], "y")


def test_equal_to_the_ml_pipelines(planted):
    """The same predictions as Spark ML's indexer, encoder and solver.  Without a penalty only on the fitted rows: levels
    unseen in training leave the span of the design, where least squares has no unique answer."""
    for fit, num, cat, alpha in ((TR.fit_ridge, NUMERICAL_FEATURES, CATEGORICAL_FEATURES, 1.0),
                                 (TR.fit_ols, EARLIER_NUMERICAL_FEATURES, EARLIER_CATEGORICAL_FEATURES, 0.0)):
        train, test = TR.splits(planted)
        model = L.fit_linear(train, num, cat, LOG_TARGET, alpha)
        want = fit(planted).model
        for rows in (train, test) if alpha else (train,):
            a, b = (m.transform(rows).orderBy("APT_ICAO", "FLT_DATE").toPandas().prediction.to_numpy() for m in (model, want))
            np.testing.assert_allclose(a, b, atol=1e-6)


def test_correlations_leave_out_nulls_pairwise(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    df["d"] = 1.0
    df.loc[::3, "a"], df.loc[::5, "b"] = np.nan, np.nan
    got = {(r.feature_a, r.feature_b): r.correlation for r in L.correlation_matrix(spark.createDataFrame(df), list("abcd")).collect()}
    want = df.corr()
    assert len(got) == 16 and got["a", "d"] is None and got["d", "d"] is None
    assert all(abs(got[x, y] - want.loc[x, y]) < 1e-9 for x in "abc" for y in "abc")


def test_one_scan_scores_all_models_and_names_are_checked(spark):
    rows = spark.createDataFrame([(i, float(i), "train" if i % 3 else "test") for i in range(60)], "n long, p double, s string") \
        .withColumn("l", F.log1p(F.col("n").cast("double")))
    table = L.scorecard(rows, F.col("s"), {"exact": F.col("l"), "off": F.col("l") + 0.5}, "n", "l")
    got = {(r.model, r.split, r.scale, r.metric): r.value for r in table.collect()}
    assert len(got) == 24 and got["exact", "test", "log_scale", "RMSE"] == 0
    assert all(abs(got["off", s, "log_scale", m] - 0.5) < 1e-12 for s in ("train", "test") for m in ("MAE", "RMSE"))
    assert L.metrics_by_name(table, "off").count() == 12
    with pytest.raises(KeyError, match="exact"):
        L.metrics_by_name(table, "nobody")


def test_standardized_summary(spark):
    rows = spark.createDataFrame([(1.0, 5.0, True), (3.0, 5.0, True), (7.0, 5.0, False)], "x double, k double, t boolean")
    got = {(r.feature, r.split): (r.mean_z, r.std_z) for r in L.standardized_summary(rows, F.col("t"), ["x", "k"]).collect()}
    assert got == {("x", "train"): (0.0, 1.0), ("x", "test"): (5.0, 0.0), ("k", "train"): (0.0, 0.0), ("k", "test"): (0.0, 0.0)}


@pytest.mark.parametrize("alpha", [1.0, 1e-9])
def test_an_absorbed_category_gives_the_fit_of_the_whole_design(spark, alpha, tmpdir_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        apt = int(rng.integers(0, 40))
        rows.append((float(rng.normal(7, 3)), float(apt % 5), None if i % 50 == 0 else f"A{apt}", None if i % 70 == 0 else f"L{apt % 4}",
                     str(rng.integers(1, 8)), float(rng.normal(apt / 9, 1))))
    df = spark.createDataFrame(rows, "u double, v double, apt string, land string, dow string, y double")
    num, cat = ["u", "v"], ["apt", "land", "dow"]
    got = L.fit_absorbed(df, num, cat, "y", alpha, "apt")
    pd = df.toPandas()
    X = np.column_stack([(pd[c] - pd[c].mean()) / pd[c].std(ddof=0) for c in num]
                        + [(pd[c] == v).astype(float) for c in cat for v in sorted(pd[c].dropna().unique())])
    Xc, y = X - X.mean(axis=0), pd.y.to_numpy()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ (y - y.mean()))
    want = X @ w + y.mean() - X.mean(axis=0) @ w
    order = [tuple(r) for r in df.select("u", "y").collect()]
    have = {(r.u, r.y): r.prediction for r in got.transform(df).collect()}
    np.testing.assert_allclose([have[o] for o in order], want, rtol=1e-6, atol=1e-6)
    got.save(f"{tmpdir_path}/m", spark)
    again = {(r.u, r.y): r.prediction for r in L.LinearModel.load(spark, f"{tmpdir_path}/m").transform(df).collect()}
    assert all(abs(again[o] - have[o]) < 1e-9 for o in order)


def test_absorbing_needs_a_penalty(spark):
    with pytest.raises(ValueError, match="penalty"):
        L.fit_absorbed(spark.createDataFrame([(1.0, "a", 1.0)], "u double, c string, y double"), ["u"], ["c"], "y", 0.0, "c")


@pytest.mark.parametrize("fit", [TR.fit_ridge, TR.fit_ols])
def test_a_design_wider_than_the_dense_equations_is_fitted(planted, fit, monkeypatch):
    rows = planted.train()
    want = {(r[0], r[1]): r[2] for r in fit(planted).model.transform(rows).select("APT_ICAO", "FLT_DATE", "prediction").collect()}
    monkeypatch.setattr(TR.P, "NORMAL_SOLVER_MAX_FEATURES", 5)
    fitted = fit(planted)
    assert isinstance(fitted.model, L.LinearModel) and fitted.metrics.count() == 12
    got = {(r[0], r[1]): r[2] for r in fitted.model.transform(rows).select("APT_ICAO", "FLT_DATE", "prediction").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5
