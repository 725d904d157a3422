"""Randomized checks in bulk: one Spark job per property, many values each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.functions import volume_category
from tarmac.functions.labels import with_compact
from tarmac.operators.bins import volume_bin_table

RNG = np.random.default_rng(42)


def test_binning_matches_interval_cut(spark):
    for trial in range(5):
        edges = np.sort(RNG.choice(np.arange(0, 200), size=5, replace=False)).astype(float)
        # values on every edge, between edges and outside the range
        values = np.concatenate([edges, RNG.uniform(edges[0] - 20, edges[-1] + 20, 400)])
        labels = ["Small", "Medium", "Large", "Very Large"]
        want = pd.cut(values, bins=edges, labels=labels, include_lowest=True, right=True)
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = [r[0] for r in df.select(volume_category(F.col("x"), list(edges))).collect()]
        assert got == [None if pd.isna(w) else str(w) for w in want]


def test_weighted_percentile_equals_row_quantiles(spark):
    values = RNG.normal(100, 30, 60).round(3)
    weights = RNG.integers(1, 50, 60)
    rows = np.repeat(values, weights)
    want = np.quantile(rows, [0, 0.25, 0.5, 0.75, 1.0])   # linear interpolation, as pandas
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights)],
                               "value double, weight bigint")
    got = [r["edge"] for r in volume_bin_table(df).orderBy("edge_index").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_compact_matches_python_in_bulk(spark):
    ns = np.concatenate([RNG.integers(-3_000_000, 3_000_000, 3000),
                         np.arange(0, 200_000, 50), [999, 1000, 999_999, 1_000_000]])
    df = spark.createDataFrame([(int(n),) for n in ns], "n bigint")
    got = [r["t"] for r in with_compact(df, "n", "t").collect()]

    def py(v):
        return f"{v / 1e6:.1f}M" if abs(v) >= 1e6 else f"{v / 1e3:.1f}K" if abs(v) >= 1e3 else str(v)
    assert got == [py(int(n)) for n in ns]


@pytest.mark.parametrize("seed", [1, 2])
def test_pareto_properties_random(spark, seed):
    from helpers import daily, traffic
    from tarmac.operators.summary import kpi_totals, pareto_airports
    from tarmac.plans.prepare import prepare
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(25):
        level = int(rng.integers(5, 500))
        rows += daily(f"X{i:02d}", f"S{i % 4}", "2019-06-01", 40, lambda d, lv=level: lv + d.day % 3)
        rows += daily(f"X{i:02d}", f"S{i % 4}", "2022-01-01", 20, lambda d, lv=level: lv // 2 + d.day)
    f = prepare(traffic(spark, rows)).features
    p = pareto_airports(f, "2022-01-01", "2022-01-20", fold=False).collect()
    total = kpi_totals(f, "2022-01-01", "2022-01-20").first()["total_ops"]
    running = 0
    for r in p:
        running += r["total"]
        assert r["cumulative_pct"] == pytest.approx(running / total * 100)
    assert len(p) == 10


def test_fixed1_matches_python_formatting(spark):
    from tarmac.functions.labels import with_fixed1, with_signed_percent
    tenths = RNG.integers(-10**7, 10**7, 20000)
    values = np.concatenate([
        tenths / 10 + 0.05,                       # decimal ties, mostly inexact in binary
        RNG.integers(0, 4000, 2000) / 4,          # exact binary ties (.25, .75)
        RNG.uniform(-1e6, 1e6, 20000),
        RNG.normal(0, 1, 5000),
        RNG.integers(-10**9, 10**9, 5000) / 1e3,  # the K labels
        RNG.integers(-10**12, 10**12, 5000) / 1e6,  # the M labels
        [0.0, -0.0, 0.04, -0.04, 0.05, -0.05, 0.15, 0.25, 0.35, 2.675, 1e-300, 123456789.95],
    ])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = with_signed_percent(with_fixed1(df, [("x", "a", False)]), "x", "b").collect()
    for v, r in zip(values, got):
        assert r["a"] == f"{v:.1f}", v
        assert r["b"] == f"{v:+.1f}%", v
