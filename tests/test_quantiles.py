import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.operators import explore as X
from tarmac.operators import quantiles as Q
from tarmac.operators.bins import volume_bin_table

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def values(kind, n, rng):
    return {"means": lambda: rng.uniform(1, 2000, n), "signs": lambda: rng.normal(size=n),
            "scales": lambda: np.exp(rng.normal(0, 100, n)) * rng.choice([-1, 1], n),
            "neighbours": lambda: 1.0 + np.arange(n) * 2.0 ** -52, "ties": lambda: rng.integers(0, 3, n).astype(float)}[kind]()


@pytest.mark.parametrize("kind", ["means", "signs", "scales", "neighbours", "ties"])
def test_equal_to_numpy_by_group(spark, kind):
    rng = np.random.default_rng(7)
    x, g = values(kind, 5000, rng), rng.choice(["a", "b", "c"], 5000, p=[0.9, 0.0998, 0.0002])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g}))
    got = Q.exact_quantiles(df, F.col("x"), PROBABILITIES, by="g")
    assert set(got) == set(g)
    for name in got:
        np.testing.assert_allclose(got[name], np.quantile(x[g == name], PROBABILITIES), rtol=1e-13)


def test_200_000_distinct_means_with_weights(spark):
    rng = np.random.default_rng(8)
    x, w = rng.uniform(1, 2000, 200_000), rng.integers(1, 6, 200_000)
    df = spark.createDataFrame(pd.DataFrame({"APT_ICAO": np.arange(200_000).astype(str), "value": x, "weight": w}))
    got = [r["edge"] for r in volume_bin_table(df).orderBy("edge_index").collect()]
    np.testing.assert_allclose(got, pd.Series(np.repeat(x, w)).quantile([0, 0.25, 0.5, 0.75, 1]).to_numpy(), rtol=1e-13)


def test_defined_edges(spark):
    rows = [(None, 1, "g"), (float("nan"), 1, "g"), (5.0, 0, "g"), (-0.0, 2, "h"), (0.0, 1, "h"), (7.0, 1, None), (9.0, None, "h"),
            (float("-inf"), 1, "i"), (float("inf"), 1, "i"), (-1e-320, 1, "i")]
    df = spark.createDataFrame(rows, "x double, w int, g string")
    got = Q.exact_quantiles(df, F.col("x"), [0.0, 0.5, 1.0], weight=F.col("w"), by="g")
    assert got == {"h": [0.0, 0.0, 0.0], None: [7.0, 7.0, 7.0], "i": [-math.inf, -1e-320, math.inf]}
    assert Q.exact_quantiles(df.limit(0), F.col("x"), [0.5]) == {}
    assert [r["edge"] for r in volume_bin_table(spark.createDataFrame([], "APT_ICAO string, value double, weight long")).collect()] == [None] * 5
    dates = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 1, 2), 2.0)], "d date, x double")
    assert Q.exact_quantiles(dates, F.col("x"), [1.0], by="d")[dt.date(2020, 1, 2)] == [2.0]


def test_too_many_groups_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_GROUPS", 3)
    with pytest.raises(ValueError, match="groups"):
        Q.exact_quantiles(spark.range(10).withColumn("x", F.lit(1.0)), F.col("x"), [0.5], by="id")


def test_no_percentile_and_bounded_passes(spark, monkeypatch):
    """No plan of a pass gathers values: every aggregate is a partial one over digits."""
    plans = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: plans.append(self._jdf.queryExecution().toString()) or collect(self))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(1, 100, 3000)})).withColumn("day_of_week", F.lit(1))
    Q.exact_quantiles(df, F.col("x"), [0.25, 0.5])
    X._spread(df.withColumnRenamed("x", "FLT_TOT_1_log"), "day_of_week")
    assert 3 <= len(plans) <= 9
    assert not any("percentile" in p.lower() or "collect_list" in p for p in plans) and all("partial_" in p for p in plans)
