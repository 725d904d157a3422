"""Quartile edges of the airport baseline, weighted by rows.

The original takes quantiles over the per-row column, so every airport
counts once per day it reports.  The same edges come from the airport table
with the row count as the weight, by radix descent (``quantiles``): no task
holds the means of all airports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import VOLUME_LABELS
from ..sources.literal import literal_table
from .quantiles import exact_quantiles

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def weighted_airport_values(stats: DataFrame, fill: float) -> DataFrame:
    """(APT_ICAO, value, weight): the filled overall baseline of each airport
    (the NULL airport included, it takes the fallback) and its number of rows.

    One aggregation of the statistics table gives both; the mean is the same
    integer sum over the same count as ``baseline_overall``."""
    pre = F.col("pre_rows") > 0
    per_airport = stats.groupBy("APT_ICAO").agg(
        F.sum("rows").alias("weight"),
        F.sum(F.when(pre, F.col("pre_sum"))).alias("s"),
        F.sum(F.when(pre, F.col("pre_count"))).alias("c"))
    mean = F.when(F.col("APT_ICAO").isNotNull() & (F.col("c") > 0), F.col("s") / F.col("c"))
    return per_airport.select("APT_ICAO", F.coalesce(mean, F.lit(float(fill))).alias("value"),
                              "weight")


def volume_bin_table(weighted: DataFrame, probabilities=QUARTILES) -> DataFrame:
    """One row per requested probability: (edge_index, probability, edge); NULL edges without values."""
    edges = exact_quantiles(weighted, F.col("value"), probabilities, weight=F.col("weight")).get(None)
    rows = [(i, float(p), None if edges is None else edges[i]) for i, p in enumerate(probabilities)]
    return literal_table(weighted.sparkSession, [("edge_index", T.IntegerType()), ("probability", T.DoubleType()),
                                                 ("edge", T.DoubleType())], rows)


def volume_bins(weighted: DataFrame, labels=VOLUME_LABELS) -> list[float]:
    """The distinct quartile edges (five numbers, collected to the driver).

    Equal edges are dropped as the reference did; fewer than
    ``len(labels) + 1`` edges cannot carry the labels, which is an error."""
    table = volume_bin_table(weighted).orderBy("edge_index").collect()
    if not table or any(r["edge"] is None for r in table):
        raise ValueError("no baseline values to bin")
    edges = sorted({float(r["edge"]) for r in table})
    if len(edges) != len(labels) + 1:
        raise ValueError(
            f"the quartile edges {edges} have duplicates: {len(edges) - 1} bins "
            f"cannot hold the {len(labels)} labels {list(labels)}")
    return edges
