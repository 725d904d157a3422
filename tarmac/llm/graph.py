"""Connected components of a distributed edge list by alternating large and small stars.

Every round rewires edges towards the smallest neighbour; the result is one star per component.
Minima are partial aggregates; the tables joined are written, so that both sides of a join are
plain exchanges and adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _fingerprint(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node with an edge; the root is the component's smallest node.
    Loops, repeated edges and NULL ends are ignored."""
    edges = written(edges.where(F.col(u) != F.col(v))
                    .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    state = _fingerprint(edges)
    while state[0]:
        # large star: larger neighbours of v go to v's smallest neighbour (v itself at a local minimum)
        lowest = written(edges.groupBy("u").agg(F.min("v").alias("low")), "low").withColumnRenamed("u", "at")
        large = written(edges.join(lowest, edges["v"] == lowest["at"], "left")
                        .select("u", F.coalesce("low", "v").alias("v")).distinct(), "large")
        # small star: u and all its smaller neighbours go to the smallest of them
        lowest = written(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        joined = large.join(lowest.withColumnRenamed("u", "at"), F.col("u") == F.col("at")) \
            .where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(joined.unionByName(lowest.withColumnRenamed("low", "v")).distinct(), "edges")
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
