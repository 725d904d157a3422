"""Right-closed interval binning (lowest edge included) into volume labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.literal import literal_table

# Airport size labels, smallest first.
VOLUME_LABELS = ["Small", "Medium", "Large", "Very Large"]


def volume_category(x: Column, edges: Sequence[float],
                    labels: Sequence[str] = VOLUME_LABELS) -> Column:
    """Label of the interval holding ``x``: (e0, e1] with e0 itself included,
    then (e1, e2], ...  Values outside [e0, eN] and NULL give NULL.

    Spark's ``Bucketizer`` is left-closed, so it would put edge values one bin
    higher; this is a ``when`` chain instead."""
    edges = [float(e) for e in edges]
    if len(edges) != len(labels) + 1:
        raise ValueError(
            f"{len(labels)} labels need {len(labels) + 1} distinct bin edges, "
            f"got {len(edges)}: {edges}")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must increase strictly: {edges}")
    expr = F.when(x.isNull() | (x < F.lit(edges[0])) | (x > F.lit(edges[-1])),
                  F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        expr = expr.when(x <= F.lit(edge), F.lit(label))
    return expr


def volume_levels(spark: SparkSession, labels: Sequence[str] = VOLUME_LABELS) -> DataFrame:
    """(volume_rank, airport_volume_category) — four rows, safe to broadcast."""
    return literal_table(spark, [("volume_rank", T.IntegerType()),
                                 ("airport_volume_category", T.StringType())],
                         [(i + 1, label) for i, label in enumerate(labels)])
