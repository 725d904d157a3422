"""Folding rare keys into ``Other`` (top-k by row count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join

OTHER = "Other"


def top_keys_by_rows(stats: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-NULL keys; ties go to the smaller key.

    ``stats`` carries a ``rows`` count per group (see ``airport_month_stats``);
    ``orderBy().limit()`` plans as a top-k, so no full sort or single-task
    window is needed."""
    counts = (stats.where(F.col(key).isNotNull())
              .groupBy(key).agg(F.sum("rows").alias("rows")))
    return counts.orderBy(F.desc("rows"), F.asc(key)).limit(k).select(key)


def fold_column(df: DataFrame, key: str, out: str, top: DataFrame) -> DataFrame:
    """``out`` = ``key`` when it is among ``top``, else ``Other``.

    ``top`` has at most k rows, so it is broadcast without a count."""
    marked = top.select(F.col(key).alias("__fold_key"), F.lit(True).alias("__fold_hit"))
    joined = lookup_join(df, marked, df[key] == marked["__fold_key"], "left",
                         known_small=True)
    return (joined.withColumn(out, F.when(F.col("__fold_hit"), F.col(key)).otherwise(F.lit(OTHER)))
            .drop("__fold_key", "__fold_hit"))


def fold_rare(df: DataFrame, key: str, k: int, out: str | None = None) -> DataFrame:
    """Keep the ``k`` most frequent values of ``key`` (ties: smaller value),
    replace the others and NULL by ``Other``.  Counts are a partial
    aggregation; only the k winners are broadcast back."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return fold_column(df, key, out or key, top_keys_by_rows(counts, key, k))
