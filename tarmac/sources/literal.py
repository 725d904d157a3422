"""Small constant tables built inside the JVM.

``spark.createDataFrame`` from Python rows pays a one-time serialization
start-up of about a second; the level tables and fixed dimensions are instead
a one-partition ``range`` whose columns pick their value from a literal array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, fields: Sequence[tuple[str, T.DataType]],
                  rows: Sequence[Sequence]) -> DataFrame:
    """A DataFrame with the given (name, type) columns and rows."""
    rows = list(rows)
    position = (F.col("id") + 1).cast("int")
    cols = []
    for j, (name, dtype) in enumerate(fields):
        if rows:
            values = F.array(*[F.lit(r[j]).cast(dtype) for r in rows])
            cols.append(F.element_at(values, position).alias(name))
        else:
            cols.append(F.lit(None).cast(dtype).alias(name))
    return spark.range(0, len(rows), 1, 1).select(*cols)
