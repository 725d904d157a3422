"""Target transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_target(total: Column) -> Column:
    """log(1 + flights); counts are cast to double first."""
    return F.log1p(total.cast("double"))


def inverse_log(prediction: Column) -> Column:
    return F.expm1(prediction)


def clip_at_zero(x: Column) -> Column:
    """max(0, x), NULL stays NULL."""
    return F.when(x.isNull(), x).otherwise(F.greatest(F.lit(0.0), x))
