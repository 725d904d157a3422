"""Pandemic phase of a (year, month), an ordered category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.literal import literal_table

# Phase labels in their natural order (rank 1..9), and the
# label for rows without a year.
PHASE_ORDER = [
    "Pre-Pandemic (2016-2019)",
    "Pandemic Peak Drop (Spring 2020)",
    "Pandemic Initial Recovery (Summer 2020)",
    "Pandemic Second Wave (Fall/Winter 2020)",
    "Pandemic Continued Stagnation (Early 2021)",
    "Pandemic Strong Recovery (Summer 2021)",
    "Pandemic Post-Summer Recovery (Late 2021)",
    "Post-Pandemic Recovery (2022)",
    "Post-Pandemic Normalization (2023+)",
]
OTHER_PHASE = "Other"


def phase(year: Column, month: Column) -> Column:
    """First matching rule wins; 2020 outside spring and summer (January and
    February included) is the second wave; a missing year gives ``Other``."""
    (pre, peak, initial, second, stagnation, strong, late21, rec22, norm) = PHASE_ORDER
    return (F.when(year < 2020, pre)
            .when((year == 2020) & month.between(3, 5), peak)
            .when((year == 2020) & month.between(6, 8), initial)
            .when(year == 2020, second)
            .when((year == 2021) & month.between(1, 4), stagnation)
            .when((year == 2021) & month.between(5, 8), strong)
            .when(year == 2021, late21)
            .when(year == 2022, rec22)
            .when(year >= 2023, norm)
            .otherwise(OTHER_PHASE))


def phase_levels(spark: SparkSession) -> DataFrame:
    """(phase_rank, pandemic_phase) — nine rows, safe to broadcast."""
    return literal_table(spark, [("phase_rank", T.IntegerType()), ("pandemic_phase", T.StringType())],
                         [(i + 1, label) for i, label in enumerate(PHASE_ORDER)])
