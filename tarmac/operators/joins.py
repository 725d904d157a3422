"""Lookup joins whose broadcast side is checked, not assumed, to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension tables with at most this many rows are broadcast (a few tens of
# MB for the narrow lookup tables used here).  Override per session with
# ``spark.conf.set("tarmac.broadcast.maxRows", ...)``.
DEFAULT_BROADCAST_MAX_ROWS = 2_000_000


def broadcast_limit(df: DataFrame) -> int:
    value = df.sparkSession.conf.get("tarmac.broadcast.maxRows", None)
    return int(value) if value else DEFAULT_BROADCAST_MAX_ROWS


def fits_broadcast(dim: DataFrame, max_rows: int | None = None) -> bool:
    """True when ``dim`` has at most ``max_rows`` rows.

    Counts at most ``max_rows + 1`` rows, so the check stops early on a large
    table.  Call it on a persisted or cheaply computed table: the rows it
    reads are the ones the join will read again."""
    limit = broadcast_limit(dim) if max_rows is None else max_rows
    return dim.limit(limit + 1).count() <= limit


def lookup_join(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                max_rows: int | None = None, known_small: bool = False,
                small: bool | None = None) -> DataFrame:
    """Join ``fact`` with a lookup table.

    The lookup side is broadcast when its size is proven: ``known_small`` (a
    literal level table or a top-k result), ``small`` (the result of a count
    made by the caller) or, when neither is given, a row count under the
    limit.  Beyond the limit the join is left to the planner (sort-merge with
    AQE skew handling), so nothing large is broadcast."""
    if small is None:
        small = known_small or fits_broadcast(dim, max_rows)
    if small:
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)
