"""Exact weighted quantiles by radix descent, without gathering values anywhere.

A double's 64 bits, with the sign turned so that they order like the numbers, are read ``DIGIT_BITS`` at a time.  One
pass adds up the weights by digit, among the values that share the digits found so far; the digit that holds a
wanted rank is the next one.  A rank is found as soon as its digit holds a single value, after two or three passes on
ordinary data and six at most.  A pass is a partial aggregation with at most 2 ** DIGIT_BITS rows for each
group and prefix, however many values there are, and as much reaches the driver.

Quantiles interpolate linearly between neighbours, as ``percentile`` does.  NULL and NaN values and weights below 1
take no part; -0.0 counts as 0.0; a group without values has no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT_BITS = 12
MAX_GROUPS = 4096
SIGN = -(1 << 63)
DIGITS = [(max(0, 64 - DIGIT_BITS * (k + 1)), min(DIGIT_BITS, 64 - DIGIT_BITS * k)) for k in range(-(-64 // DIGIT_BITS))]


def ordered_bits(x: Column) -> Column:
    """A long that orders like the double ``x`` (as signed numbers)."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(F.bitwise_not(bits).bitwiseOR(F.lit(SIGN)))


def double_of(key: int) -> float:
    """The double of ``ordered_bits``."""
    return struct.unpack(">d", struct.pack(">q", key if key >= 0 else ~(key - SIGN)))[0]


def exact_quantiles(rows: DataFrame, value: Column, probabilities: Sequence[float], weight: Column | None = None,
                    by: str | None = None) -> dict:
    """group -> its quantiles in the order of ``probabilities``; the one group is None without ``by``.

    ``by`` names a column of few distinct values (a level); more than ``MAX_GROUPS`` are an error."""
    x, w = value.cast("double"), (F.lit(1) if weight is None else weight).cast("long")
    group = F.lit(0) if by is None else F.col(by)
    kind = T.IntegerType() if by is None else rows.schema[by].dataType
    keyed = rows.where(x.isNotNull() & ~F.isnan(x) & (w > 0)).select(group.alias("g"), ordered_bits(x).alias("key"), w.alias("w"))
    # the top bit is turned, so that unsigned shifts order the keys
    keyed = keyed.withColumn("u", F.col("key").bitwiseXOR(F.lit(SIGN)))
    totals = keyed.groupBy("g").agg(F.sum("w").alias("w"), F.min("key").alias("low"), F.max("key").alias("high")) \
        .limit(MAX_GROUPS + 1).collect()
    if len(totals) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of {by!r}")
    wanted = {}
    for r in totals:
        for p in probabilities:
            at = (r.w - 1) * p
            wanted[r.g, p] = at
    found = {(r.g, k): r.low if k == 0 else r.high for r in totals for k in (0, r.w - 1)}
    ranks = {(g, k) for (g, _), at in wanted.items() for k in (int(at), -int(-at // 1))} - set(found)
    # (group, prefix) -> the ranks sought there, as (rank of the group, rank among the values of the prefix)
    open_ = {}
    for g, k in ranks:
        open_.setdefault((g, 0), []).append((k, k))
    spark, prefix_schema = rows.sparkSession, T.StructType([T.StructField("at", kind), T.StructField("prefix", T.LongType())])
    for shift, bits in DIGITS:
        if not open_:
            break
        prefix = F.lit(0).cast("long") if shift + bits == 64 else F.shiftrightunsigned("u", shift + bits)
        active = spark.createDataFrame(list(open_), prefix_schema)      # as many rows as ranks, at most
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit((1 << bits) - 1))
        hist = (keyed.withColumn("p", prefix).join(F.broadcast(active), F.col("g").eqNullSafe(F.col("at")) & (F.col("p") == F.col("prefix")))
                .groupBy("g", "p", digit.alias("d")).agg(F.sum("w").alias("w"), F.min("key").alias("low"), F.max("key").alias("high")))
        by_prefix = {}
        for r in hist.collect():
            by_prefix.setdefault((r.g, r.p), []).append((r.d, r.w, r.low, r.high))
        following = {}
        for (g, p), sought in open_.items():
            digits, sought, below = sorted(by_prefix[g, p]), sorted(sought, key=lambda s: s[1]), 0
            for d, n, low, high in digits:
                while sought and sought[0][1] < below + n:
                    k, place = sought.pop(0)
                    if low == high:
                        found[g, k] = low
                    else:
                        following.setdefault((g, p << bits | d), []).append((k, place - below))
                below += n
        open_ = following

    def quantile(g, at: float) -> float:
        lower, higher = int(at), -int(-at // 1)
        a, b = double_of(found[g, lower]), double_of(found[g, higher])
        return a if a == b else (higher - at) * a + (at - lower) * b
    return {(None if by is None else r.g): [quantile(r.g, wanted[r.g, p]) for p in probabilities] for r in totals}
