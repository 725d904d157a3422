"""Mixing sources to target weights by capped water-filling, DataFrame functions only.

Each source asks for its weight's share of the total; a source that would be repeated more than
``max_epochs`` times is clamped there and its excess is shared by weight among the others, until
nobody is above its cap.  Documents are then taken floor(rate) times, and the fractional rest goes
to the documents with the smallest keyed hash, up to the hash threshold at which the source's words
come nearest to its target.  The threshold is found by radix descent (12 bits of the hash a level,
one partial aggregate each), so no source, however large, is sorted in one task.

Defined results: a NULL text has size 0; a NULL source is a source of its own (last); a source
without words has target 0; an empty table gives an empty result; rows of equal id share one hash
and are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import quoted, written

WORD = r"[^\x20\x09-\x0D]+"
DEFAULT_WEIGHTS = (3, 1, 2)
DEFAULT_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
LEVEL_BITS = 12              # cells of one radix level: 4096 per source
LEVELS = 4                   # 48 hash bits
BROADCAST_SOURCES = 50_000   # rows of about 100 bytes


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``: starts of runs, counted by length differences, no array.

    Every white-space byte becomes a blank, runs collapse, and blanks between words are counted."""
    spaced = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(F.when(spaced == "", F.lit(0)).otherwise(
        F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("bigint")


def keyed_hash(id_col: Column, seed: int = SEED) -> Column:
    """48 bits of md5 over seed and id: equal in every engine and every rerun."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def cyclic_weights(sources: DataFrame, weights: tuple = DEFAULT_WEIGHTS) -> DataFrame:
    """``source, weight``: sources by code point, NULL last, weigh ``weights`` repeating.

    The rank is distributed: a range sort, then one offset per sorted partition."""
    ordered = written(sources.select("source").orderBy(F.col("source").asc_nulls_last())
                      .withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    starts = (ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(
                  W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    return (ordered.withColumn("part", part).join(F.broadcast(starts.select("part", "start")), "part")
            .select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (rank % len(weights)).cast("int") + 1).alias("weight")))


def water_fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) plus ``target``.

    Every round is one aggregate over the source table that returns two scalars: the level is
    raised by what the clamped sources leave over, which can only clamp more, so it ends."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(over, cap)).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("free"),
                          F.sum(over.cast("bigint")).alias("n")).first()
        if got.n == clamped or not got.free:
            break
        clamped, level = got.n, (total - (got.fixed or 0.0)) / got.free
    over = cap <= F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(over, cap).otherwise(F.lit(level) * F.col("weight")))


def with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's row; broadcast only when the source table was
    counted small, else a join whose hot keys adaptive execution splits (``by_source`` is a written
    table, so both sides are plain exchanges)."""
    small = by_source.count() <= BROADCAST_SOURCES
    right = by_source.withColumnRenamed("source", "_source")
    return (rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source")), "left")
            .drop("_source"))


def _thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, threshold``: documents with hash below it are taken once more.

    Level by level the cell is found in which the running sum of words passes ``need``; at the last
    level the cell is one hash value, taken if that brings the sum nearer to ``need``."""
    state = sources.select("source", F.col("need"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        cells = (with_source(rows, state)
                 .where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
                 .groupBy("source", "need", "below", F.shiftright("hash", shift).alias("cell"))
                 .agg(F.sum("size").alias("words")))
        running = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumn("start", F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        # the first cell whose end passes the need; none when all words are needed
        found = (cells.where(F.col("start") + F.col("words") > F.col("need"))
                 .groupBy("source", "need").agg(F.min(F.struct("cell", "start", "words")).alias("c")))
        state = written(found.select("source", "need", F.col("c.cell").alias("prefix"),
                                     F.col("c.start").cast("double").alias("below"), F.col("c.words").alias("words")),
                        "threshold")
    nearer = F.abs(F.col("below") + F.col("words") - F.col("need")) < F.abs(F.col("below") - F.col("need"))
    return state.select("source", (F.col("prefix") + nearer.cast("bigint")).alias("threshold"))


def mix_rates(sized: DataFrame, weights: DataFrame | None = None, share: float = DEFAULT_SHARE,
              max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source_size``, ``target``, ``whole`` copies of every document and the
    hash ``threshold`` below which a document is taken once more.  ``sized``: source, size, hash."""
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weights = cyclic_weights(sizes) if weights is None else weights
    right = weights.select(F.col("source").alias("_source"), "weight")
    sources = written(sizes.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = written(water_fill(sources, share * total, max_epochs).withColumn("whole", F.floor(rate).cast("int"))
                     .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cut = _thresholds(sized, filled).withColumnRenamed("source", "_source")
    return written(filled.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
                   .select("source", "source_size", "target", "whole",
                           F.coalesce("threshold", F.lit(0)).alias("threshold")), "rates")


def _copies() -> Column:
    return F.col("whole") + (F.col("hash") < F.col("threshold")).cast("int")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: int = SEED, **options) -> DataFrame:
    """Per document: id, ``size``, ``source_size``, ``target`` (of its source), ``taken`` words."""
    sized = written(docs.select(quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"),
                                word_count(quoted(text_col)).alias("size"),
                                keyed_hash(quoted(id_col), seed).alias("hash")), "sized")
    return with_source(sized, mix_rates(sized, **options)).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * _copies()).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  seed: int = SEED, **options) -> DataFrame:
    """The mix: every document as often as it is taken, with its columns.  Texts never shuffle; only
    (source, size, hash) is written and aggregated."""
    keyed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                        quoted(source_col).cast("string").alias("source"), keyed_hash(quoted(id_col), seed).alias("hash"))
    sized = written(docs.select(quoted(source_col).cast("string").alias("source"),
                                word_count(quoted(text_col)).alias("size"),
                                keyed_hash(quoted(id_col), seed).alias("hash")), "sized")
    return (with_source(keyed, mix_rates(sized, **options))
            .select("row", F.explode(F.array_repeat(F.lit(True), _copies())).alias("copy")).select("row.*"))
