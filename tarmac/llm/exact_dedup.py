"""Exact duplicates by two-pass Bloom filtering, DataFrame functions only.

Pass 1 sets, for every row, ``HASHES`` positions of a bit space and counts the rows that hit a
position (partial aggregation first, so a hot text is one row per task).  Positions hit twice or
more make the filter, stored as 32768-bit bitmaps.  Pass 2 probes it: a row of which some position
was hit once is certainly alone and passes straight through; only possibly repeated rows shuffle,
where the SHA-256 of the whole text decides exactly.  The filter is built in slices of the hash
space, each of at most ``SLICE_BITS`` bits (32 MB, proven bound of what is broadcast), so its density
stays the same at any size; beyond one slice the digests (not the texts) are laid out by slice.

Defined results: a NULL text counts as empty; rows equal in (id, text) are one winner and dropped
repeats; a NULL id is smaller than every id; an empty table gives an empty result; other columns
are carried untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, scratch_path, written

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

HASHES = 2
BITS_PER_ROW = 16
SLICE_BITS = 1 << 28
RANGE_BLOCKS = 8192          # bitmaps of 4 KB broadcast together when the rows that go are taken out
BITMAP_BITS = 32768          # fixed by bitmap_bit_position / bitmap_bucket_number


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; for a text of ASCII alone ``lower`` is the same and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def slice_count(rows: int, bits_per_row: int = BITS_PER_ROW, slice_bits: int = SLICE_BITS) -> int:
    """Slices of the hash space so that each filter slice keeps ``bits_per_row`` within its bound."""
    return max(1, -(-rows * bits_per_row // slice_bits))


def _positions(digest: Column, bits: int, hashes: int) -> Column:
    """``hashes`` bit positions from disjoint parts of the digest's hex text."""
    return F.array(*[F.pmod(F.conv(F.substring(digest, 16 + 12 * i, 12), 16, 10).cast("bigint"), F.lit(bits)) + 1
                     for i in range(hashes)])


def possibly_repeated(rows: DataFrame, digest: str, n_rows: int, bits_per_row: int = BITS_PER_ROW,
                      hashes: int = HASHES, slice_bits: int = SLICE_BITS) -> DataFrame:
    """``rows`` plus ``maybe_repeated``: false only for rows whose digest occurs once.

    ``rows`` are narrow (digests and ids, no texts).  With more than one slice they are laid out by
    slice once, and each slice's job reads its own files only, so the work is linear in the rows."""
    n_slices = slice_count(n_rows, bits_per_row, slice_bits)
    bits = max(BITMAP_BITS, min(slice_bits, n_rows * bits_per_row))
    if n_slices == 1:
        return _probed(rows, digest, bits, hashes)
    spark = rows.sparkSession
    slice_of = F.pmod(F.conv(F.substring(F.col(digest), 1, 12), 16, 10).cast("bigint"), F.lit(n_slices))
    laid_out, verdicts = scratch_path(spark, "slices"), scratch_path(spark, "verdicts")
    # rebalance keeps a slice together and lets adaptive execution split a hot one
    rows.withColumn("_slice", slice_of).hint("rebalance", "_slice").write.partitionBy("_slice").parquet(laid_out)
    sliced = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(laid_out)
    for k in range(n_slices):       # a filter on the partition column: the other slices' files are not read
        part = sliced.where(F.col("_slice") == k).drop("_slice")
        _probed(part, digest, bits, hashes).write.mode("append").parquet(verdicts)
    return spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("maybe_repeated", T.BooleanType())])).parquet(verdicts)


def _probed(part: DataFrame, digest: str, bits: int, hashes: int) -> DataFrame:
    """One slice: its filter of positions hit twice or more, probed by its rows."""
    hits = (part.select(F.explode(_positions(F.col(digest), bits, hashes)).alias("pos"))
            .groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    filter_ = _bitmaps(hits)
    probed = part.withColumn("_pos", _positions(F.col(digest), bits, hashes)).withColumn("maybe_repeated", F.lit(True))
    for i in range(hashes):     # at most bits / 8 bytes of bitmaps: a proven broadcast size
        probed = (probed.withColumn("_bucket", F.call_function("bitmap_bucket_number", F.col("_pos")[i]))
                  .join(F.broadcast(filter_), "_bucket", "left")
                  .withColumn("maybe_repeated", F.col("maybe_repeated") & F.coalesce(_bit(F.col("_pos")[i]), F.lit(False)))
                  .drop("_bucket", "_bits"))
    return probed.drop("_pos")


def _bitmaps(positions: DataFrame) -> DataFrame:
    """(_bucket, _bits): the bitmaps that hold the column ``pos``."""
    return (positions.groupBy(F.expr("bitmap_bucket_number(pos)").alias("_bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(pos))").alias("_bits")))


def _bit(pos: Column) -> Column:
    """The bit of ``pos`` in its bucket's bitmap ``_bits`` (NULL without a bitmap)."""
    offset = F.call_function("bitmap_bit_position", pos)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (offset / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), (offset % 8).cast("int")) == 1


def _sha256(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _decided(hashed: DataFrame, **filter_options) -> DataFrame:
    """``hashed`` (written; id, text_sha256, tag) plus ``keep_id``, ``group_size``, ``kept``."""
    probed = possibly_repeated(hashed, "text_sha256", hashed.count(), **filter_options)
    alone = probed.where(~F.col("maybe_repeated")).select(
        "id", "tag", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = probed.where("maybe_repeated")
    # written, so that both join sides are plain exchanges and a hot group is split at run time
    groups = written(maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"),
                                                      F.max(F.struct("id", "tag")).alias("keep")), "groups")
    return alone.unionByName(maybe.join(groups, "text_sha256").select(
        "id", "tag", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("tag") == F.col("keep.tag")).alias("kept"), "text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with equal normalised text the one with the largest id stays (of rows that share that
    id too, one)."""
    hashed = written(docs.select(quoted(id_col).alias("id"), _sha256(quoted(text_col)).alias("text_sha256"),
                                 F.monotonically_increasing_id().alias("tag")), "digests")
    return (_decided(hashed, **filter_options)
            .select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          range_blocks: int = RANGE_BLOCKS, **filter_options) -> DataFrame:
    """The documents that stay, with their columns.

    Texts are hashed once and written with a running tag; the decisions are taken on the narrow
    columns.  The tags of the rows that go become bitmaps of 4 KB, one for 32768 tags in a row, and
    the written rows probe them.  Tags ascend in every written file, so ranges of tags of about
    ``range_blocks`` bitmaps each (the broadcast bound) read each their own files, and no text shuffles."""
    rows = written(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("id"),
                               _sha256(quoted(text_col)).alias("text_sha256"),
                               F.monotonically_increasing_id().alias("tag")), "tagged")
    gone = _decided(rows.select("id", "text_sha256", "tag"), **filter_options).where(~F.col("kept"))
    blocks = written(_bitmaps(gone.select((F.col("tag") + 1).alias("pos"))), "gone")
    out = None
    for low, high in _ranges(blocks, range_blocks):
        own, part = blocks, rows
        if low is not None:     # buckets above ``low`` up to ``high``; a bucket holds the tags from (bucket - 1) * 32768 on
            own, part = own.where(F.col("_bucket") > low), part.where(F.col("tag") >= low * BITMAP_BITS)
        if high is not None:
            own, part = own.where(F.col("_bucket") <= high), part.where(F.col("tag") < high * BITMAP_BITS)
        part = (part.select("row", "tag", F.call_function("bitmap_bucket_number", F.col("tag") + 1).alias("_bucket"))
                .join(F.broadcast(own), "_bucket", "left")
                .where(~F.coalesce(_bit(F.col("tag") + 1), F.lit(False))).select("row"))
        out = part if out is None else out.unionByName(part)
    return out.select("row.*")


def _ranges(blocks: DataFrame, range_blocks: int) -> list[tuple[int | None, int | None]]:
    """Bounds over the bucket numbers, about ``range_blocks`` bitmaps (at most half as many again) a range."""
    n = -(-blocks.count() // range_blocks)
    if n <= 1:
        return [(None, None)]
    cuts = blocks.agg(F.percentile_approx("_bucket", [k / n for k in range(1, n)], 4 * n)).first()[0]
    cuts = sorted(set(cuts))
    return list(zip([None, *cuts], [*cuts, None]))
