"""SimHash near-duplicates with multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints differ in at most three
bits, one segment differs in at most one, so every fingerprint is looked up in both segment tables
under all values of the Hamming ball of radius one around its segment (only the half of the ball
that clears a bit: the partner enumerates the other half), and the complete distance of what the
tables return decides.  Equal fingerprints are collapsed before, so copies cost one row, and a
fingerprint has at most C(64,1)+C(64,2)+C(64,3) = 43,744 partners however many documents there are.
The join is one equi-join of written tables on the segment value, which adaptive execution splits
where a value is hot.

Defined results: NULL and blank texts have fingerprint zero and are linked like any other; ids may
repeat; ``component_id`` is the smallest id that can be reached (NULL if all ids are NULL); an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, quoted, sized_broadcast, texts, written
from .graph import connected_components

SEGMENT_BITS = 32
SEGMENTS = 64 // SEGMENT_BITS
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
HASH_SEED = 42


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values.

    ``bytes.lower`` and ``bytes.split`` act on A-Z and on 0x20, 0x09-0x0D only."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        first = (end - length)[:len(words) - shingle_words + 1].tolist()
        last = end[shingle_words - 1:].tolist()
        shingles = [joined[a:b] for a, b in zip(first, last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)
    return int.from_bytes(np.packbits(majority, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp``: the fingerprint as a signed 64-bit number."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            values = [fingerprint(t, shingle_words) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())], names=["id", "fp"])
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def fingerprint_links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``u, v``: pairs of distinct fingerprints (column ``fp``) that differ in 1..max_distance bits."""
    if max_distance >= 2 * SEGMENTS:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    mask = (1 << SEGMENT_BITS) - 1

    def segment(k: int):
        return F.shiftrightunsigned("fp", SEGMENT_BITS * k).bitwiseAND(mask).bitwiseOR(F.lit(k).cast("bigint") * (1 << SEGMENT_BITS))

    def ball(k: int):
        value = segment(k)
        cleared = F.transform(F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.getbit(value, i) == 1),
                              lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
        return F.concat(F.array(value), cleared)
    tables = fps.select(F.explode(F.array(*[segment(k) for k in range(SEGMENTS)])).alias("key"), F.col("fp").alias("v"))
    probes = None
    for k in range(SEGMENTS):
        part = fps.select(F.explode(ball(k)).alias("key"), F.col("fp").alias("u"), segment(k).alias("own"))
        probes = part if probes is None else probes.unionByName(part)
    distance = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    # within one segment value (radius 0) a pair is met from both sides: the smaller looks up the larger
    return (probes.join(tables, "key")
            .where((distance <= max_distance) & ((F.col("key") != F.col("own")) | (F.col("u") < F.col("v"))))
            .select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    rows = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = written(connected_components(fingerprint_links(nodes, max_distance)), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(placed.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return (rows.join(by_fp, F.col("fp") == F.col("_fp"))
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents that stay, one of each group (that with the smallest id), with their columns.

    The rows are tagged and written once; the tag of the survivor of each group selects them."""
    tagged = written(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                                 F.struct(quoted(id_col), F.monotonically_increasing_id().alias("tag")).alias("id"),
                                 quoted(text_col).alias("text")), "tagged")
    groups = near_duplicates(tagged, "id", "text", shingle_words, max_distance)
    losers = written(groups.where("id <> component_id").select(F.col("id.tag").alias("lost")), "losers")
    return tagged.join(sized_broadcast(losers), F.col("id.tag") == F.col("lost"), "left_anti").select("row.*")
