"""Ranked lexical search over a length-stratified index.

A term's share in a score depends on the document only through its occurrences tf and the document's
normaliser m, an integer that many documents share.  So the documents of a segment are grouped by m into
strata, and a term's postings are kept as runs: (m, tf, documents).  One impact is computed per run, whatever
the number of documents in it, and the largest impact of each term in a stratum adds up to a bound on
every score there.

* ``build_index``: one pass counts documents and terms (m needs their mean); a second cuts every partition
  into segments of at most ``SEGMENT_POSTINGS`` postings and writes one row per (segment, term), built in
  arrays.  No posting is shuffled, so a word that every document holds is no hot key.
* ``search``: the rows of the items' terms are joined to the items, block of items by block, and grouped by
  (segment, block); each group visits its strata by descending bound and stops at the first whose bound is
  below the item's k-th score.  The k best of every segment meet in a window that keeps k per task first.

Bounded: a group holds one segment and at most ``ITEM_BLOCK`` items; what is broadcast is counted first.

Scores are 64-bit integers: w * ((10^9 tf) div (1000 tf + 8 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))),
m = 25 + (75 n N) div L.  Equal scores rank by ascending document id.

Defined results: a NULL or empty text has no terms and is in no result, an item without terms or matches has no
rows; every row is a document of its own, also with a repeated id; a NULL id comes last among equal scores;
every row of the items is an item of its own; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, quoted, sized_broadcast, written

SEGMENT_POSTINGS = 1_000_000
SEGMENT_DOCS = 65_536
ITEM_BLOCK = 256
TOP = 10
FIRST_DOCS = 512             # documents of the first visit; every next visit takes twice as many
BROADCAST_ENTRIES = 500_000  # (term, item) pairs, about 20 bytes each
SEGMENTS_PER_TASK = 1 << 20

# A term is a run of ASCII letters, digits and characters beyond ASCII (fixed values); A-Z are lower-cased.
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
TERM_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else _SPACED[c] for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms in order, as UTF-8."""
    return (text or "").encode("utf-8").translate(TERM_TABLE).split()


@dataclass
class LexicalIndex:
    """``postings``: segment, term, df, and per run the lists m, tf, size; ``doc`` lists the ordinals run by run.
    ``docs``: segment, ordinal, doc.  ``documents`` and ``length`` are N and L."""
    postings: DataFrame
    docs: DataFrame
    documents: int
    length: int


def corpus_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes = [len(terms(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()),
                                              pa.array([sum(sizes)], pa.int64())], names=["n", "l"])
    got = docs.select(quoted(text_col)).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return got[0] or 0, got[1] or 0


def normaliser(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return 25 + (75 * n * documents) // max(length, 1)


class _Segment:
    """Collects documents; ``rows`` gives one row per term."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.tf, self.sizes, self.lengths, self.ids = [], [], [], [], []
        self.postings = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        counts, vocabulary = Counter(words), self.vocabulary
        self.term.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.sizes.append(len(counts))
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.postings += len(counts)

    def rows(self, segment: int, documents: int, length: int, id_type: pa.DataType) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        # ordinals follow the ids, so equal scores rank by ordinal; NULL ids come last
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, 0 if self.ids[k] is None else self.ids[k]))
        ordinal = np.empty(len(order), np.int32)
        ordinal[order] = np.arange(len(order), dtype=np.int32)
        sizes = np.array(self.sizes, np.int64)
        m = normaliser(np.array(self.lengths, np.int64), documents, length)
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        doc, m = np.repeat(ordinal, sizes), np.repeat(m, sizes)
        by = np.lexsort((doc, tf, m, term))
        term, tf, m, doc = term[by], tf[by], m[by], doc[by]
        new_term = np.r_[True, term[1:] != term[:-1]]
        new_run = new_term | np.r_[True, (m[1:] != m[:-1]) | (tf[1:] != tf[:-1])]
        runs, starts = np.nonzero(new_run)[0], np.nonzero(new_term)[0]
        run_ends, doc_ends = np.searchsorted(runs, np.r_[starts, len(term)]), np.r_[starts, len(term)]

        def lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))
        names = list(self.vocabulary)
        posting_rows = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), segment, np.int64)),
             pa.array([names[k].decode("utf-8") for k in term[starts].tolist()], pa.string()),
             pa.array(np.diff(doc_ends), pa.int64()),
             lists(run_ends, m[runs], pa.int64()), lists(run_ends, tf[runs], pa.int32()),
             lists(run_ends, np.diff(np.r_[runs, len(term)]), pa.int32()), lists(doc_ends, doc, pa.int32())],
            names=["segment", "term", "df", "m", "tf", "size", "doc"])
        doc_rows = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(order), segment, np.int64)), pa.array(np.arange(len(order), dtype=np.int32)),
             pa.array([self.ids[k] for k in order], id_type)], names=["segment", "ordinal", "doc_id"])
        return posting_rows, doc_rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_postings: int = SEGMENT_POSTINGS) -> LexicalIndex:
    """The index of all documents, written to the shared folder."""
    n_docs, length = corpus_size(docs, text_col)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    posting_fields = [T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
                      T.StructField("m", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.IntegerType())),
                      T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("doc", T.ArrayType(T.IntegerType()))]
    doc_fields = [T.StructField("ordinal", T.IntegerType()), T.StructField("doc_id", id_type)]
    schema = T.StructType([T.StructField("segment", T.LongType()), *posting_fields, *doc_fields])

    def run(batches: Batches) -> Batches:
        number, segment = TaskContext.get().partitionId() * SEGMENTS_PER_TASK, _Segment()
        kind = None

        def finished():
            postings, members = segment.rows(number, n_docs, length, kind)
            for begin in range(0, len(postings), 20_000):     # rows of terms: the members' columns are NULL, and the reverse
                part = postings.slice(begin, 20_000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(len(part), pa.int32()), pa.nulls(len(part), kind)],
                                                 names=schema.names)
            nulls = [pa.nulls(len(members), t) for t in [postings.schema.field(i).type for i in range(1, 7)]]
            yield pa.RecordBatch.from_arrays([members.column(0), *nulls, members.column(1), members.column(2)],
                                             names=schema.names)
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms(text)
                if words:
                    segment.add(doc_id, words)
                if segment.postings >= segment_postings or len(segment.ids) >= SEGMENT_DOCS:
                    yield from finished()
                    number, segment = number + 1, _Segment()
        if segment.ids:
            yield from finished()
    both = written(rows.mapInArrow(run, schema), "lexical-index")
    return LexicalIndex(both.where("term IS NOT NULL").select("segment", *[f.name for f in posting_fields]),
                        both.where("ordinal IS NOT NULL").select("segment", "ordinal", F.col("doc_id").alias("doc")),
                        n_docs, length)


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (a row number of its own), ``item_id``, ``term``, ``qtf``: distinct terms of every item."""
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), quoted(id_col).alias("item_id"),
                                quoted(text_col).alias("text")), "lexical-items")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            got = [Counter(terms(t)) for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(got)), [len(c) for c in got]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array([w.decode("utf-8") for c in got for w in c], pa.string()),
                 pa.array([n for c in got for n in c.values()], pa.int64())], names=["item", "item_id", "term", "qtf"])
    return rows.mapInArrow(run, T.StructType([rows.schema["item"], rows.schema["item_id"],
                                              T.StructField("term", T.StringType()), T.StructField("qtf", T.LongType())]))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def search_segment(rows: pd.DataFrame, top: int = TOP) -> tuple[pd.DataFrame, int]:
    """The best documents of one segment for every item of one block, and how many postings were read.

    ``rows``: one per term of the segment, with its runs (m, tf, size, doc) and the lists ``items`` and
    ``weights`` (w times the occurrences in the item) of the items that hold it."""
    runs = [len(x) for x in rows["m"]]
    m, tf, size = (np.concatenate([np.asarray(x, np.int64) for x in rows[c]]) for c in ("m", "tf", "size"))
    doc = np.concatenate([np.asarray(x, np.int64) for x in rows["doc"]])
    begin = np.cumsum(size) - size
    per_run = impact(tf, m)                                  # once per (term, stratum, tf)
    strata, stratum = np.unique(m, return_inverse=True)
    first_run = np.cumsum(runs) - runs
    held = [len(x) for x in rows["items"]]
    entry_row = np.repeat(np.arange(len(rows)), held)
    entry_item = np.concatenate([np.asarray(x, np.int64) for x in rows["items"]])
    entry_weight = np.concatenate([np.asarray(x, np.int64) for x in rows["weights"]])
    by_item = np.argsort(entry_item, kind="stable")
    items, item_starts = np.unique(entry_item[by_item], return_index=True)
    docs_in = np.zeros(len(strata), np.int64)
    np.maximum.at(docs_in, stratum, size)                    # at least so many documents are in a stratum
    score = np.zeros(int(doc.max()) + 1, np.int64)
    out, read = [], 0
    for item, entries in zip(items.tolist(), np.split(by_item, item_starts[1:])):
        own, weight = entry_row[entries], entry_weight[entries]
        counts = np.array(runs)[own]
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        r = np.repeat(first_run[own], counts) + offsets      # all runs of the item's terms
        gain, where = per_run[r] * np.repeat(weight, counts), stratum[r]
        # the largest gain of each term in each stratum; a term's runs lie by stratum
        edges = np.nonzero(np.r_[True, (where[1:] != where[:-1]) | (np.repeat(own, counts)[1:] != np.repeat(own, counts)[:-1])])[0]
        bound = np.zeros(len(strata), np.int64)
        np.add.at(bound, where[edges], np.maximum.reduceat(gain, edges))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rank = np.full(len(strata), len(strata))
        rank[order] = np.arange(len(order))
        r_rank, visited, batch = rank[where], 0, FIRST_DOCS
        best_score, best_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while visited < len(order):
            if len(best_score) >= top and bound[order[visited]] < best_score[-1]:
                break                                        # nothing left can enter, not even as an equal
            upto = visited + max(1, int(np.searchsorted(np.cumsum(docs_in[order[visited:]]), batch)))
            chosen = np.nonzero((r_rank >= visited) & (r_rank < upto))[0]
            lengths = size[r[chosen]]
            at = np.repeat(begin[r[chosen]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            hit = doc[at]
            np.add.at(score, hit, np.repeat(gain[chosen], lengths))
            read += len(hit)
            seen = np.unique(hit)
            best_doc, best_score = np.r_[best_doc, seen], np.r_[best_score, score[seen]]
            score[seen] = 0                                  # a document lies in one stratum: its score is whole
            keep = np.lexsort((best_doc, -best_score))[:top]
            best_doc, best_score = best_doc[keep], best_score[keep]
            keep = best_score > 0
            best_doc, best_score = best_doc[keep], best_score[keep]
            visited, batch = upto, batch * 2
        out.append((np.full(len(best_doc), item), best_doc, best_score))
    columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [[]] * 3)]
    return pd.DataFrame({"item": columns[0], "ordinal": columns[1].astype(np.int32), "score": columns[2]}), read


def search(index: LexicalIndex, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP,
           item_block: int = ITEM_BLOCK) -> DataFrame:
    """Per item its ``top`` best documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    if top < 1:
        raise ValueError("top must be 1 at least")
    asked = written(_item_terms(items, id_col, text_col), "lexical-terms")
    names = asked.select("item", "item_id").distinct()
    entries = asked.count()

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df
    df = (index.postings.select("term", "df").join(small(asked.select("term").distinct()), "term", "left_semi")
          .groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2.0) / (2 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-asked.select("item").distinct().count() // item_block))))
    by_term = written(asked.join(df.select("term", weight.alias("w")), "term").withColumn("block", block)
                      .groupBy("block", "term").agg(F.collect_list(F.struct("item", (F.col("w") * F.col("qtf")).alias("weight"))).alias("e"))
                      .select("block", "term", F.col("e.item").alias("items"), F.col("e.weight").alias("weights")), "lexical-asked")
    hits = index.postings.select("segment", "term", "m", "tf", "size", "doc").join(small(by_term), "term")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got, _ = search_segment(rows, top)
        got.insert(0, "segment", key[0])
        return got
    local = hits.groupBy("segment", "block").applyInPandas(run, "segment long, item long, ordinal int, score long")
    # the k best scores of an item with all their equals: few rows to look the ids up for
    best = written(local.withColumn("place", F.rank().over(Window.partitionBy("item").orderBy(F.col("score").desc())))
                   .where(F.col("place") <= top).drop("place"), "lexical-best")
    named = index.docs.join(sized_broadcast(best), ["segment", "ordinal"])
    final = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "segment", "ordinal")
    ranked = named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    return (ranked.join(sized_broadcast(written(names, "lexical-names")), "item")
            .select(F.col("item_id").alias(id_col), "rank", F.col("doc").alias("doc_id"), "score"))


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Index ``docs`` and rank them for every row of ``items``."""
    return search(build_index(docs, id_col, text_col), items, **options)
