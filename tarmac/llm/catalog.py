"""Queries of the training-data operators and, where SQL can say it, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, langid, lexical, mixing, negatives, passages, pieces, quality, simhash, surrogates, toxicity,
               warc, wordbpe)
from .common import prepare_session, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.with_rank(warc.capture_index(table(spark, sf_dir, "pages", "page_id", "url", "html"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "capture_rank")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op6_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                                  table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")),
                                    F.col("id") % 100 == 0)


# The URL key (host labels reversed, no scheme, www and fragment), the capture time of a page, and the
# merged order of the captures as a plain row number.
OP1_SQL = r"""
WITH u AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest,
                  coalesce(regexp_replace(url, '[\x00-\x20\x7F]', '%20', 'g'), '') AS uri,
                  '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)' AS form,
                  strftime(make_timestamp((1704067200 + coalesce(page_id, 0) % 1000000000) * 1000000),
                           '%Y%m%d%H%M%S') AS timestamp FROM pages),
p AS (SELECT page_id, payload_bytes, payload_digest, timestamp,
             CASE WHEN NOT regexp_matches(uri, form) THEN lower(uri)
                  ELSE array_to_string(list_reverse(string_split(
                           regexp_replace(lower(regexp_extract(uri, form, 1)), '^www[0-9]*\.', ''), '.')), ',')
                       || CASE WHEN regexp_extract(uri, form, 2) IN ('', ':80', ':443') THEN ''
                               ELSE regexp_extract(uri, form, 2) END
                       || ')' || CASE WHEN regexp_extract(uri, form, 3) = '' THEN '/'
                                      ELSE regexp_extract(uri, form, 3) END END AS urlkey FROM u),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.*, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       row_number() OVER (ORDER BY urlkey, timestamp, page_id) AS capture_rank
FROM p LEFT JOIN g USING (payload_digest)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

# Water-filling in closed form: sources in the order in which they reach their cap; the level is
# that of the first prefix of clamped sources after which nobody else is above its cap.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w
      FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / w AS ratio FROM s),
p AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS fixed, sum(w) OVER a AS free,
             sum(source_size) OVER () AS total FROM o
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             a AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT min(struct_pack(ratio := ratio, level := (1.5::DOUBLE * total - fixed) / free)) AS x
      FROM p WHERE (1.5::DOUBLE * total - fixed) / free < ratio),
t AS (SELECT source, source_size,
             CASE WHEN cap <= (SELECT x.level FROM l) * w THEN cap ELSE (SELECT x.level FROM l) * w END AS target
      FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
n AS (SELECT *, target - whole * source_size AS need FROM r),
h AS (SELECT source, hash, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT h.source, h.hash, n.need, h.words,
             coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY h.hash
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
      FROM h JOIN n ON h.source IS NOT DISTINCT FROM n.source),
f AS (SELECT source, min(struct_pack(hash := hash, start := start, words := words, need := need)) AS c
      FROM c WHERE start + words > need GROUP BY source),
e AS (SELECT source, c.hash + CASE WHEN abs(c.start + c.words - c.need) < abs(c.start - c.need) THEN 1 ELSE 0 END
             AS threshold FROM f)
SELECT d.doc_id, d.size, n.source_size, n.target,
       CAST(d.size * (n.whole + CASE WHEN d.hash < coalesce(e.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT k, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY k),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
m AS (SELECT k, 100 - 75 + (75 * n * docs) // len AS m FROM n, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM p, c GROUP BY term, docs),
q AS (SELECT row_number() OVER () AS i, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT i, item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
s AS (SELECT i, item_id, k, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM t JOIN w USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, k) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, a.label = b.label AS same, b.k, b.vec_id,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.k <> b.k AND a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id, k) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.ak, p.k ORDER BY s.score DESC, s.vec_id, s.k) AS INT) AS rank
      FROM p JOIN s ON p.ak = s.ak AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

_QUERIES: dict[str, Query] = {
    "op1_warc_index": op1_warc_index,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_piece_dropout": op6_piece_dropout,
    "op7_fuzzy_passages": op7_fuzzy_passages,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_source_mix": op10_source_mix,
    "op11_stratified_search": op11_stratified_search,
    "op12_speculative_bpe": op12_speculative_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op1_warc_index": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op10_source_mix": OP10_SQL,
                           "op11_stratified_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}


def _prepared(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES: dict[str, Query] = {name: _prepared(fn) for name, fn in _QUERIES.items()}
