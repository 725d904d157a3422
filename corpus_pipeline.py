"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, SentencePiece.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a
DataFrame.  ``run`` applies them to ``documents``, each stage's result written as Parquet in the
shared checkpoint folder and read back as the next one's input, so a lost executor never costs more
than one stage.  All but the last stage return the columns of ``documents``; the last returns them
with ``piece_ids`` in place of ``text``.

``ORACLE_SQL`` is None: SQL can express neither the network nor the merge agenda; the pipeline is
tested against a brute-force version on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import exact_dedup, langid, mixing, pieces, simhash
from tarmac.llm.common import prepare_session, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go (no letter at all, or no label well ahead)."""
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash links (three-word shingles, at most three bits) the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped water-filling takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with seeded merge-dropout in place of the text."""
    return pieces.encode_documents(docs)


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), docs, sf_dir)
    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


STAGES = [("language ID", _stage(language_id)), ("exact dedup", _stage(exact_duplicates)),
          ("SimHash near-dedup", _stage(near_duplicates)), ("source mixing", _stage(mix_sources)),
          ("SentencePiece", _stage(encode))]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k + 1}")
    return docs
