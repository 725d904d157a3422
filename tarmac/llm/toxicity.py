"""Toxic passages by maximum-scoring segments over token log-odds.

Token scores are log-odds of toxic against other labelled documents (documents that hold the token,
so one repetitive text counts once) under an informative Dirichlet prior, the pooled counts scaled
to ``PRIOR`` pseudo-counts; a token whose odds are not significant costs ``DRIFT``.  One linear scan
finds all maximal scoring segments of a text, however long.  Their significance comes from
extreme-value theory: with lambda the root of E[exp(lambda s)] = 1 under the scores of non-toxic text
and K matched to the segments seen there, K n exp(-lambda S) segments of score S or more are expected
by chance among n tokens.  A document's evidence is the best normalised sum over its r highest
segments, and a logistic fit on labelled rows kept out of the counting makes it a probability.

Learning uses at most ``MAX_TRAIN_ROWS`` labelled rows (smallest keyed hash); what reaches the driver
is at most ``MAX_TOKENS`` token scores and one number per calibration row.

Defined results: NULL and wordless texts have no segments and score as such; several labels of one
id count as the highest; without both kinds of labels every text scores 0; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, crc_mod, quoted, texts, written
from .quality import platt

TOKEN = re.compile(r"[^\W\d_]+")
MAX_TRAIN_ROWS = 8000
MAX_TOKENS = 1 << 16
MIN_DOCS = 4                 # documents a token must occur in to be scored
PRIOR = 500.0
MIN_Z = 1.96
DRIFT = 0.25                 # cost of a token without significant odds
CEILING = 6.0
CALIBRATION_FOLDS = 4        # one of so many labelled rows calibrates, the others count
SEED = 42


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), left to right, in linear time.

    Only the positive scores start candidates; the sums between them come from one cumulative sum.
    A candidate keeps the last one before it with a lower left sum, so the search jumps."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []      # begin, end, left sum, right sum, link
    for k in np.nonzero(scores > 0)[0].tolist():
        begin, left, right = k, float(total[k]), float(total[k + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((begin, k + 1, left, right, j))
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - x) for b, e, x, r, _ in stack]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0       # lambda
    density: float = 1.0     # K
    slope: float = 1.0
    offset: float = 0.0
    fitted: bool = True

    def score_array(self, words: list[str]) -> np.ndarray:
        get = self.scores.get
        return np.fromiter((get(w, -DRIFT) for w in words), np.float64, len(words))

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments: begin, end (tokens), score, expected number by chance (below 1)."""
        n = max(1, len(words))
        found = [(b, e, s, self.density * n * math.exp(-self.decay * s)) for b, e, s in maximal_segments(self.score_array(words))]
        return [f for f in found if f[3] < 1]

    def evidence(self, words: list[str]) -> float:
        """Best normalised sum of the r highest segments: sum(lambda S) - r ln(K n) + ln r!."""
        n = max(1, len(words))
        cost = math.log(max(self.density * n, 1e-9))
        ordered = np.sort([s for _, _, s in maximal_segments(self.score_array(words))])[::-1]
        run = np.cumsum(self.decay * ordered - cost + np.log(np.arange(1, len(ordered) + 1)))
        return max(0.0, float(run.max())) if len(run) else 0.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(evidence))
        z = self.slope * np.log1p(evidence) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def extreme_value(values: np.ndarray, weights: np.ndarray) -> float:
    """Lambda > 0 with E[exp(lambda s)] = 1, by bisection (needs a negative mean)."""
    p = weights / weights.sum()
    if (p * values).sum() >= 0 or values.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if (p * np.exp(mid * values)).sum() < 1:
            low = mid
        else:
            high = mid
    return max(high, 1e-3)


def token_scores(counts: DataFrame, toxic_docs: int, other_docs: int) -> DataFrame:
    """``word, score`` of the tokens with significant odds.  ``counts``: word, y1, y0 (documents)."""
    both = counts.where(F.col("y1") + F.col("y0") >= MIN_DOCS)
    prior = PRIOR * (F.col("y1") + F.col("y0")) / F.lit(float(max(1, toxic_docs + other_docs)))
    a, b = F.col("y1") + prior, F.col("y0") + prior
    odds = (F.log(a / (F.lit(toxic_docs + PRIOR) - a + PRIOR)) - F.log(b / (F.lit(other_docs + PRIOR) - b + PRIOR)))
    return (both.withColumn("score", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
            .where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "word").limit(MAX_TOKENS)
            .select("word", F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(CEILING)).alias("score"), "y0"))


def fit(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, seed: int = SEED) -> Model:
    """``fold``: condition on the label rows that may be learned from."""
    marked = (labels.where(fold).select(quoted(id_col).alias("_id"), quoted(label_col).cast("int").alias("label"))
              .where("label in (0, 1) and _id is not null").groupBy("_id").agg(F.max("label").alias("label")))
    chosen = marked.select("_id", "label", F.xxhash64(F.lit(seed), "_id").alias("_key")).orderBy("_key", "_id").limit(max_rows)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    sample = written(rows.join(F.broadcast(chosen), F.col("id") == F.col("_id"))
                     .groupBy("_key", "label").agg(F.min("text").alias("text"))       # one document of each id
                     .select("text", "label", F.pmod("_key", F.lit(CALIBRATION_FOLDS)).cast("int").alias("part")), "toxic-sample")

    def words_of(batches: Batches) -> Batches:
        for batch in batches:
            out, kind = [], []
            for text, label in zip(texts(batch), batch.column(1).to_pylist()):
                own = set(tokens(text))
                out.extend(own)
                kind.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kind, pa.int32())], names=["word", "label"])
    counting = sample.where("part <> 0").select("text", "label")
    size = {r.label: r.n for r in counting.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Model(fitted=False)
    counts = (counting.mapInArrow(words_of, "word string, label int").groupBy("word")
              .agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0")))
    model = Model({r.word: r.score for r in token_scores(counts, size[1], size[0]).collect()})

    def chance_of(batches: Batches) -> Batches:
        """Per non-toxic row: number of tokens, histogram of their scores, highest segment."""
        for batch in batches:
            n, hist, top = [], [], []
            for text in texts(batch):
                array = model.score_array(tokens(text))
                value, count = np.unique(array, return_counts=True)
                n.append(len(array))
                hist.append(np.concatenate([value, count.astype(float)]).tobytes())
                top.append(max((s for _, _, s in maximal_segments(array)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(hist, pa.binary()), pa.array(top, pa.float64())],
                                             names=["n", "hist", "top"])

    def evidence_of(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([model.evidence(tokens(t)) for t in texts(batch)], pa.float64())],
                                             names=["label", "x"])
    null = [r for r in counting.where("label = 0").select("text").mapInArrow(chance_of, "n long, hist binary, top double")
            .toArrow().to_pylist() if r["n"]]
    null.sort(key=lambda r: (r["n"], r["top"], r["hist"]))
    seen: dict[float, float] = {}
    for r in null:
        both = np.frombuffer(r["hist"], np.float64)
        for s, c in zip(both[:len(both) // 2].tolist(), both[len(both) // 2:].tolist()):
            seen[s] = seen.get(s, 0.0) + c
    values = np.array(sorted(seen)) if seen else np.array([-DRIFT])
    model.decay = extreme_value(values, np.array([seen.get(v, 1.0) for v in values.tolist()]))
    # K: the maximum likelihood of P(top <= x) = exp(-K n exp(-lambda x)) given lambda
    exposure = sum(r["n"] * math.exp(-model.decay * r["top"]) for r in null)
    model.density = min(1.0, max(1e-6, len(null) / exposure)) if exposure > 0 else 1.0
    held = sample.where("part = 0").select("text", "label").mapInArrow(evidence_of, "label int, x double").toArrow().to_pylist()
    held.sort(key=lambda r: (r["label"], r["x"]))
    y = np.array([r["label"] for r in held], float)
    if len(set(y.tolist())) == 2:
        model.slope, model.offset = platt(np.log1p(np.array([r["x"] for r in held])), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          held_out: Column | None = None) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``, ``n_passages`` and the token
    spans of the significant passages."""
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False))
                       .alias("held_out"), quoted(text_col).alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x, spans = [], []
            for text in texts(batch):
                words = tokens(text)
                x.append(model.evidence(words))
                spans.append([{"begin": b, "end": e, "score": s, "expected": v} for b, e, s, v in model.passages(words)])
            p = model.probability(np.array(x, float))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, SPANS)],
                names=["id", "held_out", "score", "predicted", "n_passages", "passages"])
    fields = [rows.schema.fields[0], rows.schema.fields[1], T.StructField("score", T.DoubleType()),
              T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.IntegerType()),
              T.StructField("passages", T.ArrayType(T.StructType([
                  T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
                  T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])))]
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def held_out_fold(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 5 is 0 are never learned from."""
    return crc_mod(quoted(id_col), 5) == 0


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = fit(docs, labels, ~held_out_fold(id_col), id_col, text_col)
    return score(docs, model, id_col, text_col, held_out_fold(id_col))
