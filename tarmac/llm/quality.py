"""Quality rules and a hashed n-gram logistic regression.

Features of a whole text: hashed word unigrams and bigrams and hashed byte n-grams (3 and 5 bytes,
text as it is, so case and symbols count) in ``DIMS`` buckets, as frequencies.  The regression is
trained in numpy on a bounded sample of labelled rows and calibrated (Platt) on a held-out fold of
it; scoring runs in Arrow batches, where a text's logit is the mean weight of its n-grams, and is
compared with fixed thresholds.  The base figures (word, symbol, line and repetition counts) are
exact.

Defined results: a NULL or blank text has no words and fails the base rules; ties of the sample
order go by text; without labelled rows of both kinds every text that passes the base rules is
kept with score 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, quoted, texts

DIMS_BITS = 15
BYTE_GRAMS = (3, 5)
MAX_TRAIN_ROWS = 2000        # bound of the labelled sample
EPOCHS, RATE, L2 = 60, 0.05, 1e-4
SCALE = 50.0                 # frequencies are small; a fixed factor keeps the weights of order one
SEED = 42
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_START = (np.arange(256) & 0xC0) != 0x80          # bytes that begin a code point
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(codes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more; exact: windows of equal
    hash are compared with the first of them."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for o in range(window):
        h = (h ^ codes[o:o + n].astype(np.uint64)) * _K1
        h ^= h >> np.uint64(29)
    _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    if not twice.any():
        return 0
    at = np.nonzero(twice)[0]
    origin = first[inverse[at]]
    if any((codes[at + o] != codes[origin + o]).any() for o in range(window)):      # a hash collision
        rows = np.lib.stride_tricks.sliding_window_view(codes, window)
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = np.nonzero(count[inverse.ravel()] > 1)[0]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_figures(text: str | None) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the bytes, and word codes."""
    data = (text or "").encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    chars = int((_START[raw] & ~_SPACE[raw]).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(codes), raw,
            _word_hashes(known)[codes] if len(words) else np.zeros(0, np.uint64))


def _word_hashes(known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit value of every distinct word, independent of the process."""
    words = list(known)
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    place = np.arange(len(joined), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), ends - starts)
    mixed = (joined + np.uint64(1)) * (_K1 * (place + np.uint64(1)) ^ _K2)
    mixed ^= mixed >> np.uint64(31)
    return np.add.reduceat(mixed * _K2, starts)


def buckets(raw: np.ndarray, word_hashes: np.ndarray) -> np.ndarray:
    """Feature buckets of every word and byte n-gram of a text."""
    shift = np.uint64(64 - DIMS_BITS)
    parts = [(word_hashes * _K1) >> shift]
    if len(word_hashes) > 1:
        parts.append(((word_hashes[:-1] * _K2 ^ word_hashes[1:]) * _K1) >> shift)
    wide = raw.astype(np.uint64)
    for size in BYTE_GRAMS:
        n = len(raw) - size + 1
        if n > 0:
            h = wide[:n].copy()
            for o in range(1, size):
                h = (h << np.uint64(8)) | wide[o:o + n]
            parts.append(((h + np.uint64(size)) * _K1) >> shift)
    return np.concatenate(parts).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0       # Platt calibration of the raw logit
    offset: float = 0.0

    def probability(self, mean_weight: np.ndarray) -> np.ndarray:
        z = self.slope * (SCALE * mean_weight + self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, int]], seed: int = SEED) -> Model | None:
    """``rows``: buckets, frequencies, label, fold.  Full-batch Adam on folds 1-4, calibrated on 0."""
    fit = [r for r in rows if r[3] != 0]
    if len({r[2] for r in fit}) < 2:
        return None

    def matrix(part):
        at = np.concatenate([[0], np.cumsum([len(r[0]) for r in part])[:-1]])
        return (np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]) * SCALE,
                np.repeat(np.arange(len(part)), [len(r[0]) for r in part]), at, np.array([r[2] for r in part], float))
    column, value, row, at, y = matrix(fit)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, b = np.zeros(1 << DIMS_BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.add.reduceat(value * w[column], at) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance / len(y)
        gw, gb = np.bincount(column, value * g[row], len(w)) + L2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= RATE * 4 * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    model = Model(w, b)
    held = [r for r in rows if r[3] == 0]
    if len({r[2] for r in held}) == 2:
        column, value, row, at, y = matrix(held)
        z = np.add.reduceat(value * w[column], at) + b
        model.slope, model.offset = platt(z, y)
    return model


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on logits, with Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, s = p - t, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        norm = max(1.0, np.abs(d).max())
        a, b = a - d[0] / norm, b - d[1] / norm
        if np.abs(d).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, seed: int = SEED) -> Model | None:
    """Train on the ``max_rows`` labelled rows with the smallest keyed hash, each with one document (of documents that
    share its id the smallest text).  Only their feature counts reach the driver: at most as many as
    there are buckets for each row."""
    marked = labels.select(quoted(id_col).alias("_id"), quoted(label_col).cast("int").alias("label")).where("label in (0, 1)") \
        .select("_id", "label", F.xxhash64(F.lit(seed), "_id").alias("_key"))
    chosen = marked.orderBy("_key", "label").limit(max_rows)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    sample = (rows.join(F.broadcast(chosen), F.col("id") == F.col("_id")).groupBy("_key", "label")
              .agg(F.min("text").alias("text")).select("text", "label", "_key"))

    def features(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text in texts(batch):
                *_, raw, hashes = base_figures(text)
                own, n = np.unique(buckets(raw, hashes), return_counts=True)
                out.append((own.astype(np.int32).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary()),
                                              batch.column(1), batch.column(2)], names=["at", "share", "label", "key"])
    got = sample.mapInArrow(features, "at binary, share binary, label int, key long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["key"], r["label"], r["at"]))
    rows = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(float),
             r["label"], r["key"] % 5) for r in got if r["at"]]
    return train(rows, seed) if rows else None


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                      + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()),
                         T.StructField("kept", T.BooleanType())])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, the base figures, ``base_failed``, calibrated ``quality``, ``kept``."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text in texts(batch):
                words, chars, symbols, dup, repeat, raw, hashes = base_figures(text)
                failed = words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * words
                p = 0.5
                if model is not None and len(raw):
                    at = buckets(raw, hashes)
                    p = float(model.probability(model.weights[at].mean())) if len(at) else 0.5
                out.append((words, chars, symbols, dup, repeat, failed, p, not failed and p >= threshold))
            columns = list(zip(*out)) or [[]] * len(RESULT.fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])],
                names=["id", *RESULT.names])
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], *RESULT.fields])).withColumnRenamed("id", id_col)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
