"""Language identification with a byte convolutional network.

The text is lower-cased, encoded as UTF-8 and cut into windows of ``WINDOW`` byte positions that
cover it whole.  Filters of widths 2, 3 and 4 slide over the bytes; ReLU, max pooling over the
window and a softmax give the window's language probabilities, and the document's are their mean,
weighted by the bytes of each window.  The network is trained in numpy on the driver from a bounded
sample of labelled rows (``MAX_TRAIN_ROWS`` rows, all their windows); prediction
runs in Arrow batches where byte-pair tables replace the multiplications.

Defined results: a NULL text or one without a letter is ``und`` with score 0; without any labelled
row every text is ``und``; ties go to the first label by code point; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, crc_mod, quoted, texts

WIDTHS = (2, 3, 4)
FILTERS = 8                  # of each width
WINDOW = 192                 # byte positions of one window
MAX_TRAIN_ROWS = 500         # bound of the labelled sample, of which all windows are learned
EPOCHS, BATCH, RATE = 8, 64, 0.01
SEED = 42
CHUNK = 1 << 20              # bytes convolved at once: bounds a worker's memory
UND = "und"
REACH = max(WIDTHS) - 1
LETTER = regex.compile(r"\p{L}")


def encode(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8"), np.uint8)


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]     # for each width: (width, 256, FILTERS)
    bias: np.ndarray             # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray            # (len(WIDTHS) * FILTERS, labels)
    dense_bias: np.ndarray

    def pair_tables(self) -> list[tuple]:
        """Byte-pair lookups of every filter: a filter of width w is ceil(w / 2) lookups a position."""
        out = []
        for table in self.tables:
            width = table.shape[0]
            for f in range(table.shape[2]):
                column = table[:, :, f].astype(np.float32)
                pairs = [(o, (column[o][:, None] + column[o + 1][None, :]).ravel()) for o in range(0, width - 1, 2)]
                if width % 2:
                    pairs.append((width - 1, column[width - 1]))
                out.append((pairs, width % 2))
        return out


def _forward(net: Network, x: np.ndarray) -> tuple:
    """Window batch (n, WINDOW + REACH) to probabilities, with what training needs."""
    pooled, where = [], []
    for table in net.tables:
        conv = table[0][x[:, :WINDOW]]
        for o in range(1, table.shape[0]):
            conv = conv + table[o][x[:, o:o + WINDOW]]
        at = conv.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0, :])
    h = np.concatenate(pooled, axis=1) + net.bias
    a = np.maximum(h, 0)
    z = a @ net.dense + net.dense_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True), a, where


def train(windows: np.ndarray, labels: list[str], seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy; the gradient of max pooling goes to the winning position."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    units = len(WIDTHS) * FILTERS
    net = Network(names, [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(units),
                  rng.normal(0, 0.3, (units, len(names))), np.zeros(len(names)))
    params = [*net.tables, net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), BATCH):
            rows = order[begin:begin + BATCH]
            x = windows[rows]
            p, a, where = _forward(net, x)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ net.dense.T) * (a > 0)
            grads = []
            for k, table in enumerate(net.tables):
                g = np.zeros_like(table)
                own = back[:, k * FILTERS:(k + 1) * FILTERS]
                for o in range(table.shape[0]):
                    byte = np.take_along_axis(x, where[k] + o, axis=1)
                    np.add.at(g[o], (byte, np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), a.T @ p, p.sum(axis=0)]
            step += 1
            for value, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(WINDOW + REACH, np.uint8)])
    return np.stack([padded[s:s + WINDOW + REACH] for s in starts])


def fit(docs: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        max_rows: int = MAX_TRAIN_ROWS, seed: int = SEED) -> Network | None:
    """Train on the rows of ``fold`` with a label and a letter in the text: the ``max_rows`` with the
    smallest keyed hash (rows of equal id, length and label count once), with all their windows, which is all that
    reaches the driver.  A count tells below which hash those rows lie, so no other text leaves its task."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"),
                       quoted(label_col).cast("string").alias("label"), fold.alias("_fold"))
    eligible = (rows.where(F.col("_fold") & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
                .select("text", "label", F.xxhash64(F.lit(seed), "id", F.length("text")).alias("_key")))
    share = min(1.0, (1.2 * max_rows + 200) / max(1, eligible.count()))
    few = eligible.where(F.col("_key") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    sample = (few.groupBy("_key", "label").agg(F.min("text").alias("text")).select("text", "label", "_key")
              .orderBy("_key", "label").limit(max_rows))

    def windows(batches: Batches) -> Batches:
        for batch in batches:
            out, names = [], []
            for text, label in zip(texts(batch), batch.column(1).to_pylist()):
                data = encode(text)
                for w in cut_windows(data, list(range(0, max(1, len(data)), WINDOW))):
                    out.append(w.tobytes())
                    names.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["w", "label"])
    got = sample.mapInArrow(windows, "w binary, label string").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort((got["w"].to_pylist(), got["label"].to_pylist()))     # independent of task order
    x = np.frombuffer(b"".join(got["w"].to_pylist()), np.uint8).reshape(got.num_rows, -1)
    labels = got["label"].to_pylist()
    return train(x[order], [labels[i] for i in order], seed)


def document_probabilities(net: Network, tables: list[tuple], values: list[str | None]) -> np.ndarray:
    """Mean window probabilities of every text; rows of NULL texts are zero."""
    result = np.zeros((len(values), len(net.labels)))
    pending: list[tuple[int, np.ndarray, int]] = []      # row, bytes, bytes of its own
    size = 0

    def flush() -> None:
        nonlocal pending, size
        counts = np.array([max(1, -(-own // WINDOW)) for _, _, own in pending])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = np.zeros((counts.sum(), WINDOW + REACH), np.uint8)
        weight = np.full(len(x), float(WINDOW))
        for (_, data, own), at, n in zip(pending, starts, counts):
            flat = np.zeros(n * WINDOW + REACH, np.uint8)
            flat[:len(data)] = data[:len(flat)]
            x[at:at + n] = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + REACH)[::WINDOW]
            weight[at + n - 1] = max(1, own - (n - 1) * WINDOW)
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = np.empty((len(x), len(tables)), np.float32)
        for j, (pairs, odd) in enumerate(tables):
            conv = pairs[0][1][pair[:, :WINDOW]]
            for k, (o, lookup) in enumerate(pairs[1:], 1):
                conv += lookup[x[:, o:o + WINDOW]] if odd and k == len(pairs) - 1 else lookup[pair[:, o:o + WINDOW]]
            pooled[:, j] = conv.max(axis=1)
        a = np.maximum(pooled + net.bias.astype(np.float32), 0)
        z = (a @ net.dense.astype(np.float32) + net.dense_bias.astype(np.float32)).astype(np.float64)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        total = np.add.reduceat(z * weight[:, None], starts, axis=0)
        for (row, _, _), t in zip(pending, total):
            result[row] += t
        pending, size = [], 0

    for row, text in enumerate(values):
        if text is None:
            continue
        data = encode(text)
        step = CHUNK // WINDOW * WINDOW
        for begin in range(0, max(1, len(data)), step):     # a very long text goes in pieces of whole windows
            own = min(step, len(data) - begin)
            pending.append((row, data[begin:begin + own + (REACH if own == step else 0)], own))
            size += own
            if size >= CHUNK:
                flush()
    if pending:
        flush()
    total = result.sum(axis=1, keepdims=True)
    return result / np.where(total > 0, total, 1)


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", names: tuple = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``; ``docs`` must not have columns of those names."""
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        tables = net.pair_tables() if net else []
        for batch in batches:
            values = batch.column(at).to_pylist()
            known = np.array([v is not None and net is not None and LETTER.search(v) is not None for v in values], bool)
            label, score = np.full(len(values), UND, object), np.zeros(len(values))
            if known.any():
                rows = np.nonzero(known)[0]
                p = document_probabilities(net, tables, [values[i] for i in rows])
                best = p.argmax(axis=1)
                label[rows] = np.array(net.labels, object)[best]
                score[rows] = np.minimum(1.0, p[np.arange(len(rows)), best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label.tolist(), pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, *names])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def training_fold(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 4 is not 2."""
    return crc_mod(quoted(id_col), 4) != 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``."""
    net = fit(docs, F.coalesce(training_fold(id_col), F.lit(False)), id_col, text_col, label_col)
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(~training_fold(id_col), F.lit(False)).alias("held_out"),
                       quoted(text_col).alias("text"))
    return predict(rows, net).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                    min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with their columns, whose language is recognised: not ``und`` and with a
    probability of at least ``min_score``."""
    net = fit(docs, F.coalesce(training_fold(id_col), F.lit(False)), id_col, text_col, label_col)
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(text_col).alias("text"))
    return predict(rows, net).where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select("row.*")
