"""Least squares and ridge from sums: no iteration, no design matrix, no indexer.

The normal equations of numeric columns and one-hot categories are sums over rows and counts of levels, so Spark
adds them up with partial aggregation:

* one aggregation gives the rows, the sums and the products of the numeric columns and the label;
* one (grouping sets, a set per category) gives rows, numeric sums and label sums of every level;
* one (grouping sets, a set per pair of categories) counts how often two levels meet.

The equations have one row and column per numeric column and level; they are solved on the driver, at most
``MAX_WIDTH`` wide (a wider design is an error that says so).  Numeric columns are shifted by the values of some row
before they are summed, so large offsets cost no digits, and standardized with the population deviation.  A
missing or unknown level is all zeros, as in the one-hot encoding with every level kept.

A category with any number of levels can be absorbed (``fit_absorbed``): its block of the equations is diagonal, so
its levels are eliminated one by one in tasks, from one row of sums per level, and come back as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import lookup_join
from ..operators.metrics import metric_table
from ..plans.prepare import write_table
from ..sources.literal import literal_table

MAX_WIDTH = 4096
MAX_REST = 1024        # columns beside an absorbed category
SINGULAR = 1e-11       # directions of less than this share of the largest eigenvalue are left out


@dataclass
class LinearModel:
    """Prediction = intercept + sum of coefficient * (x - mean) / scale + the values of the levels."""
    numerical: list[str]
    categorical: list[str]
    intercept: float
    coefficients: list[float]
    means: list[float]
    scales: list[float]
    levels: DataFrame | None        # feature, level, value
    rows: int = 0

    def transform(self, rows: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``rows`` plus ``prediction``; NULL where a numeric column is missing."""
        out = F.lit(self.intercept)
        for c, w, mean, scale in zip(self.numerical, self.coefficients, self.means, self.scales):
            out = out + F.lit(w) * (F.col(c).cast("double") - F.lit(mean)) / F.lit(scale)
        for c in self.categorical:
            own = self.levels.where(F.col("feature") == c).select(F.col("level").alias(f"_level_{c}"), F.col("value").alias(f"_value_{c}"))
            rows = lookup_join(rows.withColumn(f"_level_{c}", F.col(c).cast("string")), own, f"_level_{c}")
            out = out + F.coalesce(F.col(f"_value_{c}"), F.lit(0.0))
        return rows.withColumn(prediction, out).drop(*[f"_{k}_{c}" for k in ("level", "value") for c in self.categorical])

    def raw_terms(self) -> list[tuple[str, float]]:
        """Intercept and coefficients on the columns' own scale (numeric part)."""
        slopes = [w / s for w, s in zip(self.coefficients, self.scales)]
        return [("intercept", self.intercept - sum(w * m for w, m in zip(slopes, self.means))), *zip(self.numerical, slopes)]

    def save(self, path: str, spark: SparkSession) -> None:
        """Tables ``terms`` and ``levels`` under ``path``."""
        terms = [("intercept", -1, "", self.intercept, 0.0, 1.0)]
        terms += [("numerical", i, c, w, m, s) for i, (c, w, m, s) in
                  enumerate(zip(self.numerical, self.coefficients, self.means, self.scales))]
        terms += [("categorical", i, c, 0.0, 0.0, 1.0) for i, c in enumerate(self.categorical)]
        literal_table(spark, [("kind", T.StringType()), ("position", T.IntegerType()), ("feature", T.StringType()),
                              ("coefficient", T.DoubleType()), ("mean", T.DoubleType()), ("scale", T.DoubleType())], terms) \
            .write.mode("overwrite").parquet(f"{path}/terms")
        if self.levels is not None:
            self.levels.write.mode("overwrite").parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearModel":
        terms = spark.read.parquet(f"{path}/terms").orderBy("kind", "position").collect()
        num = [r for r in terms if r.kind == "numerical"]
        cat = [r.feature for r in terms if r.kind == "categorical"]
        return cls([r.feature for r in num], cat, next(r.coefficient for r in terms if r.kind == "intercept"),
                   [r.coefficient for r in num], [r["mean"] for r in num], [r["scale"] for r in num],
                   spark.read.parquet(f"{path}/levels") if cat else None)


def usable(rows: DataFrame, numerical: Sequence[str], label: str) -> DataFrame:
    """The rows a fit uses: label and its own numeric columns present and not NaN."""
    for c in [*numerical, label]:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return rows


def _level_sums(rows: DataFrame, categorical: Sequence[str], sums: list[Column]) -> dict[str, list]:
    """Per category its levels' sums, from one pass."""
    sets = [[F.col(c)] for c in categorical]
    found = (rows.groupingSets(sets, *[F.col(c) for c in categorical])
             .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n"), *sums))
    # bit k of the id, from the left, is 0 for the category that is grouped
    out = {}
    n_levels = found.count() if len(categorical) else 0
    if n_levels > MAX_WIDTH:
        raise ValueError(f"{n_levels} levels are too many for the normal equations (at most {MAX_WIDTH})")
    for r in found.collect():
        k = next(i for i in range(len(categorical)) if not r["_gid"] >> (len(categorical) - 1 - i) & 1)
        if r[categorical[k]] is not None:
            out.setdefault(categorical[k], []).append(r)
    return out


def fit_linear(rows: DataFrame, numerical: Sequence[str], categorical: Sequence[str], label: str, alpha: float = 0.0,
               tables: list[str] | None = None) -> LinearModel:
    """Minimizes |y - b - Xw|^2 + alpha |w|^2 over standardized numeric columns and one-hot levels; without a penalty
    the solution of least norm."""
    numerical, categorical = list(numerical), list(categorical)
    rows = usable(rows, numerical, label).select(*[F.col(c).cast("double").alias(c) for c in numerical],
                                                 *[F.col(c).cast("string").alias(c) for c in categorical],
                                                 F.col(label).cast("double").alias("_y"))
    some = rows.first()
    if some is None:
        raise ValueError("no rows to fit")
    shift = [float(some[c]) for c in [*numerical, "_y"]]
    z = [F.col(c) - F.lit(s) for c, s in zip([*numerical, "_y"], shift)]
    k = len(numerical)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(k + 1)],
                   *[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n, sums = int(one["n"]), np.array([one[f"s{i}"] for i in range(k + 1)])
    products = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        products[i, j] = products[j, i] = one[f"p{i}_{j}"]
    moments = products / n - np.outer(sums / n, sums / n)
    scales = np.sqrt(np.maximum(np.diag(moments)[:k], 0.0))
    scales = np.where(scales > 1e-12 * np.maximum(1.0, np.abs(shift[:k])), scales, 1.0)
    # columns: standardized numeric ones, then levels; all centred
    levels: list[tuple[str, str]] = []
    share, with_num, with_label = [], [], []
    if categorical:
        by_category = _level_sums(rows, categorical, [F.sum(v).alias(f"s{i}") for i, v in enumerate(z)])
        for c in categorical:
            for r in sorted(by_category.get(c, []), key=lambda r: r[c]):
                levels.append((c, r[c]))
                share.append(r["_n"])
                with_num.append([(r[f"s{i}"] - r["_n"] * sums[i] / n) / scales[i] for i in range(k)])
                with_label.append(r[f"s{k}"] - r["_n"] * sums[k] / n)
    width = k + len(levels)
    if width > MAX_WIDTH:
        raise ValueError(f"{width} columns are too many for the normal equations (at most {MAX_WIDTH})")
    gram, right = np.zeros((width, width)), np.zeros(width)
    gram[:k, :k] = n * moments[:k, :k] / np.outer(scales, scales)
    right[:k] = n * moments[:k, k] / scales
    if levels:
        count, place = np.array(share, float), {x: i for i, x in enumerate(levels)}
        meet = np.diag(count)
        if len(categorical) > 1:
            both = list(combinations(range(len(categorical)), 2))
            got = (rows.groupingSets([[F.col(categorical[i]), F.col(categorical[j])] for i, j in both], *[F.col(c) for c in categorical])
                   .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n")))
            for r in got.collect():                 # at most width^2 counts
                i, j = [x for x in range(len(categorical)) if not r["_gid"] >> (len(categorical) - 1 - x) & 1]
                a, b = r[categorical[i]], r[categorical[j]]
                if a is not None and b is not None:
                    a, b = place[categorical[i], a], place[categorical[j], b]
                    meet[a, b] = meet[b, a] = r["_n"]
        gram[k:, k:] = meet - np.outer(count, count) / n
        gram[k:, :k], gram[:k, k:] = np.array(with_num).reshape(-1, k), np.array(with_num).reshape(-1, k).T
        right[k:] = with_label
    if alpha > 0:
        w = np.linalg.solve(gram + alpha * np.eye(width), right)
    else:
        values, vectors = np.linalg.eigh(gram)
        keep = values > SINGULAR * max(values.max(initial=0.0), 1e-300)
        w = vectors[:, keep] @ ((vectors[:, keep].T @ right) / values[keep])
    means = [s + m / n for s, m in zip(shift, sums)]
    intercept = means[k] - sum(w[k + i] * c / n for i, c in enumerate(share))
    table = None
    if categorical:
        table = rows.sparkSession.createDataFrame([(c, v, float(x)) for (c, v), x in zip(levels, w[k:])],
                                                  "feature string, level string, value double")
        table = write_table(table, "linear-levels", written=tables)
    return LinearModel(numerical, categorical, float(intercept), [float(x) for x in w[:k]], means[:k], scales.tolist(), table, n)


def _products(rows: DataFrame, width: int, design: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over all rows of w x x', where ``design`` gives x and w: every task adds up its own matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x, w = design(batch)
            total += x.T @ (x * w[:, None])
        slot = np.nonzero(total.reshape(-1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total.reshape(-1)[slot])], names=["slot", "v"])
    got = rows.mapInArrow(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width * width)
    out[got["slot"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(width, width)


def fit_absorbed(rows: DataFrame, numerical: Sequence[str], categorical: Sequence[str], label: str, alpha: float, absorbed: str,
                 tables: list[str] | None = None) -> LinearModel:
    """The fit of ``fit_linear`` with a penalty ``alpha`` above 0, whatever the number of levels of the category
    ``absorbed``: with its levels' sums c and rows n, c c' / (n + alpha) goes off the equations of the other columns
    (at most ``MAX_REST``), and a level's value is (label sum - c w) / (n + alpha)."""
    if not alpha > 0:
        raise ValueError("an absorbed category needs a penalty above 0")
    numerical, others = list(numerical), [c for c in categorical if c != absorbed]
    rows = usable(rows, numerical, label).select(*[F.col(c).cast("double").alias(c) for c in numerical],
                                                 *[F.col(c).cast("string").alias(c) for c in categorical],
                                                 F.col(label).cast("double").alias("_y"))
    k = len(numerical)
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(numerical)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numerical)]).first()
    if not one["n"]:
        raise ValueError("no rows to fit")
    means, scales = [one[f"m{i}"] for i in range(k)], [one[f"s{i}"] or 1.0 for i in range(k)]
    found = _level_sums(rows, others, []) if others else {}
    levels = [(c, v) for c in others for v in sorted(r[c] for r in found.get(c, []))]
    rest = k + len(levels)
    if rest > MAX_REST:
        raise ValueError(f"{rest} columns beside {absorbed} are too many for the normal equations (at most {MAX_REST})")
    width, place = rest + 2, {x: 1 + k + i for i, x in enumerate(levels)}      # 1, the columns, the label
    z = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(numerical, means, scales)]
    scaled = rows.select(*[v.alias(f"z{i}") for i, v in enumerate(z)], *others, "_y")

    def row_design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((batch.num_rows, width))
        x[:, 0] = 1.0
        for i in range(k):
            x[:, 1 + i] = batch.column(i).to_numpy()
        for i, c in enumerate(others):
            codes = batch.column(k + i).dictionary_encode()
            slots = np.array([place[c, v] for v in codes.dictionary.to_pylist()], np.int64)
            known = np.nonzero(codes.indices.is_valid().to_numpy(zero_copy_only=False))[0]
            x[known, slots[codes.indices.drop_null().to_numpy()]] = 1.0
        x[:, -1] = batch.column(k + len(others)).to_numpy()
        return x, np.ones(len(x))

    def sums_design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(0).flatten().to_numpy().reshape(-1, width)
        return x, 1.0 / (x[:, 0] + alpha)
    columns = [F.lit(1.0), *z, *[F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, v in levels], F.col("_y")]
    # partial sums first: a hot level is one row per task
    sums = write_table(rows.where(F.col(absorbed).isNotNull()).groupBy(F.col(absorbed).alias("level"))
                       .agg(*[F.sum(x).alias(f"x{i}") for i, x in enumerate(columns)])
                       .select("level", F.array(*[f"x{i}" for i in range(width)]).alias("x")), "linear-sums", written=tables)
    system = _products(scaled, width, row_design) - _products(sums.select("x"), width, sums_design)
    gram, right = system[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * rest), system[:-1, -1]
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    w = scale * np.linalg.lstsq(gram * np.outer(scale, scale), right * scale, rcond=1e-15)[0]
    weights = w.tolist()

    def level_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            value = (x[:, -1] - x[:, :-1] @ np.array(weights)) / (x[:, 0] + alpha)
            yield pa.RecordBatch.from_arrays([pa.array([absorbed] * len(x), pa.string()), batch.column(0), pa.array(value)],
                                             names=["feature", "level", "value"])
    schema = "feature string, level string, value double"
    own = sums.mapInArrow(level_values, schema)
    if levels:
        own = own.unionByName(rows.sparkSession.createDataFrame([(c, v, float(w[place[c, v]])) for c, v in levels], schema))
    return LinearModel(numerical, list(categorical), float(w[0]), [float(x) for x in w[1:1 + k]], means, scales,
                       write_table(own, "linear-levels", written=tables), int(one["n"]))


def correlation_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, correlation`` of all pairs, from one aggregation; rows where either of the two is missing
    are left out of that pair, a constant column has NULL."""
    columns = list(columns)
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = []           # not ``corr``, which divides by the zero deviation of a constant column
    for i, (a, b) in enumerate(pairs):
        aggs += [F.covar_pop(x[a], x[b]).alias(f"c{i}"), F.stddev_pop(F.when(x[b].isNotNull(), x[a])).alias(f"a{i}"),
                 F.stddev_pop(F.when(x[a].isNotNull(), x[b])).alias(f"b{i}")]
    row = rows.agg(*aggs).first()
    found = {}
    for i, (a, b) in enumerate(pairs):
        size = (row[f"a{i}"] or 0.0) * (row[f"b{i}"] or 0.0)
        found[a, b] = found[b, a] = row[f"c{i}"] / size if size else None
    return literal_table(rows.sparkSession, [("feature_a", T.StringType()), ("feature_b", T.StringType()),
                                             ("correlation", T.DoubleType())], [(a, b, found[a, b]) for a in columns for b in columns])


def standardized_summary(rows: DataFrame, is_train: Column, columns: Sequence[str]) -> DataFrame:
    """``feature, split, mean_z, std_z`` of the columns standardized with the training rows' mean and population
    deviation: 0 and 1 on the training rows, the drift of the others.  One aggregation by split."""
    columns = list(columns)
    aggs = [f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = {r["split"]: r for r in rows.groupBy(F.when(is_train, "train").otherwise("test").alias("split")).agg(*aggs).collect()}
    out, train = [], got.get("train")
    for i, c in enumerate(columns):
        for split, r in sorted(got.items()):
            if train is None or train[f"m{i}"] is None:
                out.append((c, split, None, None))
                continue
            scale = train[f"s{i}"] or 1.0
            out.append((c, split, None if r[f"m{i}"] is None else (r[f"m{i}"] - train[f"m{i}"]) / scale,
                        None if r[f"s{i}"] is None else r[f"s{i}"] / scale))
    return literal_table(rows.sparkSession, [("feature", T.StringType()), ("split", T.StringType()), ("mean_z", T.DoubleType()),
                                             ("std_z", T.DoubleType())], out)


def scorecard(rows: DataFrame, split: Column, predictions: dict[str, Column], label: str, label_log: str) -> DataFrame:
    """``model, split, scale, metric, value`` of several predictions (log scale) from one scan: every row is expanded
    to one for each model, and the models are part of the aggregation's key."""
    each = F.array(*[F.struct(F.lit(name).alias("model"), p.cast("double").alias("p")) for name, p in predictions.items()])
    long = rows.select(split.alias("_split"), label, label_log, F.explode(each).alias("_e"))
    long = long.select(F.concat_ws("|", F.col("_split"), F.col("_e.model")).alias("split"), label, label_log, F.col("_e.p").alias("_p"))
    table = metric_table(long, label, label_log, "_p")
    return table.select(F.substring_index("split", "|", -1).alias("model"), F.substring_index("split", "|", 1).alias("split"),
                        "scale", "metric", "value")


def metrics_by_name(table: DataFrame, name: str) -> DataFrame:
    """One model's metrics; an unknown name is an error that lists the names."""
    found = table.where(F.col("model") == name)
    if found.isEmpty():
        names = sorted(r["model"] for r in table.select("model").distinct().collect())
        raise KeyError(f"no metrics of model {name!r}; there are {names}")
    return found
