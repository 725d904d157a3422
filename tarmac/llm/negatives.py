"""Hard negatives by inner product, found in cover trees over norm-augmented vectors.

Candidates get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so all lie on a sphere of
radius M; a query gets 0 there, which leaves its inner products as they are.  With c a node's centre and r
its covering radius, every row x below it is within the angle 2 asin(r / 2M) of c, hence

    |a| M cos(phi + angle) <= <a, x> <= |a| M cos(phi - angle),   phi the angle between a and c.

Every level of a tree covers its rows with radii 1.3 times smaller than the level above (farthest-first nets);
a node keeps the largest distance that really occurs.  A descent takes the nodes of highest bound first, skips
those whose interval misses every window still open (a window's lower end rises to its k-th best score), and
verifies what it reaches with exact integer inner products.

Rows are dealt to shards of about ``SHARD_ROWS``: by the nearest of a bounded sample of pivots, then by a hash
within a pivot, so one vector that fills a third of the table is many shards.  Each shard is one tree, one row of
a written table; blocks of anchors meet the shards by an equi-join on the shard's number, one (block, shard) in
memory at a time.  Local winners meet in windows that keep k per task first.  The pivots are rows too:
the k-th best of an anchor among them is the first lower end of its window for positives.

Inner products are exact 64-bit integers.  Defined results: rows with a NULL id, label or vector, or with a NULL
or non-finite component, take no part; missing trailing components count as 0; rows of equal id are rows of
their own (in the order read); an anchor without positives, or a positive without negatives, has no rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, quoted, written

SCALE = 256
SHARD_ROWS = 4096            # a tree is built from the distances of all its rows, 134 MB
ANCHOR_BLOCK = 512
PIVOTS = 256                 # rows of the sample that deals rows to shards
MAX_TASKS = 20_000
SHRINK = 1.3
FIRST_NODES = 4              # nodes of the first step of a descent; every next step takes twice as many
HIGHEST = np.int64((1 << 63) - 1)
LOWEST = np.int64(-(1 << 63) + 1)


# rows ----------------------------------------------------------------------------------------------

def usable_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``tag`` (unique), ``id``, ``label``, ``v`` (integers), written once."""
    v = quoted(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return written(rows.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & v.isNotNull() & finite)
                   .select(F.monotonically_increasing_id().alias("tag"), quoted(id_col).cast("long").alias("id"),
                           quoted(label_col).alias("label"),
                           F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")), "vectors")


def matrix(vectors, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    sizes = np.array([len(x) for x in vectors], np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes) and sizes.sum():
        flat = np.concatenate([np.asarray(x, np.int64) for x in vectors])
        r = np.repeat(np.arange(len(sizes)), sizes)
        out[r, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact(values: np.ndarray) -> np.ndarray:
    """Floats while every inner product fits their 53 bits, else 64-bit integers."""
    largest = float(np.abs(values).max(initial=0))
    return values.astype(np.float64) if largest * largest * max(values.shape[1], 1) < 2 ** 52 else values


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    if points.dtype == query.dtype == np.float64:
        return (points @ query).astype(np.int64)
    return points.astype(np.int64) @ query.astype(np.int64)


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers begin[0] .. end[0] - 1, begin[1] .. end[1] - 1, and so on."""
    sizes = end - begin
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


# cover tree ----------------------------------------------------------------------------------------

class CoverTree:
    """Nodes in level order, a node's children side by side; every distinct vector is one leaf, whose rows
    (``tag``, ``id``, ``label``, by ascending id) lie at ``member_start`` onwards."""

    FIELDS = ("points", "node", "radius", "child", "member_start", "tag", "id", "label", "top_norm")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.vectors = exact(self.points)[self.node]
        self.leaf = self.child[:-1] == self.child[1:]
        self.norm = float(self.top_norm)
        self.angle = 2 * np.arcsin(np.minimum(1.0, self.radius / (2 * self.norm))) if self.norm else self.radius

    @classmethod
    def build(cls, vectors: np.ndarray, tag: np.ndarray, ids: np.ndarray, label: np.ndarray, top_square: float) -> "CoverTree":
        points, owner = np.unique(vectors, axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        by = np.lexsort((tag, ids, owner))
        member_start = np.searchsorted(owner[by], np.arange(len(points) + 1))
        x = points.astype(np.float64)
        lift = np.sqrt(np.maximum(0.0, top_square - (x * x).sum(axis=1)))
        top = top_square ** 0.5
        full = np.column_stack((x, lift))
        distance = full @ full.T
        distance *= -2.0
        distance += 2 * top_square
        np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
        distance += 1e-5 * top                         # covers the rounding
        np.fill_diagonal(distance, 0.0)
        node, radius, child = [int(distance.sum(axis=1).argmin())], [], [1]
        todo = deque([np.arange(len(points))])
        while todo:
            below, centre = todo.popleft(), node[len(radius)]
            near = distance[centre, below]
            radius.append(near.max())
            if len(below) > 1:
                reach, centres, part = radius[-1] / SHRINK, [centre], np.zeros(len(below), np.int64)
                if reach > 4e-5 * top:
                    while True:
                        k = int(near.argmax())
                        if near[k] <= reach:
                            break
                        other = distance[below[k], below]
                        closer = other < near
                        near = np.where(closer, other, near)
                        part[closer] = len(centres)
                        centres.append(int(below[k]))
                else:                                  # nothing left to tell apart: one child each
                    centres, part = below.tolist(), np.arange(len(below))
                todo.extend(np.split(below[np.argsort(part, kind="stable")], np.cumsum(np.bincount(part))[:-1]))
                node.extend(centres)
            child.append(len(node))
        return cls(points=points, node=np.array(node), radius=np.array(radius), child=np.array(child),
                   member_start=member_start, tag=tag[by], id=ids[by], label=label[by], top_norm=np.array(top))

    def pack(self) -> bytes:
        out = io.BytesIO()
        small = np.int32 if np.abs(self.points).max(initial=0) < 1 << 31 else np.int64
        np.savez(out, **{n: getattr(self, n) if n != "points" else self.points.astype(small) for n in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> "CoverTree":
        with np.load(io.BytesIO(data)) as z:
            arrays = {n: z[n] for n in cls.FIELDS}
        return cls(**arrays | {"points": arrays["points"].astype(np.int64)})

    def find(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, label: int, same: bool,
             skip_tag: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, int]:
        """Per window the positions of its first k rows (by score, then id) in the arrays ``member`` and
        ``score``, and the number of inner products.  Rows of the query's label if ``same``, else of all others."""
        size = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.norm
        slack = 1.0 + 1e-7 * size
        least, highest = low.copy(), high.max()
        pool_member, pool_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        chosen = [(0, 0)] * len(low)

        def bounds(nodes: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not size:
                return score + slack, score - slack
            phi = np.arccos(np.clip(score / size, -1.0, 1.0))
            return (size * np.cos(np.maximum(0.0, phi - self.angle[nodes])) + slack,
                    size * np.cos(np.minimum(np.pi, phi + self.angle[nodes])) - slack)

        def meets(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
            out = np.nonzero((upper >= least.min()) & (lower <= highest))[0]
            if len(least) == 1 or not len(out):
                return out
            return out[((upper[out, None] >= least) & (lower[out, None] <= high)).any(axis=1)]

        def verify(leaves: np.ndarray, score: np.ndarray) -> None:
            nonlocal pool_member, pool_score, chosen
            hit = meets(score, score)
            if not len(hit):
                return
            at, score = self.node[leaves[hit]], score[hit]
            member, end = self.member_start[at], self.member_start[at + 1]
            if (end - member > 1).any():
                member, score = spans(member, end), np.repeat(score, end - member)
            fits = ((self.label[member] == label) if same else (self.label[member] != label)) & (self.tag[member] != skip_tag)
            if not fits.any():
                return
            member, score = np.concatenate((pool_member, member[fits])), np.concatenate((pool_score, score[fits]))
            order = np.lexsort((self.tag[member], self.id[member], -score))
            member, score = member[order], score[order]
            begin = np.searchsorted(-score, -high, "left")
            end = np.minimum(begin + k, np.searchsorted(-score, -low, "right"))
            full = np.nonzero(end - begin >= k)[0]
            least[full] = score[end[full] - 1]
            end = np.maximum(begin, end)
            needed = np.unique(spans(begin, end))
            chosen = list(zip(np.searchsorted(needed, begin).tolist(), (end - begin).tolist()))
            pool_member, pool_score = member[needed], score[needed]

        work, step = 1, FIRST_NODES
        nodes = np.zeros(1, np.int64)
        score = products(self.vectors[:1], query)
        if self.leaf[0]:
            verify(nodes, score)
            return [np.arange(b, b + n) for b, n in chosen], pool_member, pool_score, work
        upper, lower = bounds(nodes, score)
        while True:
            open_ = meets(upper, lower)
            nodes, upper, lower = nodes[open_], upper[open_], lower[open_]
            if not len(nodes):
                return [np.arange(b, b + n) for b, n in chosen], pool_member, pool_score, work
            first = np.argpartition(-upper, step)[:step] if len(nodes) > step else np.arange(len(nodes))
            rest = np.ones(len(nodes), bool)
            rest[first] = False
            begin, end = self.child[nodes[first]], self.child[nodes[first] + 1]
            if len(first) == 1:
                below = np.arange(begin[0], end[0])
                score = products(self.vectors[begin[0]:end[0]], query)
            else:
                below = spans(begin, end)
                score = products(self.vectors[below], query)
            work, step = work + len(below), step * 2
            leaf = self.leaf[below]
            if leaf.any():
                verify(below[leaf], score[leaf])
            if not leaf.all():
                inner = below[~leaf]
                up, lo = bounds(inner, score[~leaf])
                nodes = np.concatenate((nodes[rest], inner))
                upper, lower = np.concatenate((upper[rest], up)), np.concatenate((lower[rest], lo))
            else:
                nodes, upper, lower = nodes[rest], upper[rest], lower[rest]


# distributed search --------------------------------------------------------------------------------

class Shards:
    """The trees of all rows (``shard``, ``tree``), their number, and what the searches need besides."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS):
        count, width, top = rows.agg(
            F.count(F.lit(1)), F.max(F.size("v")),
            F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
        self.rows, self.width, self.top_square = rows, width or 0, float(top or 0)
        n = min(PIVOTS, -(-count // shard_rows))
        self.pivots = rows.orderBy(F.xxhash64("tag"), "tag").limit(n).toPandas() if count else None
        self.count = 0
        if not count:
            return
        pivots, width = exact(matrix(self.pivots["v"], self.width)).astype(np.float64), self.width

        def nearest(batches: Batches) -> Batches:
            for batch in batches:
                x = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
                away = (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(away.argmin(axis=1).astype(np.int32))],
                                                 names=["tag", "pivot"])
        placed = written(rows.join(rows.select("tag", "v").mapInArrow(nearest, "tag long, pivot int"), "tag"), "placed")
        per_pivot = placed.groupBy("pivot").count().orderBy("pivot").collect()      # one row a pivot
        offsets = []
        for r in per_pivot:
            parts = -(-r["count"] // shard_rows)
            offsets.append((r["pivot"], self.count, parts))
            self.count += parts
        dealt = F.broadcast(rows.sparkSession.createDataFrame(offsets, "pivot int, first long, parts long"))
        top_square = self.top_square

        def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            tree = CoverTree.build(matrix(part["v"], width), part["tag"].to_numpy(np.int64), part["id"].to_numpy(np.int64),
                                   part["label"].to_numpy(np.int64), top_square)
            return pd.DataFrame({"shard": [key[0]], "tree": [tree.pack()]})
        self.tasks = min(self.count, MAX_TASKS)
        sharded = placed.join(dealt, "pivot").select(
            (F.col("first") + F.pmod(F.xxhash64("tag"), F.col("parts"))).alias("shard"), "tag", "id", "label", "v")
        self.trees = written(sharded.repartition(self.tasks, "shard").groupBy("shard")
                             .applyInPandas(build, "shard long, tree binary"), "trees")

    def meet(self, blocks: DataFrame) -> DataFrame:
        """Every block of anchors with every shard, by an equi-join on the shard's number."""
        pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.count - 1)).cast("array<bigint>")))
        return pairs.repartition(self.tasks, "shard").join(self.trees.repartition(self.tasks, "shard"), "shard")


def _blocks(anchors: DataFrame, n_anchors: int) -> DataFrame:
    """Anchors as lists, about ``ANCHOR_BLOCK`` in a row."""
    block = F.pmod(F.xxhash64("tag"), F.lit(max(1, -(-n_anchors // ANCHOR_BLOCK))))
    return written(anchors.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
                   .select("anchors"), "anchor-blocks")


def _trees(batches: Batches):
    """(anchors, tree) of every row; a shard's tree is unpacked once for blocks that follow each other."""
    shard, tree = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column(1)[i].as_py()
            if number != shard:
                shard, tree = number, CoverTree.unpack(batch.column(2)[i].as_py())
            yield batch.column(0)[i].as_py(), tree


def best_positives(shards: Shards, anchors: DataFrame, n_anchors: int, k: int) -> DataFrame:
    """``tag``, ``place`` (from 1), ``positive_tag``, ``positive_id``, ``positive_score``."""
    pivots, width = shards.pivots, shards.width
    points = exact(matrix(pivots["v"], width))
    own_label, own_tag = pivots["label"].to_numpy(np.int64), pivots["tag"].to_numpy(np.int64)

    def run(batches: Batches) -> Batches:
        for block, tree in _trees(batches):
            out = []
            for a, q in zip(block, exact(matrix([a["v"] for a in block], width))):
                # a valid lower end: the k-th best among the pivots of the anchor's label
                known = products(points, q)[(own_label == a["label"]) & (own_tag != a["tag"])]
                low = np.sort(known)[-k] if len(known) >= k else LOWEST
                picked, member, score, _ = tree.find(q, np.array([low]), np.array([HIGHEST]), k, a["label"], True, a["tag"])
                out += [(a["tag"], int(tree.tag[member[p]]), int(tree.id[member[p]]), int(score[p])) for p in picked[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                             names=["tag", "positive_tag", "positive_id", "positive_score"])
    found = shards.meet(_blocks(anchors, n_anchors)).select("anchors", "shard", "tree").mapInArrow(
        run, "tag long, positive_tag long, positive_id long, positive_score long")
    order = Window.partitionBy("tag").orderBy(F.col("positive_score").desc(), "positive_id", "positive_tag")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 5, low_percent: int = 80,
                   scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each anchor row and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of
    other labels that score from ``low_percent`` percent of the positive's score up to that score.

    ``is_anchor`` is a condition on the column ``id``.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    usable = usable_rows(rows, id_col, vector_col, label_col, scale)
    anchors = usable.where(is_anchor)
    n_anchors = anchors.count()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                     "positive_score long, negative_score long")
    shards = Shards(usable, shard_rows)
    width = shards.width
    best = written(best_positives(shards, anchors, n_anchors, positives), "positives")
    windows = best.groupBy("tag").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("windows"))

    def run(batches: Batches) -> Batches:
        for block, tree in _trees(batches):
            out = []
            for a, q in zip(block, exact(matrix([a["v"] for a in block], width))):
                score = np.array([w["score"] for w in a["windows"]], np.int64)
                low = -((-low_percent * score) // 100)            # the least score with low_percent * positive <= 100 * score
                picked, member, found, _ = tree.find(q, low, score, negatives, a["label"], False, a["tag"])
                out += [(a["tag"], w["place"], int(tree.tag[member[p]]), int(tree.id[member[p]]), int(found[p]))
                        for w, ps in zip(a["windows"], picked) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)],
                                             names=["tag", "place", "negative_tag", "negative_id", "negative_score"])
    asked = anchors.join(windows, "tag").select("tag", "label", "v", "windows")
    found = shards.meet(_blocks(asked, n_anchors)).select("anchors", "shard", "tree").mapInArrow(
        run, "tag long, place long, negative_tag long, negative_id long, negative_score long")
    order = Window.partitionBy("tag", "place").orderBy(F.col("negative_score").desc(), "negative_id", "negative_tag")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return (ranked.join(best, ["tag", "place"]).join(anchors.select("tag", F.col("id").alias("anchor_id")), "tag")
            .select("anchor_id", "positive_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "negative_id",
                    "positive_score", "negative_score"))
