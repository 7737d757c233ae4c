"""Forests whose trees live in a table: grown, scored and cross-validated by tasks, never held by the driver.

Features are binned as MLlib bins them, by at most 32 bins with bounds from a sample of rows. The
binned rows are written once, a byte per value and some thousand rows a block. Every block goes to
every growing task, which grows its share of the trees level by level: a row's bootstrap count is a
Poisson draw that follows from seed, tree and block, a node looks at a random choice of the features
and takes the split of largest Gini gain. A tree is one row of the forest's table. Rows are scored
in groups of blocks against groups of trees, and a search adds up its validation rows where their
trees are grown.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.storage import materialize, ship_package

BINS = 32
SAMPLED = 10_000
# Tasks that grow trees, histogram cells filled at a time.
UNITS = 64
CELLS = 1 << 16
# Rows whose bins are counted or followed at a time.
RUN = 1 << 15
# What a row of attack weighs in sums that count both labels.
ATTACK = 1 << 31
# Deeper than any tree.
DEEP = 1 << 30
# Rows scored by one task against one group of trees, and bytes of such a group.
GROUP_ROWS, GROUP_BYTES = 1 << 20, 16 << 20
ID = "_row"


@dataclass(frozen=True)
class Job:
    """A tree to grow: the fold it leaves out (-1: none), its leaf size, its number and the depths it is wanted at.

    It serves every forest of that fold and leaf size that has so many trees; ``upto`` is how many the smallest of these has.
    """

    fold: int
    leaf: int
    tree: int
    depths: tuple[int, ...]
    upto: int


def bin_bounds(vectors: DataFrame, rows: int, seed: int) -> list[np.ndarray]:
    """For every feature the values at which its bins end, from a sample of about ``SAMPLED`` rows."""
    share = min(1.0, 1.2 * SAMPLED / max(rows, 1))
    values = vectors.select(vector_to_array("features").alias("x"))
    sample = (values.sample(share, seed) if share < 1 else values).toArrow().column(0)
    x = _matrix(sample.combine_chunks() if sample.num_chunks != 1 else sample.chunk(0))
    bounds = []
    for column in x.T:
        distinct = np.unique(column)
        if len(distinct) > BINS:
            cuts = np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))
            at = np.unique(np.searchsorted(distinct, cuts))
            at = at[at < len(distinct) - 1]
        else:
            at = np.arange(len(distinct) - 1)
        bounds.append((distinct[at] + distinct[at + 1]) / 2)
    return bounds


def _matrix(arrays: pa.Array) -> np.ndarray:
    return np.asarray(arrays.flatten(), np.float64).reshape(len(arrays), -1)


def _binned(arrays: pa.Array, bounds: list[np.ndarray]) -> bytes:
    x = _matrix(arrays)
    out = np.empty(x.shape, np.uint8)
    for i, cuts in enumerate(bounds):
        out[:, i] = np.searchsorted(cuts, x[:, i])
    return out.tobytes()


def blocks_of(vectors: DataFrame, bounds: list[np.ndarray], *, labels: bool) -> DataFrame:
    """block, n, x and, of rows to learn from, y and fold: some thousand rows in each."""
    ship_package(vectors.sparkSession)
    extra = [F.col("label").cast("byte").alias("y"), (F.col("fold") if "fold" in vectors.columns else F.lit(-1)).cast("byte").alias("fold")]
    rows = vectors.select(vector_to_array("features").alias("x"), *(extra if labels else [F.col(ID)]))

    def run(batches: Iterable[pa.RecordBatch]):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                rest = [np.ascontiguousarray(np.asarray(c)).tobytes() for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([batch.num_rows], pa.int32()),
                     *[pa.array([v], pa.binary()) for v in (_binned(batch.column(0), bounds), *rest)]], names=names)
                block += 1

    names = ["block", "n", "x", *(["y", "fold"] if labels else ["ids"])]
    kinds = {"block": "long", "n": "int"}
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'binary')}" for n in names))


def _choices(rng, nodes: int, n_features: int, some: int) -> np.ndarray:
    """Per node ``some`` different features."""
    if some >= n_features:
        return np.broadcast_to(np.arange(n_features), (nodes, n_features))
    return np.argpartition(rng.random((nodes, n_features), np.float32), some - 1, axis=1)[:, :some]


def _runs(edges: np.ndarray):
    """Runs of rows that lie in order of their nodes: from, to, first node, last node, and each row's node from the first on.

    The last is None where all rows of the run are in one node.
    """
    for a in range(edges[0], edges[-1], RUN):
        b = min(a + RUN, edges[-1])
        i, j = int(np.searchsorted(edges, a, "right")) - 1, int(np.searchsorted(edges, b, "left"))
        yield a, b, i, j, None if j - i == 1 else np.repeat(np.arange(j - i), np.diff(np.clip(edges[i:j + 1], a, b)))


def _of_feature(x: np.ndarray, feature: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Every row's value of its node's feature."""
    n, n_features = x.shape
    return x.reshape(-1).take(np.arange(0, n * n_features, n_features) + feature.take(nodes), mode="wrap")


def _histograms(x, w, edges: np.ndarray, features: np.ndarray, n_bins: int) -> np.ndarray:
    """The sum of the rows' weights by node, chosen feature and bin."""
    k, some = features.shape
    sums = np.zeros((k, some, n_bins), np.int64)
    for a, b, i, j, nodes in _runs(edges):
        for s in range(some):
            code = x[a:b, features[i, s]] if nodes is None else nodes * n_bins + _of_feature(x[a:b], features[i:j, s], nodes)
            sums[i:j, s] += np.bincount(code, w[a:b], (j - i) * n_bins).astype(np.int64).reshape(-1, n_bins)
    return sums


def _best_splits(sums: np.ndarray, n0, n1, features: np.ndarray, weights, leaf: int):
    """Of nodes the feature, last bin on the left, gain (-1: no split) and counts of both labels on the left.

    Only bins that hold rows are looked at, as a cut behind an empty one splits as the cut before it does.
    """
    k, some, n_bins = sums.shape
    filled = np.flatnonzero(sums)
    line = filled // n_bins
    node = line // some
    # A running sum over all lines, less what the lines before hold.
    totals = np.repeat((n1 * ATTACK + n0).astype(np.int64), some)
    left = np.cumsum(sums.reshape(-1).take(filled)) - (np.cumsum(totals) - totals).take(line)
    l0, l1 = (left & (ATTACK - 1)).astype(float), (left >> ATTACK.bit_length() - 1).astype(float)
    r0, r1 = n0.take(node) - l0, n1.take(node) - l1
    a, b, d, e = weights[0] * l0, weights[1] * l1, weights[0] * r0, weights[1] * r1
    # The weight of a side times its Gini impurity, halved.
    after = a * b / np.maximum(a + b, 1e-300) + d * e / np.maximum(d + e, 1e-300)
    after[(l0 + l1 < leaf) | (r0 + r1 < leaf)] = np.inf
    least = np.minimum.reduceat(after, np.searchsorted(node, np.arange(k)))
    best = np.flatnonzero(after == least.take(node))
    best = best[np.diff(node.take(best), prepend=-1) > 0]  # the first one of equals
    t0, t1 = weights[0] * n0, weights[1] * n1
    gain = t0 * t1 / (t0 + t1) - after[best]
    # What rounding leaves of no gain at all is none.
    gain = np.where(gain > 1e-12 * (t0 + t1), gain, -1.0)
    return features[np.arange(k), line[best] % some], filled[best] % n_bins, gain, l0[best], l1[best]


def grow(x: np.ndarray, y: np.ndarray, c: np.ndarray, weights, n_bins: int, depth: int, leaf: int, rng):
    """A tree on binned rows, each counted ``c`` times: feature (-1: a leaf), cut, left child, value; and gain by feature.

    Rows with a bin up to the cut go left; the right child follows the left one. A leaf's value is
    the weight of attack in it, and so is that of an inner node: a tree of less depth is this one cut off
    there. Rows are kept in the order of their nodes, so that each level reads them from first to last.
    """
    n_features = x.shape[1]
    some = max(1, math.ceil(math.sqrt(n_features)))
    gains = np.zeros(n_features)
    n0, n1 = np.array([c[y == 0].sum()], float), np.array([c[y == 1].sum()], float)
    # One sum holds both labels' counts: of a run exactly as a double, of all runs as a long.
    w = np.where(y == 1, c * ATTACK, c).astype(float)
    edges, open_ids, allocated = np.array([0, len(x)]), np.zeros(1, np.int64), 1
    parts = [_new_nodes(n0, n1, weights)]
    if not _open(n0, n1, leaf)[0]:
        open_ids = open_ids[:0]
    splits = []
    per = max(1, CELLS // (some * n_bins))
    for _ in range(depth if n_bins > 1 else 0):
        if not len(open_ids):
            break
        next_x, next_w, filled = np.empty((edges[-1], n_features), np.uint8), np.empty(edges[-1]), 0
        sizes, ids, c0, c1 = [], [], [], []
        for first in range(0, len(open_ids), per):
            last = min(first + per, len(open_ids))
            here = edges[first:last + 1]
            features = _choices(rng, last - first, n_features, some)
            sums = _histograms(x, w, here, features, n_bins)
            feature, cut, gain, l0, l1 = _best_splits(sums, n0[first:last], n1[first:last], features, weights, leaf)
            split = gain > 0
            np.add.at(gains, feature[split], gain[split])
            child = allocated + 2 * np.arange(int(split.sum()))
            allocated += 2 * len(child)
            splits.append((open_ids[first:last][split], feature[split], cut[split], child))
            m0, m1 = (np.stack([left, total - left], 1)[split].ravel() for left, total in ((l0, n0[first:last]), (l1, n1[first:last])))
            parts.append(_new_nodes(m0, m1, weights))
            live = _open(m0, m1, leaf)
            to, size = _places(x, here, feature, cut, split, live)
            order = np.argsort(to, kind="stable")[:size.sum()]
            end = filled + len(order)
            x[here[0]:here[-1]].take(order, axis=0, out=next_x[filled:end], mode="clip")
            w[here[0]:here[-1]].take(order, out=next_w[filled:end], mode="clip")
            filled = end
            sizes.append(size)
            ids.append(np.stack([child, child + 1], 1).ravel()[live])
            c0.append(m0[live])
            c1.append(m1[live])
        x, w = next_x, next_w
        open_ids, n0, n1 = (np.concatenate(v) for v in (ids, c0, c1))
        edges = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    feature, cut, left, value = (np.concatenate(v) for v in zip(*parts))
    for at, f, t, child in splits:
        feature[at], cut[at], left[at] = f, t, child
    return feature, cut, left, value, gains


def _new_nodes(n0, n1, weights):
    share = weights[1] * n1 / np.maximum(weights[0] * n0 + weights[1] * n1, 1e-300)
    return np.full(len(n0), -1, np.int16), np.zeros(len(n0), np.uint8), np.zeros(len(n0), np.int32), share


def _open(n0, n1, leaf: int):
    """Which nodes may be split further."""
    return (n0 > 0) & (n1 > 0) & (n0 + n1 >= 2 * leaf)


def _places(x, edges: np.ndarray, feature, cut, split, live):
    """Every row's number among the live children, theirs behind the last for rows that stay; and the children's rows."""
    n_live = int(live.sum())
    kind = np.uint8 if n_live < 1 << 8 else np.uint16 if n_live < 1 << 16 else np.int64  # short ones are sorted by digits
    place = np.full((len(split), 2), n_live, kind)
    place[split] = np.where(live, np.cumsum(live) - 1, n_live).reshape(-1, 2)
    to = np.empty(edges[-1] - edges[0], kind)
    for a, b, i, j, nodes in _runs(edges):
        if nodes is None:
            found = np.where(x[a:b, feature[i]] > cut[i], place[i, 1], place[i, 0])
        else:
            right = _of_feature(x[a:b], feature[i:j], nodes) > cut[i:j].take(nodes)
            found = place[i:j].reshape(-1).take(2 * nodes + right)
        to[a - edges[0]:b - edges[0]] = found
    return to, np.bincount(to, minlength=n_live + 1)[:n_live]


def values_of(tree, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each binned row ends in."""
    return values_at(tree, x, [DEEP])[0]


def values_at(tree, x: np.ndarray, depths: list[int]) -> np.ndarray:
    """A line of values for the tree cut off at each of ``depths``, which ascend."""
    feature, cut, left, value = tree
    n, n_features = x.shape
    flat, out = x.reshape(-1), np.empty((len(depths), n))
    for a in range(0, n, RUN):
        b = min(a + RUN, n)
        end, rows, at = np.zeros(b - a, np.int64), np.arange(b - a), np.zeros(b - a, np.int64)
        level = 0
        for i, depth in enumerate(depths):
            while len(rows) and level < depth:
                f = feature.take(at)
                on = np.flatnonzero(f >= 0)
                if len(on) < len(rows):
                    end[rows] = at
                    rows, at, f = rows.take(on), at.take(on), f.take(on)
                right = flat.take((rows + a) * n_features + f, mode="clip") > cut.take(at)
                at = left.take(at) + right
                level += 1
            end[rows] = at
            out[i, a:b] = value.take(end)
    return out


class _Rows:
    """All blocks a growing task was given."""

    def __init__(self, batches: Iterable[pa.RecordBatch], n_features: int):
        block, n, x, y, fold = [], [], [], [], []
        for batch in batches:
            block += batch.column("block").to_pylist()
            n += batch.column("n").to_pylist()
            x += [np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column("x")]
            y += [np.frombuffer(v.as_buffer(), np.int8) for v in batch.column("y")]
            fold += [np.frombuffer(v.as_buffer(), np.int8) for v in batch.column("fold")]
        self.blocks, self.n = block, n
        self.x = np.concatenate(x).reshape(-1, n_features) if x else np.zeros((0, n_features), np.uint8)
        self.y, self.fold = (np.concatenate(v) if v else np.zeros(0, np.int8) for v in (y, fold))

    def counts(self, seed: int, tree: int) -> np.ndarray:
        """How often the bootstrap of a tree drew each row."""
        return np.concatenate([np.random.default_rng([seed, tree, b]).poisson(1.0, n) for b, n in zip(self.blocks, self.n)])

    def tree(self, job: Job, weights, n_bins: int, seed: int):
        c = self.counts(seed, job.tree)
        if job.fold >= 0:
            c[self.fold == job.fold] = 0
        drawn = np.flatnonzero(c)
        rng = np.random.default_rng([seed, job.tree, 1, 0])
        return grow(self.x[drawn], self.y[drawn], c[drawn], weights, n_bins, job.depths[-1], job.leaf, rng)


def _dealt(blocks: DataFrame, jobs: list[Job]) -> tuple[DataFrame, list[list[Job]]]:
    """Every block for every unit, a unit a partition; and the units' jobs, neighbours together."""
    units = min(len(jobs), UNITS)
    edges = [len(jobs) * i // units for i in range(units + 1)]
    spread = blocks.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))
    spread = spread.repartitionById(units, F.col("unit")).sortWithinPartitions("unit", "block")
    return spread, [jobs[a:b] for a, b in zip(edges[:-1], edges[1:])]


@dataclass
class Forest:
    """A fitted forest: the table of its trees, the bounds of its bins."""

    trees: DataFrame
    bounds: list[np.ndarray]

    @property
    def n_features(self) -> int:
        return len(self.bounds)

    def importances(self) -> np.ndarray:
        """Gini gain by feature, as a share of each tree's, then of all trees'."""
        total = F.aggregate("gains", F.lit(0.0), lambda s, v: s + v)
        shares = self.trees.select("tree", F.posexplode(F.transform("gains", lambda g: F.when(total > 0, g / total).otherwise(0.0))).alias("f", "share"))
        out = np.zeros(self.n_features)
        for r in shares.groupBy("f").agg(F.sum("share").alias("s")).collect():
            out[r["f"]] = r["s"]
        return out / out.sum() if out.sum() > 0 else out

    def save(self, spark: SparkSession, path: str) -> None:
        self.trees.write.parquet(f"{path}/trees")
        line = json.dumps([b.tolist() for b in self.bounds])
        spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.text(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        bounds = json.loads(spark.read.text(f"{path}/bounds").first()["value"])
        return cls(spark.read.schema(TREE).parquet(f"{path}/trees"), [np.asarray(b, np.float64) for b in bounds])

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Add ``probability``: the mean over the trees of the attack's weight in the row's leaf."""
        rows = materialize(vectors.withColumn(ID, F.monotonically_increasing_id()), "rows")
        blocks = materialize(blocks_of(rows, self.bounds, labels=False), "blocks")
        size = self.trees.agg(F.count(F.lit(1)).alias("n"), F.sum("nodes").alias("nodes")).first()
        per = max(1, int(GROUP_BYTES / (15 * size["nodes"] / size["n"])))
        groups = math.ceil((blocks.agg(F.sum("n")).first()[0] or 0) / GROUP_ROWS) or 1
        tree_groups = math.ceil(size["n"] / per)
        group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
        kinds = ["feature", "cut", "left", "value"]
        models = self.trees.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("rows"), F.floor(F.col("tree") / per).cast("int").alias("trees"),
            F.lit(0).alias("kind"), F.col("tree").cast("long").alias("id"), *kinds)
        nothing = [F.lit(None).cast("binary").alias(k) for k in kinds[2:]]
        asked = blocks.select(
            group.alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(tree_groups - 1))).alias("trees"), F.lit(1).alias("kind"),
            F.col("block").alias("id"), F.col("x").alias("feature"), F.col("ids").alias("cut"), *nothing)
        pairs = models.union(asked).repartition("rows", "trees").sortWithinPartitions("rows", "trees", "kind", "id")
        n_features, n_trees = self.n_features, size["n"]

        def score(batches: Iterable[pa.RecordBatch]):
            now, held = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    r, t, kind, ident = (batch.column(k)[i].as_py() for k in range(4))
                    if (r, t) != now:
                        now, held = (r, t), []
                    if kind == 0:
                        held.append(tuple(
                            np.frombuffer(batch.column(4 + k)[i].as_buffer(), dtype) for k, dtype in enumerate((np.int16, np.uint8, np.int32, np.float64))))
                        continue
                    x = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(-1, n_features)
                    sums = np.zeros(len(x))
                    for tree in held:
                        sums += values_of(tree, x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ident]), pa.array([t], pa.int32()), batch.column(5).slice(i, 1).cast(pa.binary()), pa.array([sums.tobytes()], pa.binary())],
                        names=["block", "trees", "ids", "sums"])

        parts = pairs.mapInArrow(score, "block long, trees int, ids binary, sums binary")
        parts = parts.repartition("block").sortWithinPartitions("block", "trees")

        def add(batches: Iterable[pa.RecordBatch]):
            block = ids = total = None
            for batch in batches:
                for i in range(batch.num_rows):
                    sums = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64)
                    if batch.column(0)[i].as_py() == block:
                        total = total + sums
                        continue
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total / n_trees)], names=[ID, "probability"])
                    block, ids, total = batch.column(0)[i].as_py(), np.frombuffer(batch.column(2)[i].as_buffer(), np.int64), sums
            if block is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total / n_trees)], names=[ID, "probability"])

        return rows.join(parts.mapInArrow(add, f"{ID} long, probability double"), ID).drop(ID)


TREE = "tree int, nodes long, feature binary, cut binary, left binary, value binary, gains array<double>"


def fit(vectors: DataFrame, sizes: dict[int, int], weights, *, trees: int, depth: int, leaf: int, seed: int) -> Forest:
    """A forest on all rows; its trees are written where they were grown."""
    if not sizes:
        raise ValueError("there are no rows to learn from")
    vectors = materialize(vectors.select("features", "label"), "learned")
    bounds = bin_bounds(vectors, sum(sizes.values()), seed)
    blocks = materialize(blocks_of(vectors, bounds, labels=True), "blocks")
    return _fit(blocks, bounds, weights, trees=trees, depth=depth, leaf=leaf, seed=seed)


def _fit(blocks: DataFrame, bounds, weights, *, trees: int, depth: int, leaf: int, seed: int) -> Forest:
    spread, deals = _dealt(blocks, [Job(-1, leaf, t, (depth,), trees) for t in range(trees)])
    n_bins, n_features = 1 + max((len(b) for b in bounds), default=0), len(bounds)

    def run(batches: Iterable[pa.RecordBatch]):
        rows = _Rows(batches, n_features)
        for job in deals[TaskContext.get().partitionId()]:
            *parts, gains = rows.tree(job, weights, n_bins, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([job.tree], pa.int32()), pa.array([len(parts[0])], pa.int64()),
                 *[pa.array([p.tobytes()], pa.binary()) for p in parts], pa.array([gains], pa.list_(pa.float64()))],
                names=["tree", "nodes", "feature", "cut", "left", "value", "gains"])

    return Forest(materialize(spread.mapInArrow(run, TREE), "forest"), bounds)


def _jobs(points: list[dict], folds: int) -> list[Job]:
    """The trees that all points and folds are made of, each once.

    A tree's draws follow from its number alone. So a forest of fewer trees is the first ones of a larger
    one, and a tree of less depth is the upper part of a deeper one: points that differ in these only share them.
    """
    jobs = []
    for fold in range(folds):
        for leaf in dict.fromkeys(p["leaf"] for p in points):
            alike = [p for p in points if p["leaf"] == leaf]
            for tree in range(max(p["trees"] for p in alike)):
                larger = [p for p in alike if p["trees"] > tree]
                jobs.append(Job(fold, leaf, tree, tuple(sorted({p["depth"] for p in larger})), min(p["trees"] for p in larger)))
    return jobs


def search(folded: DataFrame, sizes: dict[int, int], weights, points: list[dict], *, folds: int, seed: int):
    """F1 of attack of every point and fold, as an array of points x folds; and a function that fits a point on all rows.

    A point names trees, depth and leaf. Each tree scores the rows its fold leaves out where it is
    grown, once for every depth; what leaves a task is one sum a row, depth and size of forest.
    """
    if not sizes:
        raise ValueError("there are no rows to learn from")
    bounds = bin_bounds(folded, sum(sizes.values()), seed)
    blocks = materialize(blocks_of(folded, bounds, labels=True), "blocks")
    n_bins, n_features = 1 + max((len(b) for b in bounds), default=0), len(bounds)
    spread, deals = _dealt(blocks, _jobs(points, folds))
    asked = {(p["leaf"], p["depth"], p["trees"]) for p in points}

    def run(batches: Iterable[pa.RecordBatch]):
        rows = _Rows(batches, n_features)
        for _, together in itertools.groupby(deals[TaskContext.get().partitionId()], lambda job: (job.fold, job.leaf, job.upto)):
            first, sums = None, 0.0
            for job in together:
                if first is None:
                    first, out = job, rows.fold == job.fold
                    held = rows.x[out]
                *tree, _ = rows.tree(job, weights, n_bins, seed)
                sums += values_at(tree, held, job.depths)
            for depth, of_depth in zip(first.depths, sums):
                yield from _sums(rows, first, depth, out, of_depth)

    def _sums(rows, job, depth, out, sums):
        at = start = 0
        for block, n in zip(rows.blocks, rows.n):
            here = out[start:start + n]
            m = int(here.sum())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int64()) for v in (job.fold, job.leaf, depth, block, job.tree, job.upto)),
                 pa.array([rows.y[start:start + n][here].tobytes()], pa.binary()), pa.array([sums[at:at + m].tobytes()], pa.binary())],
                names=[*group, "tree", "upto", "y", "sums"])
            at, start = at + m, start + n

    group = ["fold", "leaf", "depth", "block"]
    parts = spread.mapInArrow(run, "fold long, leaf long, depth long, block long, tree long, upto long, y binary, sums binary")
    parts = parts.repartition(*group).sortWithinPartitions(*group, "tree")

    def judge(batches: Iterable[pa.RecordBatch]):
        now = total = last = None
        for row in (r for b in batches for r in b.to_pylist()):
            key, sums = tuple(row[k] for k in group), np.frombuffer(row["sums"], np.float64)
            # A forest is judged when its last trees are added.
            if last is not None and (key, row["upto"]) != (now, last["upto"]):
                yield from judged(last, total)
            now, total, last = key, total + sums if key == now else sums, row
        if last is not None:
            yield from judged(last, total)

    def judged(row, total):
        if (row["leaf"], row["depth"], row["upto"]) not in asked:
            return
        # Of equal votes the first label wins.
        said, so = total / row["upto"] > 0.5, np.frombuffer(row["y"], np.int8) == 1
        counts = [int((said & so).sum()), int((said & ~so).sum()), int((~said & so).sum())]
        found = (row["fold"], row["leaf"], row["depth"], row["upto"], *counts)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in found], names=[*forest, *right])

    forest, right = ["fold", "leaf", "depth", "trees"], ["tp", "fp", "fn"]
    found = parts.mapInArrow(judge, ", ".join(f"{c} long" for c in [*forest, *right])).groupBy(*forest).agg(*[F.sum(c).alias(c) for c in right])
    reached = {}
    for r in found.collect():  # one row a point and fold
        wrong = r["fp"] + r["fn"]
        reached[tuple(r[c] for c in forest)] = 2 * r["tp"] / (2 * r["tp"] + wrong) if r["tp"] else 0.0
    f1 = np.array([[reached.get((f, p["leaf"], p["depth"], p["trees"]), 0.0) for f in range(folds)] for p in points])
    return f1, lambda point: _fit(blocks, bounds, weights, **point, seed=seed)
