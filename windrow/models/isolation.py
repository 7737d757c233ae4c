"""Isolation forest: trees grown in parallel on small samples, scored everywhere.

Each tree is one group of at most 256 sampled rows, as the method prescribes; the
grown trees are a model of fixed size (trees x 511 nodes) sent to all tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.ordered import ordered_scan
from windrow.operators.reports import percentiles
from windrow.operators.sampling import hash_of, sample_n
from windrow.storage import materialize, ship_package

TREES, SAMPLE, CONTAMINATION = 200, 256, 0.05
_NODES = "tree int, node int, feature int, cut double, left int, right int, length double"


def _mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grower(seed: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = np.vstack(rows.sort_values("_rank")["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes = []

        def split(idx: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            low, high = x[idx].min(axis=0), x[idx].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(idx) <= 1 or not len(usable):
                nodes[at] = (tree, at, -1, 0.0, -1, -1, depth + _mean_path(len(idx)))
                return at
            f = int(rng.choice(usable))
            # Rounding may give the upper end itself, which would leave one side empty.
            cut = min(float(rng.uniform(low[f], high[f])), float(np.nextafter(high[f], low[f])))
            goes_left = x[idx, f] <= cut
            left, right = split(idx[goes_left], depth + 1), split(idx[~goes_left], depth + 1)
            nodes[at] = (tree, at, f, cut, left, right, 0.0)
            return at

        split(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "length"])

    return grow


@dataclass
class IsolationForest:
    """Grown trees, the expected path length of the sample size, and the offset."""

    trees: list[dict[str, np.ndarray]]
    expected: float
    offset: float = 0.0

    def score(self, rows: DataFrame, features: str = "x") -> DataFrame:
        """Add ``score`` (higher = more anomalous) and ``pred`` (1 = anomaly)."""
        spark = rows.sparkSession
        model = spark.sparkContext.broadcast((self.trees, self.expected))

        @F.pandas_udf("double")
        def isolation(batches: pd.Series) -> pd.Series:
            trees, expected = model.value
            x = np.vstack(batches.to_numpy())
            total = np.zeros(len(x))
            for t in trees:
                at = np.zeros(len(x), dtype=np.int64)
                inner = t["feature"][at] >= 0
                while inner.any():
                    here = at[inner]
                    value = x[np.flatnonzero(inner), t["feature"][here]]
                    at[inner] = np.where(value <= t["cut"][here], t["left"][here], t["right"][here])
                    inner = t["feature"][at] >= 0
                total += t["length"][at]
            return pd.Series(2.0 ** (-(total / len(trees)) / expected))

        # sample score = -2^(-E/c); decision = sample score - offset; anomaly if decision < 0
        raw = rows.withColumn("_raw", isolation(F.col(features)))
        return raw.withColumn("score", F.col("_raw") + self.offset).withColumn(
            "pred", (F.col("score") > 0).cast("int")
        ).drop("_raw")


    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and offset as one small table, replacing what was there."""
        rows = [
            (i, n, *(float(t[c][n]) for c in ("feature", "cut", "left", "right", "length")))
            for i, t in enumerate(self.trees) for n in range(len(t["feature"]))
        ]
        nodes = spark.createDataFrame(rows, "tree int, node int, feature double, cut double, left double, right double, length double")
        nodes.withColumns({"expected": F.lit(self.expected), "offset": F.lit(self.offset)}).coalesce(1).write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        nodes = spark.read.parquet(path).toPandas().sort_values(["tree", "node"])
        trees = [
            {c: g[c].to_numpy(dtype=kind) for c, kind in zip(("feature", "cut", "left", "right", "length"), (int, float, int, int, float))}
            for _, g in nodes.groupby("tree")
        ]
        return cls(trees, float(nodes["expected"].iloc[0]), float(nodes["offset"].iloc[0]))


def train_isolation_forest(
    normal: DataFrame, key: list[str], *, features: str = "x", trees: int = TREES, sample: int = SAMPLE,
    contamination: float = CONTAMINATION, seed: int = 42,
) -> IsolationForest:
    """Fit on normal windows; the offset flags the ``contamination`` share of them.

    Sampled windows are ranked by hash once, and each tree takes the next ``sample`` ranks, from
    the start again when they run out; so exactly trees x sample vectors are sent on.
    """
    spark = normal.sparkSession
    ship_package(spark)
    h = hash_of(seed, key)
    digits = {"_h1": F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), "_h2": F.conv(F.substring(h, 16, 15), 16, 10).cast("long")}
    base = materialize(
        sample_n(normal.select(*key, F.col(features).alias("x")), key, trees * sample, seed).withColumns(digits), "isolation")
    n = base.count()
    size = min(sample, n)
    ranked = ordered_scan(base, [], ["_h1", "_h2"], seq="_rank")
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("_rank") - t * size, F.lit(max(n, 1))) < size)
    picked = ranked.select("x", "_rank", F.explode(mine).alias("tree"))
    grown = picked.groupBy("tree").applyInPandas(_grower(seed), _NODES).toPandas()
    built = [
        {c: g[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")}
        for _, g in grown.sort_values(["tree", "node"]).groupby("tree")
    ]
    model = IsolationForest(built, _mean_path(size) or 1.0)
    scored = model.score(normal.select(*key, F.col(features).alias("x"))).withColumn("_all", F.lit(1))
    # score is minus the sample score here, so its upper percentile is the offset.
    scored = materialize(scored.select(*key, "score", "_all"), "isolation-scores")
    top = percentiles(scored, "score", {"p": 1 - contamination}, ["_all"], key).first()
    model.offset = -float(top["p"])
    return model
