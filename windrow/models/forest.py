"""Random forest on window vectors: fit, score, tune, explain, save."""

from __future__ import annotations

import itertools
import json
import re
import uuid
from dataclasses import dataclass, field, fields

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.scalars import decide
from windrow.functions.weights import Idf
from windrow.models import trees as grown
from windrow.operators.sampling import class_sizes, stratified_folds
from windrow.storage import delete_path, materialize, small_table
from windrow.vocabulary import Vocabulary

# As deep as MLlib trees go; this stands for "no limit".
DEEPEST = 30


def class_weights(sizes: dict[int, int]) -> tuple[float, float]:
    """Weight n / (2 n_c) of a row of either class; 1 for a class without rows."""
    n = sum(sizes.values())
    return tuple(n / (2 * sizes[c]) if sizes.get(c) else 1.0 for c in (0, 1))


def train_forest(vectors: DataFrame, *, trees: int = 200, depth: int = DEEPEST, leaf: int = 1, seed: int = 42):
    sizes = class_sizes(vectors)
    return grown.fit(vectors, sizes, class_weights(sizes), trees=trees, depth=depth, leaf=leaf, seed=seed)


def score_forest(model, vectors: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Add ``probability`` of attack and ``pred``. A model of one class scores 0."""
    scored = model.transform(vectors)
    if isinstance(model, RandomForestClassificationModel):  # stored by an earlier version
        p = F.coalesce(F.get(vector_to_array(F.col("probability")), F.lit(1)), F.lit(0.0))
        scored = scored.withColumn("probability", p).drop("rawPrediction", "prediction")
    return scored.withColumn("pred", decide(F.col("probability"), threshold, strict))


# What MLlib calls the parameters of the search.
POINT = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "leaf"}


def cross_validate(
    vectors: DataFrame, key: list[str], *, grid: dict | None = None, folds: int = 5, trees: int = 200, seed: int = 42,
):
    """Stratified k-fold F1 of attack for every point of ``grid``.

    Returns the model refitted on all rows with the best point, and a list of
    (parameters, mean F1, deviation) in grid order. All points and folds are grown in one job.
    """
    grid = grid or {"numTrees": [trees]}
    named = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    points = [{"trees": trees, "depth": DEEPEST, "leaf": 1, **{POINT[n]: v for n, v in p.items()}} for p in named]
    folded = materialize(stratified_folds(vectors, key, folds, seed).select("label", "features", "fold"), "folds")
    sizes = class_sizes(folded)
    f1, refit = grown.search(folded, sizes, class_weights(sizes), points, folds=folds, seed=seed)
    means = f1.mean(axis=1)
    results = [(p, float(m), float(d)) for p, m, d in zip(named, means, f1.std(axis=1))]
    return refit(points[int(means.argmax())]), results


# The search space: trees x depth x leaf size, 27 points.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [DEEPEST, 10, 20], "minInstancesPerNode": [1, 2, 5]}


def importances(model, vocab: Vocabulary, ngram: int, spark: SparkSession) -> DataFrame:
    """Gini importance of every named feature."""
    values = model.importances()
    rows = [(i, name, float(values[i])) for i, name in enumerate(vocab.feature_names(ngram))]
    return small_table(spark, rows, "feature_idx int, feature string, importance double")


def project_2d(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """All windows on their first two principal components."""
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(vectors)
    xy = vector_to_array(F.col("_pc"))
    return model.transform(vectors).select(*keep, xy[0].alias("x"), xy[1].alias("y"))


@dataclass
class Detector:
    """A fitted forest with all that scoring needs: windows, vocabulary, IDF."""

    model: object
    tokens: list[str]
    critical: list[str]
    window: int = 20
    stride: int = 10
    per_pid: bool = True
    ngram: int = 1
    idf: Idf | None = None
    cv_f1: float | None = None
    params: dict = field(default_factory=dict)
    tuning: list | None = None

    @property
    def vocab(self) -> Vocabulary:
        return Vocabulary.of(self.tokens, self.critical)

    @property
    def n_features(self) -> int:
        return self.vocab.n_features(self.ngram)

    def metadata(self) -> dict:
        meta = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("model", "idf")}
        meta["n_features"] = self.n_features
        meta["n_features_unigram"] = len(self.tokens)
        meta["pairs"] = [list(p) for p in self.vocab.pairs()] if self.ngram >= 2 else []
        meta["idf"] = None if self.idf is None else {"n_windows": self.idf.n_windows, "df": list(self.idf.df)}
        return meta

    def save(self, spark: SparkSession, path: str, isolation=None) -> None:
        """Store a version: parts in a folder of its own, then a manifest that names them.

        The manifest is what ``load`` follows. It is written last, so a save that breaks off leaves the
        version before it in use; parts that the new manifest does not name are deleted afterwards.
        ``isolation`` is an isolation forest to go with the forest; without one, none is left to load.
        """
        version = uuid.uuid4().hex
        self.model.save(spark, f"{path}/{version}/forest")
        if isolation is not None:
            isolation.save(spark, f"{path}/{version}/isolation")
        manifest = {
            "version": version, "forest": f"{version}/forest", "trees": "table", "isolation": f"{version}/isolation" if isolation is not None else None,
            "detector": self.metadata(),
        }
        before = [m for m in _folders(spark, path) if m.startswith(MANIFEST)]
        number = 1 + max((int(m.removeprefix(MANIFEST)) for m in before), default=0)
        line = spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1)
        line.write.text(f"{path}/{MANIFEST}{number:09d}")
        for name in _folders(spark, path):
            stored = name.startswith(MANIFEST) or re.fullmatch("[0-9a-f]{32}", name)
            if stored and name not in (version, f"{MANIFEST}{number:09d}"):
                delete_path(spark, f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Detector":
        manifest = _manifest(spark, path)
        meta = manifest["detector"]
        idf = meta.pop("idf")
        for derived in ("n_features", "n_features_unigram", "pairs"):
            meta.pop(derived)
        stored = f"{path}/{manifest['forest']}"
        return cls(
            model=grown.Forest.load(spark, stored) if "trees" in manifest else RandomForestClassificationModel.load(stored),
            idf=Idf(idf["n_windows"], tuple(idf["df"])) if idf else None, **meta,
        )


MANIFEST = "manifest-"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of whatever store; none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _manifest(spark: SparkSession, path: str) -> dict:
    """The latest manifest that was written whole."""
    done = [m for m in sorted(_folders(spark, path)) if m.startswith(MANIFEST) and "_SUCCESS" in _folders(spark, f"{path}/{m}")]
    if not done:
        raise ValueError(f"no detector is stored at {path}")
    return json.loads(spark.read.text(f"{path}/{done[-1]}").first()["value"])


def stored_isolation(spark: SparkSession, path: str) -> str | None:
    """Where the isolation forest of a stored detector lies, None if it has none."""
    part = _manifest(spark, path)["isolation"]
    return f"{path}/{part}" if part else None
