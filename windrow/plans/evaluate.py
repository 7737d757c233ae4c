"""Evaluation across sessions, and the reports derived from one scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.weights import Idf
from windrow.models.forest import Detector, score_forest, stored_isolation, train_forest
from windrow.models.isolation import IsolationForest
from windrow.operators import intervals as iv
from windrow.operators import metrics as mt
from windrow.operators import reports as rp
from windrow.operators.sampling import class_sizes, undersample
from windrow.operators.windows import bag_windows, number_events, pane_counts, shared_pane, window_keys, windows_of_panes
from windrow.plans.train import to_vectors
from windrow.sources.events import read_split
from windrow.storage import materialize
from windrow.vocabulary import SYSCALL_VOCABULARY, TECHNIQUES, Vocabulary


def session_windows(
    events: DataFrame, vocab: Vocabulary, window: int, stride: int, *, ngram: int = 2, min_attack: int = 1,
    min_attack_frac: float = 0.0, session_key: str | None = "session_id",
) -> DataFrame:
    """Whole-stream windows of a labelled session, with their dominant technique."""
    keys = window_keys(False, session_key)
    has = "technique" in events.columns
    numbered = number_events(events, vocab, keys=keys, carry=["label", *(["technique"] if has else [])])
    return bag_windows(
        numbered, vocab, keys=keys, window=window, stride=stride, ngram=ngram, min_attack=min_attack,
        min_attack_frac=min_attack_frac, techniques=has,
    )


def fit_and_score(
    train: DataFrame, test: DataFrame, n_features: int, key: list[str], *, tfidf: bool = True, balance_ratio: float = 2.0,
    trees: int = 200, threshold: float = 0.5, seed: int = 42,
):
    """Weights from all training windows, forest from the balanced ones, test scored."""
    idf = Idf.fit(train, n_features) if tfidf else None
    balanced = materialize(to_vectors(undersample(train, key, balance_ratio, seed), n_features, idf), "balanced")
    model = train_forest(balanced, trees=trees, seed=seed)
    return model, score_forest(model, to_vectors(test, n_features, idf), threshold)


def cross_session(
    train_events: DataFrame, test_events: DataFrame, vocab: Vocabulary = SYSCALL_VOCABULARY, *,
    windows: tuple[int, ...] = (50, 100, 150, 200), ngram: int = 2, tfidf: bool = True, balance_ratio: float = 2.0,
    min_attack: int = 1, min_attack_frac: float = 0.0, threshold: float = 0.5, trees: int = 200, seed: int = 42,
    session_key: str | None = "session_id",
) -> DataFrame:
    """Train on one session, test on the other, per window size with stride W // 4.

    One metrics row per usable size; ``reports.best_config`` picks the highest
    test F1, the first of equals.
    """
    keys = window_keys(False, session_key)
    key = [*keys, "window_id"]
    shapes = [(w, max(1, w // 4)) for w in windows]
    pane = shared_pane(shapes)
    # Each session is numbered and read once; every size is added up from its panes.
    sides = [
        materialize(pane_counts(number_events(e, vocab, keys=keys, carry=["label"]), vocab, pane, keys=keys, ngram=ngram), "panes")
        for e in (train_events, test_events)
    ]
    out = None
    for ordinal, (w, stride) in enumerate(shapes):
        train, test = (
            materialize(windows_of_panes(side, pane, keys=keys, window=w, stride=stride, min_attack=min_attack,
                                         min_attack_frac=min_attack_frac), name)
            for side, name in zip(sides, ("train", "test"))
        )
        sizes = [class_sizes(train), class_sizes(test)]
        if any(sum(s.values()) < 20 or not s.get(1) for s in sizes):
            continue
        _, scored = fit_and_score(
            train, test, vocab.n_features(ngram), key, tfidf=tfidf, balance_ratio=balance_ratio, trees=trees,
            threshold=threshold, seed=seed,
        )
        scored = materialize(scored.select(*key, "label", "probability", "pred"), "scored")
        row = mt.evaluate(scored).select(
            F.lit(ordinal).alias("ordinal"), F.lit(w).alias("window_size"), F.lit(stride).alias("stride"),
            F.lit(sum(sizes[0].values())).alias("train_windows"), F.lit(sum(sizes[1].values())).alias("test_windows"), "*",
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no usable window size: too few windows or a class is missing")
    return out


def score_session(
    train_events: DataFrame, test_events: DataFrame, vocab: Vocabulary = SYSCALL_VOCABULARY, *, window: int = 200,
    stride: int = 50, ngram: int = 2, min_attack_frac: float = 0.1, threshold: float = 0.5, trees: int = 200,
    seed: int = 42, session_key: str | None = "session_id",
):
    """The scored test windows every later report reads, written once; and the model."""
    key = [*window_keys(False, session_key), "window_id"]
    shape = dict(ngram=ngram, min_attack_frac=min_attack_frac, session_key=session_key)
    train = materialize(session_windows(train_events, vocab, window, stride, **shape), "train")
    test = session_windows(test_events, vocab, window, stride, **shape)
    model, scored = fit_and_score(
        train, test, vocab.n_features(ngram), key, threshold=threshold, trees=trees, seed=seed
    )
    kept = [*key, "close_ts", "attack_events", "label", "probability", "pred"]
    if "technique" in scored.columns:
        kept.append("technique")
    return model, materialize(scored.select(*kept), "scored")


def latency_report(test_events: DataFrame, scored: DataFrame, gap_s: float = 1.0, keys: list[str] = ("session_id",)):
    """Detection latency per burst, its statistics, and its median per technique."""
    bursts = iv.attack_bursts(test_events, int(gap_s * 1e9), keys=list(keys))
    latency = materialize(iv.detection_latency(bursts, scored, keys=list(keys)), "latency")
    return latency, rp.latency_stats(latency), rp.latency_by_technique(latency)


def compare_with_rules(alerts: DataFrame, timeline: DataFrame, scored: DataFrame, techniques=TECHNIQUES):
    """Rule feed against the model: scorecard, totals, benign alarms and model FPR."""
    numbered = materialize(alerts.withColumn("_alert", F.monotonically_increasing_id()), "alerts")
    attributed = materialize(
        iv.first_interval(numbered, F.col("time_ns"), timeline), "rule-alerts"
    )
    card = rp.technique_scorecard(attributed, rp.technique_recall(scored), list(techniques))
    benign = attributed.agg(F.count(F.when(F.col("technique").isNull(), 1)).alias("benign_alerts"))
    return card, rp.scorecard_totals(card), benign, mt.binary_metrics(scored).select("fpr")


def compare_with_signatures(alerts: DataFrame, timeline: DataFrame, attack_cgroup: int, scored: DataFrame, techniques=TECHNIQUES):
    """Signature feed against the model; only detections inside the attack scope count as hits."""
    numbered = materialize(alerts.withColumn("_alert", F.monotonically_increasing_id()), "alerts")
    attributed = materialize(
        iv.first_interval(numbered, F.col("time_ns"), timeline), "signature-alerts"
    )
    hits = rp.scoped_alerts(attributed, attack_cgroup)
    card = rp.technique_scorecard(hits, rp.technique_recall(scored), list(techniques))
    return card, rp.scorecard_totals(card), rp.signature_attribution(attributed, attack_cgroup)


def evaluate_saved(spark: SparkSession, model_path: str, split_path: str, isolation_path: str | None = None) -> dict[str, DataFrame]:
    """Report tables of a stored detector on its stored test windows.

    ``metrics`` and ``classes`` have one row, or one per class, for each model: ``forest`` and, if one
    is stored with the detector or at ``isolation_path``, ``isolation``. ``overview`` says how the detector was made and what it reaches.
    """
    detector = Detector.load(spark, model_path)
    test = read_split(spark, split_path, "test")
    scored = score_forest(detector.model, test).select("label", "probability", "pred").withColumn("model", F.lit("forest"))
    isolation_path = isolation_path or stored_isolation(spark, model_path)
    if isolation_path:
        from pyspark.ml.functions import vector_to_array

        found = IsolationForest.load(spark, isolation_path).score(test.withColumn("x", vector_to_array("features")))
        scored = scored.unionByName(
            found.select("label", F.col("score").alias("probability"), "pred").withColumn("model", F.lit("isolation")))
    scored = materialize(scored, "saved-scores")
    metrics = mt.evaluate(scored, ["model"])
    auc = metrics.where("model = 'forest'").first()
    facts = [
        ("window", detector.window), ("stride", detector.stride), ("ngram", detector.ngram), ("features", detector.n_features),
        ("cv_f1", detector.cv_f1), ("auc", auc["auc"] if auc else None), ("f1", auc["f1"] if auc else None),
    ]
    facts = [(name, None if value is None else float(value)) for name, value in facts]
    return {
        "metrics": metrics, "classes": mt.class_report(scored, ["model"]), "sizes": rp.dataset_overview(read_split(spark, split_path)),
        "overview": spark.createDataFrame(facts, "name string, value double"),
    }
