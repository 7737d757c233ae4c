"""Training: events -> windows -> balance -> split -> weights -> forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.weights import Idf, raw_weights, vectorize
from windrow.models.forest import FOREST_GRID, Detector, cross_validate, train_forest
from windrow.models.isolation import train_isolation_forest
from windrow.operators import reports as rp
from windrow.operators.sampling import class_sizes, stratified_split, undersample
from windrow.operators.windows import bag_windows, number_events, pane_counts, shared_pane, window_keys, windows_of_panes
from windrow.sources.events import write_split
from windrow.storage import materialize
from windrow.vocabulary import SYSCALL_VOCABULARY, Vocabulary


def to_vectors(windows: DataFrame, n_features: int, idf: Idf | None) -> DataFrame:
    """Weights (TF-IDF or plain counts) and the vector of every window."""
    weighted = raw_weights(windows) if idf is None else idf.transform(windows)
    return vectorize(weighted, n_features)


def train(
    events: DataFrame, vocab: Vocabulary = SYSCALL_VOCABULARY, *, window: int = 20, stride: int = 10, per_pid: bool = True,
    ngram: int = 1, tfidf: bool = False, balance_ratio: float | None = None, min_attack: int = 1,
    min_attack_frac: float = 0.0, session_key: str | None = "session_id", tune_grid: dict | bool = False, folds: int = 5,
    trees: int = 200, with_isolation: bool = False, split_path: str | None = None, seed: int = 42,
    window_sizes: list[int] | None = None,
):
    """Fit a detector; returns it, the windows with their split, and the isolation forest or None.

    Order of steps: balance, then split 80/20, then fit the
    weights on the training part only. With ``window_sizes`` window and stride are searched first,
    and the detector keeps the search's table.
    """
    tuning = None
    if window_sizes:
        results = materialize(
            tune_windows(events, vocab, window_sizes, per_pid=per_pid, ngram=ngram, folds=folds, min_attack=min_attack,
                         min_attack_frac=min_attack_frac, session_key=session_key, seed=seed), "tuning")
        # At most three settings for each size asked for.
        tuning = [r.asDict() for r in results.orderBy("ordinal").collect()]
        if tuning:
            best = best_window(results).first()
            window, stride = best["window_size"], best["stride"]
    keys = window_keys(per_pid, session_key)
    key = [*keys, "window_id"]
    numbered = number_events(events, vocab, keys=keys, carry=["label"])
    windows = materialize(
        bag_windows(numbered, vocab, keys=keys, window=window, stride=stride, ngram=ngram, min_attack=min_attack,
                    min_attack_frac=min_attack_frac),
        "windows",
    )
    if balance_ratio is not None:
        windows = undersample(windows, key, balance_ratio, seed)
    split = materialize(stratified_split(windows, key, 0.2, seed), "split")
    n_features = vocab.n_features(ngram)
    idf = Idf.fit(split.where("split = 'train'"), n_features) if tfidf else None
    vectors = to_vectors(split, n_features, idf)
    if split_path:
        write_split(vectors, split_path)
    fit_rows = vectors.where("split = 'train'")
    grid = FOREST_GRID if tune_grid is True else (tune_grid or None)
    model, results = cross_validate(fit_rows, key, grid=grid, folds=folds, trees=trees, seed=seed)
    params, f1, _ = max(results, key=lambda r: r[1])
    detector = Detector(
        model=model, tokens=list(vocab.tokens), critical=sorted(vocab.critical), window=window, stride=stride,
        per_pid=per_pid, ngram=ngram, idf=idf, cv_f1=round(f1, 4), params=params, tuning=tuning,
    )
    isolation = None
    if with_isolation:
        normal = fit_rows.where("label = 0").withColumn("x", _as_array())
        isolation = train_isolation_forest(normal, key, trees=trees, seed=seed)
    return detector, vectors, isolation


def _as_array():
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col("features"))


def window_candidates(sizes: list[int]) -> list[tuple[int, int]]:
    """Each size with strides of a quarter, a half and the whole of it."""
    return [(w, max(1, int(w * share))) for w in sizes for share in (0.25, 0.5, 1.0)]


def tune_windows(
    events: DataFrame, vocab: Vocabulary, sizes: list[int], *, per_pid: bool = True, ngram: int = 1, folds: int = 5,
    trees: int = 75, balance_ratio: float = 3.0, min_attack: int = 1, min_attack_frac: float = 0.0,
    session_key: str | None = "session_id", seed: int = 42, strides: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Cross-validated F1 of attack per (window, stride), on raw counts.

    Settings with under 20 windows or a single class are skipped. The events are
    numbered and counted once, in panes that all settings are added up from. Pick the winner with ``reports.best_config``.
    """
    keys = window_keys(per_pid, session_key)
    key = [*keys, "window_id"]
    shapes = strides or window_candidates(sizes)
    rows, schema = [], "ordinal int, window_size int, stride int, f1 double, std_f1 double"
    if not shapes:
        return events.sparkSession.createDataFrame(rows, schema)
    pane = shared_pane(shapes)
    numbered = number_events(events, vocab, keys=keys, carry=["label"])
    panes = materialize(pane_counts(numbered, vocab, pane, keys=keys, ngram=ngram), "panes")
    for ordinal, (w, s) in enumerate(shapes):
        windows = materialize(
            windows_of_panes(panes, pane, keys=keys, window=w, stride=s, min_attack=min_attack, min_attack_frac=min_attack_frac),
            "windows",
        )
        sizes_by_class = class_sizes(windows)
        if sum(sizes_by_class.values()) < 20 or len(sizes_by_class) < 2:
            continue
        balanced = undersample(windows, key, balance_ratio, seed)
        vectors = materialize(to_vectors(balanced, vocab.n_features(ngram), None), "vectors")
        _, results = cross_validate(vectors, key, folds=folds, trees=trees, seed=seed)
        rows.append((ordinal, w, s, float(results[0][1]), float(results[0][2])))
    return events.sparkSession.createDataFrame(rows, schema)


def best_window(results: DataFrame) -> DataFrame:
    return rp.best_config(results, score="f1")
