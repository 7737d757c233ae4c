import os
import random

import pytest

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from windrow.functions.weights import Idf, vectorize
from windrow.models import forest as rf
from windrow.models.isolation import IsolationForest, train_isolation_forest
from windrow.operators import windows as wn
from windrow.plans import evaluate as ev
from windrow.plans import train as tr
from windrow.streaming.scoring import detector_scores, replay
from windrow.vocabulary import SYSCALL_VOCABULARY as VOCAB

SCHEMA = "event_id long, timestamp_ns long, pid long, tid long, uid long, comm string, syscall_name string, session_id int, label int, technique string"
BENIGN = ["openat"] * 55 + ["mmap"] * 34 + ["execve", "clone", "open", "prctl", "fchmod", "fchown"]
ATTACKS = {"suid_exploit": ["setuid", "setresuid", "execve"], "namespace": ["unshare", "mount", "clone"],
           "capset_prctl": ["capset", "prctl"], "ptrace": ["ptrace", "openat"]}
SECOND = 1_000_000_000


def session(number, seed, n=6000):
    """Benign traffic with planted bursts of an attack in its own process."""
    rnd, rows, ts, i = random.Random(seed), [], number * 10**15, 0
    while i < n:
        for _ in range(rnd.randint(150, 300)):
            ts += rnd.randint(1, 2_000_000)
            pid = rnd.randint(1, 40)
            rows.append((i, ts, pid, pid, 1000, "bash", rnd.choice(BENIGN), number, 0, ""))
            i += 1
        ts += 2 * SECOND
        name = rnd.choice(list(ATTACKS))
        for _ in range(rnd.randint(40, 80)):
            ts += rnd.randint(1, 1_000_000)
            attack = rnd.random() < 0.6
            call = rnd.choice(ATTACKS[name]) if attack else rnd.choice(BENIGN)
            rows.append((i, ts, 99 if attack else 5, 99 if attack else 5, 0, "x" if attack else "bash", call, number, int(attack), name if attack else ""))
            i += 1
    return rows


@pytest.fixture(scope="module")
def sessions(spark):
    return [spark.createDataFrame(session(n, n), SCHEMA).cache() for n in (1, 2)]


def test_cross_session_finds_planted_attacks(spark, sessions):
    rows = ev.cross_session(*sessions, windows=(40, 80), trees=20, min_attack_frac=0.1).collect()
    assert [(r["window_size"], r["stride"]) for r in rows] == [(40, 10), (80, 20)]
    assert all(r["f1"] > 0.85 and r["auc"] > 0.95 and r["fpr"] < 0.1 for r in rows)


def test_reports_from_one_scored_table(spark, sessions):
    _, scored = ev.score_session(*sessions, window=40, stride=10, trees=20)
    latency, stats, by = ev.latency_report(sessions[1], scored, gap_s=1.0)
    s = stats.first()
    assert s["n_bursts"] > 5 and s["detected"] >= 0.9 * s["n_bursts"] and s["median_ms"] < 1000
    assert {r["technique"] for r in by.collect()} <= set(ATTACKS)
    timeline = spark.createDataFrame([(0, "suid_exploit", 0, 1), (1, "namespace", 5, 9)], "ordinal long, technique string, start_ns long, end_ns long")
    alerts = spark.createDataFrame([("r", 6), ("r", 20)], "rule string, time_ns long")
    card, totals, benign, fpr = ev.compare_with_rules(alerts, timeline, scored)
    assert card.count() == 14 and totals.first()["tool_caught"] == 1 and benign.first()[0] == 1
    assert totals.first()["model_caught"] >= 3 and fpr.first()["fpr"] < 0.1
    sig = spark.createDataFrame([("S", "n", 6, 3), ("S", "n", 6, 4)], "signature_id string, signature_name string, time_ns long, cgroup_id long")
    card, totals, split = ev.compare_with_signatures(sig, timeline, 3, scored)
    assert totals.first()["tool_caught"] == 1 and tuple(split.first())[1:] == (2, 1, 1)


def test_train_save_load_and_replay(spark, sessions, folder):
    detector, vectors, isolation = tr.train(
        sessions[0], window=40, stride=10, per_pid=False, ngram=2, tfidf=True, balance_ratio=2.0, min_attack_frac=0.1,
        trees=10, folds=3, with_isolation=True, split_path=f"{folder}/split",
    )
    assert detector.cv_f1 > 0.8 and detector.metadata()["n_features"] == 398 and len(detector.metadata()["pairs"]) == 377
    assert {r["split"] for r in spark.read.parquet(f"{folder}/split").select("split").distinct().collect()} == {"train", "test"}
    detector.save(spark, f"{folder}/m")
    loaded = rf.Detector.load(spark, f"{folder}/m")
    assert loaded.metadata() == detector.metadata()
    fired = [
        replay(sessions[1], d.vocab, detector_scores(d), keys=["session_id"], window=40, stride=10, ngram=2, cooldown_ns=SECOND).count()
        for d in (detector, loaded)
    ]
    assert fired[0] == fired[1] > 5
    isolation.save(spark, f"{folder}/i")
    tables = ev.evaluate_saved(spark, f"{folder}/m", f"{folder}/split", f"{folder}/i")
    assert {r["model"] for r in tables["metrics"].collect()} == {"forest", "isolation"}
    assert tables["metrics"].where("model = 'forest'").first()["f1"] > 0.7 and tables["classes"].count() == 10
    facts = {r["name"]: r["value"] for r in tables["overview"].collect()}
    assert (facts["window"], facts["stride"], facts["features"], facts["cv_f1"]) == (40.0, 10.0, 398.0, detector.cv_f1)
    normal = vectors.where("label = 0").withColumn("x", vector_to_array("features"))
    attack = vectors.where("label = 1").withColumn("x", vector_to_array("features"))
    means = [isolation.score(v).agg(F.avg("score")).first()[0] for v in (normal, attack)]
    assert means[1] > means[0]


def test_isolation_offset_flags_the_contamination(spark):
    rnd = random.Random(0)
    rows = [(i, [rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    model = train_isolation_forest(df, ["id"], trees=40)
    assert model.score(df).agg(F.avg("pred")).first()[0] == pytest.approx(0.05, abs=0.005)
    far = spark.createDataFrame([(0, [9.0, 9.0]), (1, [0.0, 0.0])], "id int, x array<double>")
    assert [r["pred"] for r in model.score(far).orderBy("id").collect()] == [1, 0]


def test_isolation_with_text_keys_and_storage(spark, folder, setting):
    setting("windrow.chunks", 4)
    rnd = random.Random(1)
    df = spark.createDataFrame([(f"capture_{i % 3}", i, [rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(90)], "session_id string, window_id long, x array<double>")
    model = train_isolation_forest(df, ["session_id", "window_id"], trees=6, sample=64)
    assert len(model.trees) == 6
    model.save(spark, f"{folder}/m")
    again = IsolationForest.load(spark, f"{folder}/m")
    key = ["session_id", "window_id", "score", "pred"]
    assert sorted(model.score(df).select(key).collect()) == sorted(again.score(df).select(key).collect())


def test_window_search_inside_training(spark, sessions):
    detector, _, _ = tr.train(sessions[0], window_sizes=[40], per_pid=False, trees=5, folds=2, min_attack_frac=0.1)
    best = max(detector.tuning, key=lambda r: r["f1"])
    assert len(detector.tuning) == 3 and (detector.window, detector.stride) == (best["window_size"], best["stride"])


def test_one_class_data(spark, sessions):
    normal = sessions[0].where("label = 0")
    with pytest.raises(ValueError):
        ev.cross_session(normal, sessions[1], windows=(40,), trees=5)
    assert tr.tune_windows(normal, VOCAB, [40], per_pid=False, trees=5).count() == 0
    v = spark.createDataFrame([(i, 0, [float(i % 3), 1.0]) for i in range(20)], "id int, label int, a array<double>")
    from pyspark.ml.functions import array_to_vector

    v = v.withColumn("features", array_to_vector("a"))
    assert rf.score_forest(rf.train_forest(v, trees=3, depth=3), v).agg(F.max("probability")).first()[0] == 0.0


def test_window_search(spark, sessions):
    found = tr.tune_windows(sessions[0], VOCAB, [40], per_pid=False, ngram=1, folds=2, trees=5, min_attack_frac=0.1)
    rows = found.collect()
    assert [(r["window_size"], r["stride"]) for r in rows] == [(40, 10), (40, 20), (40, 40)]
    assert tr.best_window(found).first()["f1"] == max(r["f1"] for r in rows)


def test_tfidf_of_known_counts(spark):
    import math

    w = spark.createDataFrame([(0, {0: 1, 1: 4}), (1, {0: 2}), (2, {})], "id int, bag map<int,bigint>")
    idf = Idf.fit(w, 3)
    assert idf.n_windows == 3 and idf.df == (2, 1, 0)
    got = {r["id"]: r["weights"] for r in idf.transform(w).collect()}
    a, b = math.log(4 / 3) + 1, (1 + math.log(4)) * (math.log(2) + 1)
    assert got[0] == pytest.approx({0: a / math.hypot(a, b), 1: b / math.hypot(a, b)})
    assert got[1] == pytest.approx({0: 1.0}) and got[2] == {}


def test_vectors_are_as_long_as_their_bags(spark, folder):
    w = spark.createDataFrame([(0, {7: 1.5, 2: 4.0, 3: 0.0}), (1, {})], "id int, weights map<int,double>")
    vectorize(w, 398).write.parquet(f"{folder}/v")
    stored = spark.read.parquet(f"{folder}/v").orderBy("id")
    got = [r["features"] for r in stored.collect()]
    assert [(v.size, list(v.indices), list(v.values)) for v in got] == [(398, [2, 7], [4.0, 1.5]), (398, [], [])]


def test_sparse_and_dense_vectors_score_the_same(spark):
    from pyspark.ml.functions import array_to_vector

    rnd = random.Random(4)
    rows = [(i, i % 2, {k: rnd.random() + (i % 2) for k in rnd.sample(range(12), 4)}) for i in range(80)]
    sparse = vectorize(spark.createDataFrame(rows, "id int, label int, weights map<int,double>"), 12).cache()
    dense = sparse.withColumn("features", array_to_vector(vector_to_array("features")))
    model = rf.train_forest(sparse, trees=5, depth=5)
    a, b = ({r["id"]: r["probability"] for r in rf.score_forest(model, v).collect()} for v in (sparse, dense))
    assert a == b


def small_detector(spark, label=1):
    v = spark.createDataFrame([(i, i % 2, {0: float(i % 2), 1: 1.0}) for i in range(20)], "id int, label int, weights map<int,double>")
    return rf.Detector(rf.train_forest(vectorize(v, 21), trees=2, depth=2), list(VOCAB.tokens), sorted(VOCAB.critical), window=label)


def test_a_save_without_isolation_leaves_none(spark, folder):
    rows = spark.createDataFrame([(i, [float(i), 0.5 * i]) for i in range(40)], "id int, x array<double>")
    isolation = train_isolation_forest(rows, ["id"], trees=2, sample=16)
    path = f"{folder}/store"
    small_detector(spark).save(spark, path, isolation)
    assert len(IsolationForest.load(spark, rf.stored_isolation(spark, path)).trees) == 2
    small_detector(spark, 2).save(spark, path)
    assert rf.stored_isolation(spark, path) is None and rf.Detector.load(spark, path).window == 2
    assert len(os.listdir(path)) == 2


def test_a_save_that_breaks_off_leaves_the_version_before(spark, folder, monkeypatch):
    path = f"{folder}/store"
    small_detector(spark, 5).save(spark, path)
    broken = small_detector(spark, 6)

    class Breaks:
        def save(self, *_):
            raise OSError("lost")

    with pytest.raises(OSError):
        broken.save(spark, path, Breaks())
    assert rf.Detector.load(spark, path).window == 5
    broken.save(spark, path)
    assert rf.Detector.load(spark, path).window == 6


def test_events_are_numbered_once_for_all_shapes(spark, sessions, monkeypatch):
    seen = []
    number = tr.number_events
    monkeypatch.setattr(tr, "number_events", lambda *a, **k: seen.append(1) or number(*a, **k))
    shapes = [(40, 10), (60, 60), (50, 20)]
    assert tr.tune_windows(sessions[0], VOCAB, [], strides=shapes, per_pid=False, trees=2, folds=2, min_attack_frac=0.1).count() == 3
    assert len(seen) == 1
    numbered = number(sessions[0], VOCAB, keys=["session_id"], carry=["label"])
    pane = wn.shared_pane(shapes)
    panes = wn.pane_counts(numbered, VOCAB, pane, keys=["session_id"], ngram=2).cache()
    assert pane == 10
    for w, s in shapes:
        a = wn.windows_of_panes(panes, pane, keys=["session_id"], window=w, stride=s)
        b = wn.bag_windows(numbered, VOCAB, keys=["session_id"], window=w, stride=s, ngram=2)
        rows = [sorted((r["window_id"], r["label"], r["close_ts"], sorted(r["bag"].items())) for r in x.collect()) for x in (a, b)]
        assert rows[0] == rows[1] and rows[0]
    with pytest.raises(ValueError):
        wn.windows_of_panes(panes, pane, keys=["session_id"], window=45, stride=10)
