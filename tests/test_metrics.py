import random

import pytest

from windrow.operators import metrics as mt
from windrow.operators import reports as rp
from windrow.operators import sampling as sp


def scored(spark, rows):
    return spark.createDataFrame(rows, "id int, label int, probability double, pred int")


def auc_by_pairs(rows):
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("chunks", [None, 4])
def test_ranking_quality_with_ties(spark, chunks):
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.4), rnd.choice([0.1, 0.2, 0.5, 0.5, 0.8, round(rnd.random(), 2)]), 0) for i in range(200)]
    q = mt.ranking_quality(scored(spark, rows).selectExpr("*", "1 AS g"), ["g"], chunks).first()
    assert q["auc"] == pytest.approx(auc_by_pairs(rows))
    ap, before = 0.0, 0
    n_pos = sum(r[1] for r in rows)
    for t in sorted({r[2] for r in rows}, reverse=True):
        hit = [r[1] for r in rows if r[2] >= t]
        ap += (sum(hit) - before) / n_pos * sum(hit) / len(hit)
        before = sum(hit)
    assert q["average_precision"] == pytest.approx(ap)
    roc = mt.roc_points(scored(spark, rows).selectExpr("*", "1 AS g"), ["g"], chunks).collect()
    assert len(roc) == len({r[2] for r in rows}) + 1 and max(r["tpr"] for r in roc) == 1.0
    pr = mt.pr_points(scored(spark, rows).selectExpr("*", "1 AS g"), ["g"], chunks).collect()
    assert (1.0, 0.0) in {(r["precision"], r["recall"]) for r in pr}


def test_degenerate_scores(spark):
    one_class = mt.evaluate(scored(spark, [(0, 0, 0.3, 1), (1, 0, 0.2, 0)])).first()
    assert one_class["auc"] != one_class["auc"] and one_class["recall"] == 0 and one_class["fpr"] == 0.5
    nothing = mt.evaluate(scored(spark, [(0, 1, 0.3, 0), (1, 0, 0.2, 0)])).first()
    assert (nothing["precision"], nothing["f1"], nothing["auc"]) == (0, 0, 1.0)
    everything = mt.evaluate(scored(spark, [(0, 1, 0.3, 1), (1, 0, 0.2, 1)])).first()
    assert (everything["precision"], everything["recall"], everything["fpr"]) == (0.5, 1, 1)
    report = {r["class"]: r for r in mt.class_report(scored(spark, [(0, 0, 0.1, 0)])).collect()}
    assert report["attack"]["f1"] == 0 and report["accuracy"]["f1"] == 1 and report["weighted avg"]["support"] == 1


def windows(spark, normal, attack):
    return spark.createDataFrame([(i, int(i >= normal)) for i in range(normal + attack)], "window_id int, label int")


def test_undersample_sizes(spark):
    got = sp.class_sizes(sp.undersample(windows(spark, 100, 7), ["window_id"], 2.5))
    assert got == {0: 17, 1: 7}
    assert sp.class_sizes(sp.undersample(windows(spark, 10, 7), ["window_id"], 2.0)) == {0: 10, 1: 7}
    assert sp.class_sizes(sp.undersample(windows(spark, 10, 0), ["window_id"], 2.0)) == {0: 10}


def test_cut_narrows_by_prefix(spark, monkeypatch):
    monkeypatch.setattr(sp, "FEW", 1)
    monkeypatch.setattr(sp, "PREFIX", 1)
    df = windows(spark, 300, 0)
    for n in (0, 1, 137, 299, 300, 500):
        assert sp.sample_n(df, ["window_id"], n).count() == min(n, 300)


def test_split_and_folds_are_exact_per_class(spark):
    split = sp.stratified_split(windows(spark, 101, 33), ["window_id"]).groupBy("split", "label").count().collect()
    assert {(r[0], r[1]): r[2] for r in split} == {("train", 0): 81, ("test", 0): 20, ("train", 1): 26, ("test", 1): 7}
    for chunks in (1, 4):
        folds = sp.stratified_folds(windows(spark, 101, 33), ["window_id"], 5, chunks=chunks).groupBy("fold", "label").count().collect()
        assert sorted(r[2] for r in folds if r[1] == 0) == [20, 20, 20, 20, 21]
        assert sorted(r[2] for r in folds if r[1] == 1) == [6, 6, 7, 7, 7]


def test_same_seed_same_rows(spark):
    df = windows(spark, 60, 20)
    a = sp.undersample(df, ["window_id"], 1.0, seed=1).repartition(5).collect()
    b = sp.undersample(df.repartition(3), ["window_id"], 1.0, seed=1).collect()
    c = sp.undersample(df, ["window_id"], 1.0, seed=2).collect()
    assert sorted(a) == sorted(b) != sorted(c)


def test_best_config_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 10, 0.5), (1, 20, 0.7), (2, 30, 0.7)], "ordinal int, w int, f1 double")
    assert rp.best_config(df).first()["w"] == 20


def test_label_crosscheck_states(spark):
    def status(rows):
        return rp.label_crosscheck(spark.createDataFrame(rows, "comm string, label int"), ["x"]).first()["status"]

    assert status([("y", 1)]) == "none seen"
    assert status([("x", 1)] * 19 + [("x", 0)]) == "ok"
    assert status([("x", 1)] * 18 + [("x", 0)]) == "warn"


def test_scorecard_lists_every_technique(spark):
    alerts = spark.createDataFrame([("a",), ("a",), (None,)], "technique string")
    recalls = spark.createDataFrame([("b", 4, 0.5), ("c", 2, 0.4)], "technique string, n_windows long, recall double")
    card = rp.technique_scorecard(alerts, recalls, ["a", "b", "c", "d"])
    got = {r["technique"]: (r["tool_hit"], r["n_windows"], r["recall"], r["model_hit"]) for r in card.collect()}
    assert got == {"a": ("yes", 0, None, False), "b": ("no", 4, 0.5, True), "c": ("no", 2, 0.4, False), "d": ("no", 0, None, False)}
    assert tuple(rp.scorecard_totals(card).first()) == (1, 1, 4)
