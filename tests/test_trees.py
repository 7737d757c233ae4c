import uuid

import numpy as np
import pytest

from pyspark.ml.functions import array_to_vector
from windrow.models import forest as rf
from windrow.models import trees


def planted(spark, n=400):
    rnd = np.random.default_rng(3)
    rows = [(i, int(a > 0.6), [float(a), float(b)]) for i, (a, b) in enumerate(rnd.random((n, 2)))]
    df = spark.createDataFrame(rows, "id int, label int, a array<double>")
    return df.select("id", "label", array_to_vector("a").alias("features")).cache()


def test_a_deep_tree_tells_all_rows_apart_and_limits_hold():
    rnd = np.random.default_rng(0)
    x = np.unique(rnd.integers(0, 30, (500, 4)).astype(np.uint8), axis=0)
    y, c = rnd.integers(0, 2, len(x)).astype(np.int8), np.ones(len(x), np.int64)
    *tree, gains = trees.grow(x, y, c, (1.0, 1.0), 32, 30, 1, rnd)
    # A node whose chosen features gain nothing stays a leaf, so a few rows may share one.
    assert ((trees.values_of(tree, x) > 0.5) == y).mean() > 0.95 and (gains > 0).all()
    feature, _, left, value = trees.grow(x, y, c, (1.0, 1.0), 32, 2, 1, rnd)[:4]
    assert len(feature) <= 7 and (feature[3:] == -1).all() and ((value >= 0) & (value <= 1)).all()
    *tree, _ = trees.grow(x, y, c, (1.0, 1.0), 32, 30, 25, rnd)
    at = trees.values_of((tree[0], tree[1], tree[2], np.arange(len(tree[0]), dtype=float)), x).astype(int)
    assert np.unique(at, return_counts=True)[1].min() >= 25


def test_few_nodes_at_a_time_grow_whole_trees(monkeypatch):
    rnd = np.random.default_rng(0)
    x = np.unique(rnd.integers(0, 30, (500, 4)).astype(np.uint8), axis=0)
    y = rnd.integers(0, 2, len(x)).astype(np.int8)
    monkeypatch.setattr(trees, "CELLS", 200)
    *tree, _ = trees.grow(x, y, np.ones(len(x), np.int64), (1.0, 1.0), 32, 30, 1, rnd)
    assert ((trees.values_of(tree, x) > 0.5) == y).mean() > 0.95


def test_trees_live_in_a_table_and_groups_add_up(spark, folder, monkeypatch):
    v = planted(spark)
    model = rf.train_forest(v, trees=9)
    assert sorted(r["tree"] for r in model.trees.select("tree").collect()) == list(range(9))
    assert model.importances().sum() == pytest.approx(1) and model.importances()[0] > 0.9
    whole = {r["id"]: r["probability"] for r in rf.score_forest(model, v).collect()}
    labels = {r["id"]: r["label"] for r in v.collect()}
    assert len(whole) == 400 and sum((whole[i] > 0.5) == (labels[i] == 1) for i in whole) > 390
    monkeypatch.setattr(trees, "GROUP_BYTES", 1)
    monkeypatch.setattr(trees, "GROUP_ROWS", 50)
    assert {r["id"]: r["probability"] for r in rf.score_forest(model, v).collect()} == pytest.approx(whole)
    model.save(spark, f"{folder}/m")
    again = trees.Forest.load(spark, f"{folder}/m")
    assert {r["id"]: r["probability"] for r in rf.score_forest(again, v).collect()} == pytest.approx(whole)


def test_a_search_starts_as_many_jobs_for_many_points(spark):
    v, context = planted(spark), spark.sparkContext

    def jobs(grid):
        group = uuid.uuid4().hex
        context.setJobGroup(group, "search")
        _, results = rf.cross_validate(v, ["id"], grid=grid, folds=2)
        context.setLocalProperty("spark.jobGroup.id", None)
        assert all(mean > 0.9 for _, mean, _ in results)
        return len(context.statusTracker().getJobIdsForGroup(group))

    many = {"numTrees": [3, 5], "maxDepth": [2, 10, 5], "minInstancesPerNode": [1, 4]}
    assert abs(jobs({"numTrees": [3]}) - jobs(many)) <= 4  # as files fall, not one or more a level and point


def test_points_share_the_trees_they_have_in_common():
    points = [{"trees": n, "depth": d, "leaf": k} for n in (100, 200, 300) for d in (30, 10, 20) for k in (1, 2, 5)]
    jobs = trees._jobs(points, 3)
    # One for every fold, leaf size and number, where each point by itself grows 16,200 in all.
    assert len(jobs) == len({(j.fold, j.leaf, j.tree) for j in jobs}) == 3 * 3 * 300
    assert {(j.depths, j.upto) for j in jobs if j.tree < 100} == {((10, 20, 30), 100)}
    uneven = trees._jobs([{"trees": 3, "depth": 9, "leaf": 1}, {"trees": 5, "depth": 4, "leaf": 1}], 1)
    assert [(j.tree, j.depths, j.upto) for j in uneven] == [(0, (4, 9), 3), (1, (4, 9), 3), (2, (4, 9), 3), (3, (4,), 5), (4, (4,), 5)]


def test_a_tree_cut_off_is_the_tree_of_less_depth():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 32, (3000, 5)).astype(np.uint8)
    y, c = rnd.integers(0, 2, len(x)).astype(np.int8), rnd.integers(1, 4, len(x))
    before = x.copy()
    deep = trees.grow(x, y, c, (0.7, 1.9), 32, 30, 2, np.random.default_rng(1))[:4]
    assert (x == before).all()
    found = trees.values_at(deep, x, [0, 3, 8, 30, 40])
    for depth, values in zip([0, 3, 8, 30, 40], found):
        tree = trees.grow(x, y, c, (0.7, 1.9), 32, depth, 2, np.random.default_rng(1))[:4]
        assert (trees.values_of(tree, x) == values).all()


def test_runs_and_nodes_at_a_time_change_no_tree(monkeypatch):
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 32, (3000, 5)).astype(np.uint8)
    y, c = rnd.integers(0, 2, len(x)).astype(np.int8), rnd.integers(1, 4, len(x))
    whole = trees.grow(x, y, c, (0.7, 1.9), 32, 30, 1, np.random.default_rng(1))
    monkeypatch.setattr(trees, "CELLS", 500)
    monkeypatch.setattr(trees, "RUN", 7)
    parts = trees.grow(x, y, c, (0.7, 1.9), 32, 30, 1, np.random.default_rng(1))
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert (trees.values_of(parts[:4], x) == trees.values_at(whole[:4], x, [30])[0]).all()


def test_the_best_split_is_that_of_all_cuts():
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 6, (40, 3)).astype(np.uint8)
    y, c = rnd.integers(0, 2, 40).astype(np.int8), rnd.integers(1, 4, 40)
    for leaf in (1, 20):
        def impurity(f, t):
            sides = [[2.0 * c[side & (y == 1)].sum(), c[side & (y == 0)].sum()] for side in (x[:, f] <= t, x[:, f] > t)]
            if min(c[x[:, f] <= t].sum(), c[x[:, f] > t].sum()) < leaf:
                return np.inf
            return sum(a * b / (a + b) for a, b in sides)

        sums = trees._histograms(x, np.where(y == 1, c * trees.ATTACK, c).astype(float), np.array([0, 40]), np.arange(3)[None], 6)
        counts = [np.array([float(c[y == label].sum())]) for label in (0, 1)]
        feature, cut, gain, l0, l1 = trees._best_splits(sums, *counts, np.arange(3)[None], (1.0, 2.0), leaf)
        least = min((impurity(f, t), f, t) for f in range(3) for t in range(5))
        assert (feature[0], cut[0]) == least[1:]
        assert gain[0] == pytest.approx(2 * counts[0][0] * counts[1][0] / (counts[0][0] + 2 * counts[1][0]) - least[0])
        left = x[:, feature[0]] <= cut[0]
        assert (l0[0], l1[0]) == (c[left & (y == 0)].sum(), c[left & (y == 1)].sum())


def test_a_search_gives_what_its_points_give_by_themselves(spark):
    v = planted(spark)
    # Few and small trees, so that points differ.
    many = {"numTrees": [2, 5, 3], "maxDepth": [1, 0, 3], "minInstancesPerNode": [1, 150]}
    _, together = rf.cross_validate(v, ["id"], grid=many, folds=2)
    assert len(together) == 18 and len({mean for _, mean, _ in together}) > 2
    for point in (0, 3, 7, 16):
        named = together[point][0]
        _, alone = rf.cross_validate(v, ["id"], grid={n: [value] for n, value in named.items()}, folds=2)
        assert alone[0] == together[point]
