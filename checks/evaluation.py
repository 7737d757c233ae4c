"""Checked queries over metrics, sampling and model-selection tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import surrogate as sg
from checks.sequences import BAGGED, bags
from windrow.functions import scalars as sc
from windrow.operators import metrics as mt
from windrow.operators import reports as rp
from windrow.operators import sampling as sp

QUERIES, ORACLE = {}, {}
SIX = 6


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# Every event is a scored case: the value is the score, the scope is the label.
CASES = sg.with_sql(sg.EV) + """,
cases AS (SELECT event_id, session_id, CASE WHEN cgroup_id = 3 THEN 1 ELSE 0 END AS label, value / 500.0 AS probability,
                 CASE WHEN value / 500.0 >= 0.1 THEN 1 ELSE 0 END AS pred FROM ev),
cm AS (SELECT session_id, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
              count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
       FROM cases GROUP BY session_id),
steps AS (SELECT session_id, probability, sum(label) AS tp, count(*) - sum(label) AS fp,
                 sum(sum(label)) OVER w AS ctp, sum(count(*) - sum(label)) OVER w AS cfp,
                 sum(sum(label)) OVER (PARTITION BY session_id) AS p,
                 sum(count(*) - sum(label)) OVER (PARTITION BY session_id) AS n
          FROM cases GROUP BY session_id, probability
          WINDOW w AS (PARTITION BY session_id ORDER BY probability DESC))"""


def cases(spark, sf):
    p = (F.col("value") / sg.SCORE_SCALE).alias("probability")
    return sg.events_view(spark, sf).select(
        "event_id", "session_id", sc.event_label(F.col("cgroup_id"), sg.ATTACK_CGROUP).alias("label"), p
    ).withColumn("pred", sc.decide(F.col("probability"), 0.1))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, SIX) for c in columns})


@query(CASES + " SELECT session_id, tn, fp, fn, tp FROM cm")
def confusion(spark, sf):
    return mt.confusion(cases(spark, sf), sg.KEYS)


@query(CASES + """
SELECT session_id, tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr FROM cm""")
def binary_metrics(spark, sf):
    return rounded(mt.binary_metrics(cases(spark, sf), sg.KEYS), "precision", "recall", "f1", "fpr")


@query(CASES + """,
cr AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2.0 * tn / (2 * tn + fn + fp) AS f0,
              tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2.0 * tp / (2 * tp + fp + fn) AS f1,
              tn + fp AS n0, tp + fn AS n1, tn + fp + tp + fn AS n FROM cm)
SELECT session_id, "class", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT session_id, 'normal' AS "class", p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM cr
  UNION ALL SELECT session_id, 'attack', p1, r1, f1, n1 FROM cr
  UNION ALL SELECT session_id, 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM cr
  UNION ALL SELECT session_id, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM cr
  UNION ALL SELECT session_id, 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n FROM cr)""")
def class_report(spark, sf):
    return rounded(mt.class_report(cases(spark, sf), sg.KEYS), "precision", "recall", "f1")


@query(CASES + """
SELECT session_id, round(probability, 6) AS threshold, round(cfp / n, 6) AS fpr, round(ctp / p, 6) AS tpr FROM steps
UNION ALL SELECT DISTINCT session_id, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM cases""")
def roc_points(spark, sf):
    return rounded(mt.roc_points(cases(spark, sf), sg.KEYS), "threshold", "fpr", "tpr")


@query(CASES + """
SELECT session_id, round(probability, 6) AS threshold, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / p, 6) AS recall FROM steps
UNION ALL SELECT DISTINCT session_id, CAST('inf' AS DOUBLE), 1.0, 0.0 FROM cases""")
def pr_points(spark, sf):
    return rounded(mt.pr_points(cases(spark, sf), sg.KEYS), "threshold", "precision", "recall")


@query(CASES + """
SELECT session_id, round(sum(fp * (ctp - tp / 2.0)) / (max(p) * max(n)), 6) AS auc FROM steps GROUP BY session_id""")
def roc_auc(spark, sf):
    return rounded(mt.ranking_quality(cases(spark, sf), sg.KEYS).select("session_id", "auc"), "auc")


@query(CASES + """
SELECT session_id, round(sum(tp * ctp / (ctp + cfp)) / max(p), 6) AS average_precision FROM steps GROUP BY session_id""")
def average_precision(spark, sf):
    q = mt.ranking_quality(cases(spark, sf), sg.KEYS).select("session_id", "average_precision")
    return rounded(q, "average_precision")


@query(CASES + """
SELECT label, n, sum(n) OVER () / (2.0 * n) AS weight FROM (SELECT label, count(*) AS n FROM cases GROUP BY label)""".replace(
    "sum(n) OVER () / (2.0 * n) AS weight", "round(sum(n) OVER () / (2.0 * n), 6) AS weight"))
def class_weights(spark, sf):
    return rounded(rp.class_weights(cases(spark, sf)), "weight")


# --- sampling: rank by md5('42:event_id') -----------------------------------------

RANKED = CASES + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', event_id))) AS r,
                  count(*) OVER (PARTITION BY label) AS n_class,
                  row_number() OVER (ORDER BY md5(concat('42:', event_id))) AS r_all,
                  count(*) FILTER (label = 1) OVER () AS n_attack FROM cases)"""


@query(RANKED + " SELECT event_id, label FROM ranked WHERE label = 1 OR r <= n_attack * 2")
def undersample(spark, sf):
    return sp.undersample(cases(spark, sf), ["event_id"], 2.0).select("event_id", "label")


@query(RANKED + """
SELECT event_id, label, CASE WHEN r <= n_class - round_even(n_class * 0.2, 0) THEN 'train' ELSE 'test' END AS split FROM ranked""")
def stratified_split(spark, sf):
    return sp.stratified_split(cases(spark, sf), ["event_id"]).select("event_id", "label", "split")


@query(RANKED + " SELECT event_id, label, CAST((r - 1) % 5 AS INTEGER) AS fold FROM ranked")
def stratified_folds(spark, sf):
    return sp.stratified_folds(cases(spark, sf), ["event_id"], 5).select("event_id", "label", "fold")


@query(RANKED + " SELECT event_id FROM ranked WHERE r_all <= 2000")
def sample_n(spark, sf):
    return sp.sample_n(cases(spark, sf), ["event_id"], 2000).select("event_id")


WINDOW_SPLIT = BAGGED + """,
wr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', session_id, ':', window_id))) AS r,
              count(*) OVER (PARTITION BY label) AS n_class FROM wlab)"""


@query(WINDOW_SPLIT + """
SELECT split, label, count(*) AS n_windows FROM (
  SELECT label, CASE WHEN r <= n_class - round_even(n_class * 0.2, 0) THEN 'train' ELSE 'test' END AS split FROM wr)
GROUP BY ALL""")
def dataset_overview(spark, sf):
    return rp.dataset_overview(sp.stratified_split(bags(spark, sf), ["session_id", "window_id"]))


# --- model selection tables: F1 of a threshold per fold -----------------------------

FOLDS = RANKED + """,
grid AS (SELECT * FROM (VALUES (0, 0.02), (1, 0.05), (2, 0.1), (3, 0.2)) g(ordinal, threshold)),
fold_f1 AS (
  SELECT ordinal, threshold, (r - 1) % 5 AS fold,
         2.0 * count(*) FILTER (label = 1 AND probability >= threshold)
         / (count(*) FILTER (label = 1) + count(*) FILTER (probability >= threshold)) AS f1
  FROM ranked, grid GROUP BY ALL),
summary AS (SELECT ordinal, threshold, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, count(*) AS n_folds
            FROM fold_f1 GROUP BY ordinal, threshold)"""


def fold_summary(spark, sf):
    grid = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("threshold")) for i, t in enumerate((0.02, 0.05, 0.1, 0.2))])
    folds = sp.stratified_folds(cases(spark, sf), ["event_id"], 5)
    tried = folds.select("label", "fold", "probability", F.inline(grid)).withColumn(
        "pred", (F.col("probability") >= F.col("threshold")).cast("int")
    )
    scores = mt.binary_metrics(tried, ["ordinal", "threshold", "fold"])
    return rounded(rp.fold_summary(scores, ["ordinal", "threshold"]), "mean_f1", "std_f1")


@query(FOLDS + " SELECT ordinal, CAST(threshold AS DOUBLE) AS threshold, mean_f1, std_f1, n_folds FROM summary")
def cv_summary(spark, sf):
    return fold_summary(spark, sf)


@query(FOLDS + """
SELECT ordinal, CAST(threshold AS DOUBLE) AS threshold, mean_f1, std_f1, n_folds FROM summary ORDER BY mean_f1 DESC, ordinal LIMIT 1""")
def best_config(spark, sf):
    return rp.best_config(fold_summary(spark, sf), score="mean_f1")
