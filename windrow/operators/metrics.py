"""Classification metrics over scored windows (``label``, ``probability``, ``pred``).

Every function takes optional grouping ``keys`` (session, model, window size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.operators.ordered import ordered_scan


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 on an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    y, p = F.col("label") == 1, F.col("pred") == 1
    return scored.groupBy(*keys).agg(
        _count(~y & ~p).alias("tn"), _count(~y & p).alias("fp"), _count(y & ~p).alias("fn"), _count(y & p).alias("tp")
    )


def binary_metrics(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 of attack, false-positive rate of normal windows."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(scored, keys).withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": ratio(fp, fp + tn),
        }
    )


def class_report(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows normal, attack, accuracy, macro avg, weighted avg."""
    keys = list(keys)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n0, n1 = tn + fp, tp + fn
    n = n0 + n1

    def three(hit, predicted, actual):
        return ratio(hit, predicted), ratio(hit, actual), ratio(2 * hit, predicted + actual)

    normal, attack = three(tn, tn + fn, n0), three(tp, tp + fp, n1)
    hits = ratio(tp + tn, n)

    def row(name, values, support):
        return F.struct(
            F.lit(name).alias("class"), values[0].alias("precision"), values[1].alias("recall"),
            values[2].alias("f1"), support.alias("support"),
        )

    macro = [(a + b) / 2 for a, b in zip(normal, attack)]
    weighted = [ratio(a * n0 + b * n1, n) for a, b in zip(normal, attack)]
    rows = F.array(
        row("normal", normal, n0), row("attack", attack, n1), row("accuracy", (hits, hits, hits), n),
        row("macro avg", macro, n), row("weighted avg", weighted, n),
    )
    return confusion(scored, keys).select(*keys, F.inline(rows))


def score_steps(scored: DataFrame, keys: list[str] = (), chunks: int | None = None) -> DataFrame:
    """One row per distinct score, highest first, with running and total counts."""
    keys = list(keys)
    y = (F.col("label") == 1).cast("long")
    per_score = (
        scored.groupBy(*keys, "probability")
        .agg(F.sum(y).alias("tp"), F.sum(1 - y).alias("fp"))
        .withColumn("_down", -F.col("probability"))
    )
    return ordered_scan(
        per_score, keys, ["_down"], sums={"cum_tp": F.col("tp"), "cum_fp": F.col("fp")},
        totals={"n_pos": F.col("tp"), "n_neg": F.col("fp")}, chunks=chunks, once=True,
    ).drop("_down")


def roc_points(scored: DataFrame, keys: list[str] = (), chunks: int | None = None) -> DataFrame:
    """(fpr, tpr) per threshold, from (0, 0) up; collinear points are kept."""
    keys = list(keys)
    steps = score_steps(scored, keys, chunks).select(
        *keys, F.col("probability").alias("threshold"),
        ratio(F.col("cum_fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("cum_tp"), F.col("n_pos")).alias("tpr"),
    )
    start = scored.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"))
    return steps.unionByName(start.withColumns({"fpr": F.lit(0.0), "tpr": F.lit(0.0)}))


def pr_points(scored: DataFrame, keys: list[str] = (), chunks: int | None = None) -> DataFrame:
    """(precision, recall) per threshold, ending at recall 0 with precision 1."""
    keys = list(keys)
    steps = score_steps(scored, keys, chunks).select(
        *keys, F.col("probability").alias("threshold"),
        ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        ratio(F.col("cum_tp"), F.col("n_pos")).alias("recall"),
    )
    end = scored.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"))
    return steps.unionByName(end.withColumns({"precision": F.lit(1.0), "recall": F.lit(0.0)}))


def ranking_quality(scored: DataFrame, keys: list[str] = (), chunks: int | None = None) -> DataFrame:
    """Tie-aware ROC-AUC (NaN when one class is missing) and average precision.

    A step of equal scores adds its negatives times the positives above it and
    half of those beside it; average precision adds recall steps times precision.
    """
    keys = list(keys)
    tp, cum_tp = F.col("tp").cast("double"), F.col("cum_tp").cast("double")
    area = F.sum(F.col("fp") * (cum_tp - tp / 2))
    step = F.sum(tp * cum_tp / (F.col("cum_tp") + F.col("cum_fp")))
    # Products of counts leave the range of longs.
    p, n = F.max("n_pos").cast("double"), F.max("n_neg").cast("double")
    return score_steps(scored, keys, chunks).groupBy(*keys).agg(
        F.when((p > 0) & (n > 0), area / (p * n)).otherwise(F.lit(float("nan"))).alias("auc"),
        ratio(step, p).alias("average_precision"),
    )


def evaluate(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Threshold metrics and ranking quality in one row per key."""
    if keys:
        return binary_metrics(scored, keys).join(ranking_quality(scored, keys), list(keys))
    one = scored.withColumn("_all", F.lit(1))
    return evaluate(one, ["_all"]).drop("_all")
