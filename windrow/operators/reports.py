"""Summaries of captures, labels, detections and latency, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.metrics import ratio
from windrow.operators.ordered import ordered_scan
from windrow.schema import EVENT_ORDER
from windrow.storage import small_table
from windrow.vocabulary import IMPORTANT, KNOWN_ATTACK_COMMS, TECHNIQUES, UNATTRIBUTED, Vocabulary


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def class_counts(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    return events.groupBy(*keys).agg(
        n.alias("n_rows"), _count(F.col("label") == 0).alias("n_normal"), _count(F.col("label") == 1).alias("n_attack"),
        (_count(F.col("label") == 1) * 100 / n).alias("attack_pct"),
    )


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULL is no value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def label_crosscheck(events: DataFrame, known: list[str] = KNOWN_ATTACK_COMMS) -> DataFrame:
    """Do the known attack programs carry the attack label?

    ``status``: ok, warn (under 95 %), or none seen.
    """
    pct = F.col("n_attack") * 100 / F.col("n_known")
    return (
        events.where(F.col("comm").isin(list(known)))
        .agg(F.count(F.lit(1)).alias("n_known"), _count(F.col("label") == 1).alias("n_attack"))
        .withColumn("attack_pct", F.when(F.col("n_known") > 0, pct))
        .withColumn("status", F.when(F.col("n_known") == 0, "none seen").when(pct < 95, "warn").otherwise("ok"))
    )


def session_summary(
    events: DataFrame, keys: list[str] = ("session_id",), *, elapsed_s: Column | None = None, approximate: bool = False
) -> DataFrame:
    """Rows, rate, distribution of names, distinct processes and users of a capture.

    Without a measured duration the span of the event clock stands for it.
    ``approximate`` swaps the exact distinct counts for sketches.
    """
    keys = list(keys)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    per_name = events.groupBy(*keys, "syscall_name").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("syscall_name", "n")))).alias("syscall_distribution")
    )
    span = (F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9 if elapsed_s is None else F.max(elapsed_s)
    totals = events.groupBy(*keys).agg(
        span.alias("_elapsed"), F.count(F.lit(1)).alias("total_events"), distinct("pid").alias("unique_pids"),
        distinct("uid").alias("unique_uids"),
    )
    return totals.join(per_name, keys).select(
        *keys,
        F.round("_elapsed", 2).alias("duration_s"),
        "total_events",
        F.round(F.col("total_events") / F.greatest(F.col("_elapsed"), F.lit(0.001)), 2).alias("events_per_sec"),
        "syscall_distribution", "unique_pids", "unique_uids",
    )


def name_distribution(events: DataFrame, keys: list[str] = ("session_id",)) -> DataFrame:
    """Count and percent per call name, most frequent first."""
    keys = list(keys)
    counts = events.groupBy(*keys, "syscall_name").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", F.col("n") * 100 / total).orderBy(*keys, F.desc("n"), "syscall_name")


def event_digest(
    events: DataFrame, important: list[str] = IMPORTANT, every: int = 25, *, keys: list[str] = ("session_id",),
    order: list[str] = EVENT_ORDER, chunks: int | None = None,
) -> DataFrame:
    """Important events, and every ``every``-th event counted over all events."""
    numbered = ordered_scan(events, list(keys), order, seq="seq", chunks=chunks)
    return numbered.where(F.col("syscall_name").isin(list(important)) | (F.pmod(F.col("seq") + 1, F.lit(every)) == 0))


def technique_recall(scored: DataFrame, keys: list[str] = (), min_windows: int = 0) -> DataFrame:
    """Detected share of attack windows per dominant technique, weakest first."""
    return (
        scored.where("label = 1")
        .groupBy(*keys, "technique")
        .agg(F.count(F.lit(1)).alias("n_windows"), F.sum("pred").alias("n_detected"))
        .where(F.col("n_windows") >= min_windows)
        .withColumn("recall", F.col("n_detected") / F.col("n_windows"))
        .orderBy(*keys, "recall", "technique")
    )


def alerts_by_technique(attributed: DataFrame, column: str = "technique") -> DataFrame:
    """Alerts per technique; alerts outside every interval count as benign."""
    return attributed.groupBy(F.coalesce(column, F.lit("benign")).alias("technique")).agg(
        F.count(F.lit(1)).alias("n_alerts")
    )


def signature_attribution(alerts: DataFrame, attack_cgroup: int) -> DataFrame:
    """Per signature: all detections, those from the attack scope, and the benign rest."""
    key = F.concat_ws(": ", "signature_id", "signature_name")
    inside = F.coalesce(F.col("cgroup_id") == attack_cgroup, F.lit(False))
    return (
        alerts.groupBy(key.alias("signature"))
        .agg(F.count(F.lit(1)).alias("total"), _count(inside).alias("attack"))
        .withColumn("benign", F.col("total") - F.col("attack"))
        .orderBy(F.desc("total"), "signature")
    )


def scoped_alerts(alerts: DataFrame, attack_cgroup: int) -> DataFrame:
    """Detections from the attack scope; a time outside every interval is ``unattributed``."""
    return alerts.where(F.col("cgroup_id") == attack_cgroup).withColumn(
        "technique", F.coalesce("technique", F.lit(UNATTRIBUTED))
    )


def technique_scorecard(
    tool_alerts: DataFrame, recalls: DataFrame, techniques: list[str] = TECHNIQUES, enough: float = 0.5
) -> DataFrame:
    """Every listed technique with the tool's hit and the model's recall (NULL = no window)."""
    dim = small_table(tool_alerts.sparkSession, list(enumerate(techniques)), "ordinal int, technique string")
    hits = tool_alerts.groupBy("technique").agg(F.count(F.lit(1)).alias("n_alerts"))
    models = recalls.select("technique", "n_windows", "recall")
    return dim.join(hits, "technique", "left").join(models, "technique", "left").select(
        "ordinal", "technique",
        F.when(F.col("n_alerts") > 0, "yes").otherwise("no").alias("tool_hit"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        "recall",
        F.coalesce(F.col("recall") >= enough, F.lit(False)).alias("model_hit"),
    )


def scorecard_totals(card: DataFrame) -> DataFrame:
    return card.agg(
        _count(F.col("tool_hit") == "yes").alias("tool_caught"), _count(F.col("model_hit")).alias("model_caught"),
        F.count(F.lit(1)).alias("n_techniques"),
    )


def _percentile(column: str, share: float, seq: str = "_seq", n: str = "_n") -> Column:
    """Linear interpolation between the two ranked rows around ``share``."""
    pos = (F.col(n) - 1) * F.lit(share)
    low = F.max(F.when(F.col(seq) == F.floor(pos), F.col(column)))
    high = F.max(F.when(F.col(seq) == F.ceil(pos), F.col(column)))
    return low + (high - low) * F.max(pos - F.floor(pos))


def percentiles(
    rows: DataFrame, column: str, shares: dict[str, float], keys: list[str] = (), tie: list[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Exact percentiles and row count, from ranks instead of one sorted task."""
    keys = list(keys)
    ranked = ordered_scan(
        rows.where(F.col(column).isNotNull()), keys, [column, *tie], seq="_seq", total="_n", chunks=chunks, once=True,
    )
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[_percentile(column, s).alias(name) for name, s in shares.items()]
    )


def latency_stats(latency: DataFrame, tie: list[str] = ("event_id",), chunks: int | None = None) -> DataFrame:
    """Bursts detected and missed, and the spread of the latency in ms."""
    missed = F.col("latency_ms").isNull().cast("int")
    ranked = ordered_scan(
        latency.withColumns({"_all": F.lit(1), "_missed": missed}), ["_all"], ["_missed", "latency_ms", *tie],
        seq="_seq", totals={"_n": 1 - F.col("_missed")}, chunks=chunks, once=True,
    )
    return ranked.groupBy("_all").agg(
        F.count(F.lit(1)).alias("n_bursts"), F.count("latency_ms").alias("detected"), F.sum("_missed").alias("missed"),
        F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"),
        _percentile("latency_ms", 0.5).alias("median_ms"), _percentile("latency_ms", 0.9).alias("p90_ms"),
    ).drop("_all")


def latency_by_technique(latency: DataFrame, tie: list[str] = ("event_id",), chunks: int | None = None) -> DataFrame:
    """Detected bursts and median latency per technique, fastest first."""
    named = latency.withColumn(
        "technique", F.when(F.coalesce("technique", F.lit("")) == "", UNATTRIBUTED).otherwise(F.col("technique"))
    )
    medians = percentiles(named, "latency_ms", {"median_ms": 0.5}, ["technique"], list(tie), chunks)
    return medians.orderBy("median_ms", "technique")


def feature_profile(windows: DataFrame, vocab: Vocabulary, ngram: int, n: int | None = None) -> DataFrame:
    """Mean count per feature in normal, attack and all windows, largest first.

    Means divide by all windows of the class, so absent features count as zero.
    """
    sums = (
        windows.select("label", F.explode(F.map_concat("bag", F.create_map(F.lit(-1), F.lit(1).cast("long")))).alias("feature_idx", "cnt"))
        .groupBy("feature_idx")
        .agg(
            F.sum(F.when(F.col("label") == 0, F.col("cnt"))).alias("s0"),
            F.sum(F.when(F.col("label") == 1, F.col("cnt"))).alias("s1"),
            F.sum("cnt").alias("s"),
        )
    )
    # Feature -1 counted the windows themselves.
    full = Window.partitionBy()
    means = sums.withColumns({f"_n{c}": F.max(F.when(F.col("feature_idx") == -1, F.col(c))).over(full) for c in ("s0", "s1", "s")})
    dim = vocab.feature_table(windows.sparkSession, ngram)

    def mean(c):
        return F.coalesce(F.col(c) / F.col(f"_n{c}"), F.lit(0.0))

    out = dim.join(means, "feature_idx", "left").select(
        "feature_idx", "feature", mean("s0").alias("mean_normal"), mean("s1").alias("mean_attack"), mean("s").alias("mean_all")
    )
    ranked = out.orderBy(F.desc("mean_all"), "feature_idx")
    return ranked if n is None else ranked.limit(n)


def top_by_importance(importances: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most important features and whether each beats the median importance."""
    median = F.percentile("importance", F.lit(0.5)).over(Window.partitionBy())
    return (
        importances.withColumn("above_median", F.col("importance") > median)
        .orderBy(F.desc("importance"), "feature_idx")
        .limit(n)
    )


def class_weights(windows: DataFrame) -> DataFrame:
    """Balanced weight n / (2 n_c) of each class."""
    counts = windows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (2 * F.col("n")))


def dataset_overview(windows: DataFrame) -> DataFrame:
    """Windows per split and class."""
    return windows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_windows")).orderBy("split", "label")


def fold_summary(fold_scores: DataFrame, keys: list[str] = (), score: str = "f1") -> DataFrame:
    return fold_scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_f1"), F.stddev_pop(score).alias("std_f1"), F.count(F.lit(1)).alias("n_folds")
    )


def best_config(results: DataFrame, score: str = "f1", ordinal: str = "ordinal") -> DataFrame:
    """The row with the highest score; the first of equals."""
    row = F.struct(*results.columns)
    return results.agg(F.max_by(row, F.struct(F.col(score), -F.col(ordinal))).alias("r")).select("r.*")


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) pairs that occur, from one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).where("value IS NOT NULL").distinct()
