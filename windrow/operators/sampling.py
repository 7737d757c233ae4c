"""Balancing, splits and folds by hash rank: exact sizes, repeatable, distributed.

A row's rank is the order of ``md5(seed:key)``. Cuts at a rank are found by
counting hash prefixes, so the data itself is only filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.operators.ordered import ordered_scan
from windrow.storage import materialize

HASH = "_hash"
PREFIX = 4
FEW = 1000


def hash_of(seed: int, key: list[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def cut_at_rank(hashed: DataFrame, k: int) -> str | None:
    """The hash such that exactly ``k`` rows have it or a smaller one.

    None when ``k`` reaches all rows. Each round counts rows per hash prefix
    (at most 16**4 groups) and narrows to the prefix holding rank ``k``.
    """
    if k <= 0:
        return ""
    known, left = "", k
    while True:
        here = hashed.where(F.col(HASH).startswith(known)) if known else hashed
        width = len(known) + PREFIX
        counts = here.groupBy(F.substring(HASH, 1, width).alias("p")).count().collect()
        for row in sorted(counts, key=lambda r: r["p"]):
            if left <= row["count"]:
                break
            left -= row["count"]
        else:
            return None
        known = row["p"]
        if width >= 32:
            if left < row["count"]:
                raise ValueError("the sampling key repeats: rows with one key cannot be told apart")
            return known
        if row["count"] <= FEW:
            rows = hashed.where(F.col(HASH).startswith(known)).select(HASH).collect()
            found = sorted(r[HASH] for r in rows)
            if left < len(found) and found[left - 1] == found[left]:
                raise ValueError("the sampling key repeats: rows with one key cannot be told apart")
            return found[left - 1]


def _below(hash_col: Column, cut: str | None) -> Column:
    return F.lit(True) if cut is None else hash_col <= cut


def class_sizes(windows: DataFrame, label: str = "label") -> dict[int, int]:
    return {r[label]: r["count"] for r in windows.groupBy(label).count().collect()}


def undersample(windows: DataFrame, key: list[str], ratio: float = 2.0, seed: int = 42) -> DataFrame:
    """Keep every attack window and at most ``floor(attack * ratio)`` normal ones.

    Without attack windows nothing is dropped.
    """
    windows = materialize(windows, "sampled")  # read once per class and round
    sizes = class_sizes(windows)
    cap = int(sizes.get(1, 0) * ratio)
    if not sizes.get(1) or sizes.get(0, 0) <= cap:
        return windows
    hashed = windows.withColumn(HASH, hash_of(seed, key))
    cut = cut_at_rank(hashed.where("label = 0").select(HASH), cap)
    return hashed.where((F.col("label") == 1) | _below(F.col(HASH), cut)).drop(HASH)


def stratified_split(windows: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` = train / test with the exact test share of each class."""
    windows = materialize(windows, "sampled")  # read once per class and round
    hashed = windows.withColumn(HASH, hash_of(seed, key))
    is_train = F.lit(False)
    for label, size in sorted(class_sizes(windows).items()):
        cut = cut_at_rank(hashed.where(F.col("label") == label).select(HASH), size - round(size * test_share))
        is_train = is_train | ((F.col("label") == label) & _below(F.col(HASH), cut))
    return hashed.withColumn("split", F.when(is_train, "train").otherwise("test")).drop(HASH)


def stratified_folds(windows: DataFrame, key: list[str], k: int = 5, seed: int = 42, chunks: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes of a class differ by at most one."""
    h = hash_of(seed, key)
    digits = {"_h1": F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), "_h2": F.conv(F.substring(h, 16, 15), 16, 10).cast("long")}
    ranked = ordered_scan(windows.withColumns(digits), ["label"], ["_h1", "_h2"], seq="_rank", chunks=chunks)
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_h1", "_h2", "_rank")


def sample_n(rows: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement; all of them when there are no more."""
    hashed = materialize(rows, "sampled").withColumn(HASH, hash_of(seed, key))
    cut = cut_at_rank(hashed.select(HASH), n)
    return hashed.where(_below(F.col(HASH), cut)).drop(HASH)
