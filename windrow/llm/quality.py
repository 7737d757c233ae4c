"""Quality by importance resampling: how much likelier a text is under target text than under raw text.

Texts are bags of hashed words, punctuation runs and neighbouring pairs. Counts over texts labelled
good give the target model, counts over all documents the raw model, both smoothed alike, so a
feature that neither knows well says nothing. A document's log weight is the sum of its features'
log ratios. Gumbel noise added to log weights turns the k largest into a sample without
replacement by weight; the noise is a hash of the row, so the sample can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import ship, with_computed, written
from windrow.llm.tokens import GOLDEN, WORD_OR_MARKS, draw_key, release_encoders, scramble, slices, text_column, word_hashes
from windrow.llm.topk import at_least, k_th

FEATURES = 1 << 16
# Labelled rows used at most for the target model and the cut: those of the smallest id hashes.
LABELLED = 50_000
# Rejecting a good document weighs this many times keeping a bad one when the cut is chosen.
GOOD_WEIGHT = 5.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) codes of all occurrences, sorted, as text * FEATURES + feature."""
    words, offsets = word_hashes(texts, WORD_OR_MARKS)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    same = of[1:] == of[:-1]
    pairs = scramble(words[:-1] * GOLDEN + words[1:])[same] if len(words) else words
    hashed = np.concatenate([words, pairs]) & np.uint64(FEATURES - 1)
    return np.sort(np.concatenate([of, of[1:][same]]) * FEATURES + hashed.astype(np.int64))


@dataclass
class Model:
    target: np.ndarray
    raw: np.ndarray

    def log_weights(self, texts: pa.Array, good: np.ndarray) -> np.ndarray:
        """Log weight of each text, by models that do not count the text itself."""
        out = []
        at = 0
        for part in slices(texts, 1_000_000):
            n = len(part)
            mine = good[at:at + n]
            at += n
            codes, counts = np.unique(features(part), return_counts=True)
            of, f = codes // FEATURES, codes % FEATURES
            total = np.bincount(of, counts, n)
            t_sum, r_sum = self.target.sum() - total * mine, self.raw.sum() - total
            prior = self.target.sum() / max(self.raw.sum(), 1)
            t = self.target[f] - counts * mine[of]
            r = self.raw[f] - counts
            ratio = np.log(t + prior) - np.log(np.maximum(r, 0) + 1)
            level = np.log(np.maximum(r_sum, 0) + FEATURES) - np.log(t_sum + prior * FEATURES)
            out.append(np.bincount(of, counts * ratio, n) + total * level)
        return np.concatenate(out) if out else np.zeros(0)


def labelled_sample(labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """doc_id, good of at most ``rows`` labelled ids, one row per id; an id labelled both ways is bad."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(
        F.col("doc_id").alias("labelled_id"), (F.col("quality") > 0).alias("good"))


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Counts over all documents, and over those that the sample calls good."""
    ship(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        total = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            texts = text_column(batch.column(0))
            good = np.asarray(batch.column(1).fill_null(False))
            at = 0
            for part in slices(texts, 1_000_000):
                codes = features(part)
                mine = good[at:at + len(part)][codes // FEATURES]
                at += len(part)
                total[0] += np.bincount(codes % FEATURES, minlength=FEATURES)
                total[1] += np.bincount(codes[mine] % FEATURES, minlength=FEATURES)
        f = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(total[0][f]), pa.array(total[1][f])], names=["f", "raw", "target"])

    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left")
    counted = marked.select("text", "good").mapInArrow(count, "f long, raw long, target long").groupBy("f").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    model = Model(np.zeros(FEATURES), np.zeros(FEATURES))
    for r in counted:
        model.raw[r["f"]], model.target[r["f"]] = r["raw"], r["target"]
    return model


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


COMPUTED = "log_weight double, key double, key_bits long, tie long"


def _scorer(model: Model, seed: int):
    """Arrow arrays of ``COMPUTED`` for texts, whether they are labelled good, and ties."""

    def score(text, good, tie):
        ties = np.asarray(tie, np.int64)
        weight = model.log_weights(text_column(text), np.asarray(good.fill_null(False)).astype(np.float64))
        uniform = (scramble(ties.view(np.uint64) + draw_key(seed)) >> np.uint64(11)).astype(np.float64)
        key = weight - np.log(-np.log((uniform + 0.5) / 2.0 ** 53))
        return [pa.array(weight), pa.array(key), pa.array(_ordered_bits(key)), tie]

    return score


def _tie(doc_id, text):
    return F.xxhash64(doc_id, text.cast("string"))


def weights(docs: DataFrame, sample: DataFrame, model: Model, seed: int) -> DataFrame:
    """doc_id, good, log_weight, its Gumbel key, key_bits and tie (longs in the key's order)."""
    ship(docs.sparkSession)
    score = _scorer(model, seed)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            made = score(batch.column(3), batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made], names=["doc_id", "good", "log_weight", "key", "key_bits", "tie"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left")
    rows = rows.select("doc_id", "good", _tie(F.col("doc_id"), F.col("text")).alias("tie"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, good boolean, {COMPUTED}")


def weighted_rows(docs: DataFrame, sample: DataFrame, model: Model, seed: int) -> DataFrame:
    """``row.row`` (the document's columns) with ``COMPUTED``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(
        F.broadcast(sample), F.col("row.doc_id") == F.col("labelled_id"), "left").select("row", "good")
    tie = _tie(F.col("row.doc_id"), F.col("row.text"))
    return with_computed(packed, [F.col("good"), tie], _scorer(model, seed), COMPUTED, text=("row", "text"))


def best_cut(scores: list[tuple[float, bool]]) -> float:
    """The log weight from which on to keep: least weighted error rate on the labelled rows.

    With only one class seen, or none, everything is kept.
    """
    values = np.array([s for s, _ in scores], float)
    good = np.array([g for _, g in scores], bool)
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(values, kind="stable")
    values, good = values[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    kept = 1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    # A cut stands between two different values.
    free = np.concatenate([[True], values[1:] != values[:-1], [True]])
    cost = np.where(free, GOOD_WEIGHT * lost + kept, np.inf)
    at = int(np.argmin(cost))
    if at == 0:
        return -np.inf
    if at == len(values):
        return float(np.nextafter(values[-1], np.inf))
    return float((values[at - 1] + values[at]) / 2)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1, full_rows: bool = False) -> DataFrame:
    """The k documents of the largest Gumbel keys.

    Gives doc_id, log_weight, key, kept of every row; with ``full_rows`` the kept rows of ``docs``
    themselves. Reads doc_id and text of ``docs`` and doc_id and quality of ``labels``; other
    columns do not matter, whatever their names. Without ``k``, k is the number of documents whose
    log weight reaches the cut that separates the labelled rows best.

    NULL and empty texts have no features and log weight 0; NULL ids are never labelled; rows equal
    in doc_id and text get one key and stand or fall together. Without labelled good rows all
    weights are 0, and without both classes every row is kept. An empty table gives no rows.
    """
    sample = written(labelled_sample(labels), "labelled")
    model = fit(docs, sample)
    if not model.target.any():
        model.target = model.raw.copy()
        model.raw = model.raw + 0.0
    scored = written(weights(docs, sample, model, seed), "weights")
    if k is None:
        # At most LABELLED different ids.
        seen = scored.where("good IS NOT NULL").groupBy("doc_id").agg(
            F.min("log_weight").alias("w"), F.first("good").alias("good")).collect()
        cut = best_cut([(r["w"], r["good"]) for r in seen])
        k = scored.where(F.col("log_weight") >= cut).count()
    keys = ["key_bits", "tie"]
    bound = k_th(scored.select(*keys), keys, k)
    keep = at_least(keys, bound) if k else F.lit(False)
    if not full_rows:
        return scored.select("doc_id", "log_weight", "key", keep.alias("kept"))
    return weighted_rows(docs, sample, model, seed).where(keep).select("row.row.*")
