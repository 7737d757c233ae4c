"""Exact token accounting from a histogram of encoded lengths.

Documents are reduced to their number of tokens and counted by length. Suffix sums over that
histogram answer, for every context limit, how many documents and tokens fit, how many are cut,
and how many tokens a cut at the limit keeps, besides totals and quantiles.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import partition_offsets, ship
from windrow.llm.tokens import encoded_slices, encoder


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, docs: documents by encoded length. NULL and empty texts have no tokens.

    Only ``text`` is read, so doc ids may be NULL or repeat and other columns do not matter. Every
    row counts. Tasks count their own lengths before anything is shuffled.
    """
    ship(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]):
        coder = encoder(tokenizer)
        for _, _, offsets in (x for b in batches for x in encoded_slices(coder, b, 0)):
            lengths, docs_of = np.unique(np.diff(offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(docs_of)], names=["n_tokens", "docs"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "n_tokens long, docs long")
    return counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def length_curve(histogram: DataFrame) -> DataFrame:
    """The histogram with running sums: one row per length L that occurs.

    docs_within and tokens_within count documents of at most L tokens, docs_over and tokens_over
    the longer ones; truncated_tokens is what remains when all are cut at L; quantile is the share
    of documents of at most L tokens. Sums run in two levels, so no task sees all lengths.
    """
    tokens = F.col("n_tokens") * F.col("docs")
    docs_before = partition_offsets(histogram, "n_tokens", "docs").withColumnRenamed("before", "_docs")
    tokens_before = partition_offsets(
        histogram.withColumn("_t", tokens), "n_tokens", "_t").withColumnRenamed("before", "_tokens")
    # One row: the totals.
    total = histogram.agg(F.sum("docs").alias("_n"), F.sum(tokens).alias("_all"))
    within = histogram.join(docs_before, "n_tokens").join(tokens_before, "n_tokens").join(F.broadcast(total)).withColumns({
        "docs_within": F.col("_docs") + F.col("docs"), "tokens_within": F.col("_tokens") + tokens,
    }).withColumns({"docs_over": F.col("_n") - F.col("docs_within"), "tokens_over": F.col("_all") - F.col("tokens_within")})
    return within.select(
        "n_tokens", "docs", "docs_within", "tokens_within", "docs_over", "tokens_over",
        (F.col("tokens_within") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("docs_within") / F.col("_n")).alias("quantile"),
    )


def limits(curve: DataFrame, contexts: list[int]) -> DataFrame:
    """What each context limit keeps: docs and tokens within it, docs over it, tokens after cutting.

    A limit falls on the last length not above it, or before all of them.
    """
    spark = curve.sparkSession
    asked = spark.createDataFrame([(int(c),) for c in contexts], "context long")
    total = curve.agg(
        F.sum("docs").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("docs")).alias("n_tokens"))
    at = asked.join(curve.drop("docs"), F.col("n_tokens") <= F.col("context"), "left").groupBy("context").agg(
        F.max_by(F.struct("docs_within", "tokens_within"), "n_tokens").alias("at"))
    docs, tokens = (F.coalesce(F.col(f"at.{c}"), F.lit(0)) for c in ("docs_within", "tokens_within"))
    return at.join(F.broadcast(total)).select(
        "context", docs.alias("docs_within"), tokens.alias("tokens_within"),
        (F.coalesce("n_docs", F.lit(0)) - docs).alias("docs_over"),
        (tokens + (F.coalesce("n_docs", F.lit(0)) - docs) * F.col("context")).alias("truncated_tokens"))


def quantiles(curve: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed, for each share."""
    asked = curve.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return asked.join(curve, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
