"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Quality, language, near-duplicates and benchmark passages each remove documents; what is left is
packed. A stage decides by the rows it is given alone, besides the tables ``labels`` and
``benchmark``. No stage can be said in SQL as a whole, so there is no SQL twin.
"""

from __future__ import annotations

import public_tokenizers

from windrow.llm import decontamination, language, near_duplicates, packing, quality
from windrow.llm.common import written
from windrow.llm.queries import END_ID, learnable

# A text of which no language holds this share is no text of a language, nor is one that the learned
# languages explain worse than halfway to a flat model, by more than this in nats.
LEAST_SHARE = 0.4
LEAST_SUPPORT = -10.0


def good_quality(spark, docs, sf_dir):
    """Documents sampled by importance; those that do not look like text labelled good go."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), full_rows=True)


def known_language(spark, docs, sf_dir):
    """Documents in a language learned from the documents' own labels."""
    model = language.fit(docs, learnable("doc_id"))
    return language.keep_identified(docs, model, LEAST_SHARE, LEAST_SUPPORT)


def one_of_each(spark, docs, sf_dir):
    """One document of each class of near duplicates."""
    return near_duplicates.keep_one(docs, similarity=0.8)


def no_benchmark(spark, docs, sf_dir):
    """Documents without a ten-word window of a benchmark item."""
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def packed(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, capacity=4096).drop("ids")


STAGES = [
    ("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark), ("packing", packed),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
