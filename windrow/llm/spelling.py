"""Spelling variants of the words of a corpus, grouped by the rotations of a permuterm index.

A word is closed with a mark and turned to every place. Two words that differ by one replaced
character share, at the turn that brings this character to the end, everything before it; a word
that lacks the character is that same prefix as a whole turn of its own. So one sort of all turns
by prefix puts all words at a distance of one next to each other, in groups whose members differ
in one character and are at most one more than the alphabet. A scan of each group tells every
member how many others it has and which is the most frequent; no pairs are listed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import discard, ship, written
from windrow.llm.tokens import LOWER, give_back, run_strings, runs, slices, text_bytes, text_column
from windrow.llm.words import CUT_BYTES, byte_set

# The mark that closes a word; no word holds it.
END = "$"
ASCII_LETTERS = byte_set((65, 90), (97, 122))
LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def run_crcs(raw: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of every run of bytes, carried on from the crc32 ``start`` of what stands before it."""
    state = start.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(first - last, kind="stable")  # longest first: the open runs are a prefix
    at, length, open_state = first[order], (last - first)[order], state[order]
    for step in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -step, side="left"))
        part = open_state[:n]
        open_state[:n] = CRC[(part ^ raw[at[:n] + step]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    state[order] = open_state
    return state ^ np.uint32(0xFFFFFFFF)


def word_counts(docs: DataFrame, least_length: int = 6, noise: int = 199) -> DataFrame:
    """word, n: how often each word of at least ``least_length`` code points occurs.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where
    ``noise`` divides the crc32 of ``<doc_id>:<word>``, the code point at crc32 % length is left out.
    NULL and empty texts have no words; a NULL doc_id reads as an empty string; repeated rows count
    each; other columns are not read. Counts are added up by batch before they are shuffled.
    """
    ship(docs.sparkSession)
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")

    def run(batches):
        for batch in batches:
            prefixes = batch.column(0).to_pylist()
            at = 0
            for texts in slices(text_column(batch.column(1)), CUT_BYTES):
                words = _words(texts, prefixes[at:at + len(texts)])
                at += len(texts)
                if len(words):
                    counted = words.value_counts()
                    yield pa.RecordBatch.from_arrays(
                        [counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "n"])
            give_back()

    def _words(texts, prefixes):
        raw, offsets = text_bytes(texts)
        inside = ASCII_LETTERS[raw]
        lead = np.flatnonzero(raw == LEAD)
        inside[lead] = inside[lead + 1] = True
        first, last = runs(inside, offsets)
        starts_before = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=starts_before[1:])
        points = starts_before[last] - starts_before[first]
        long = points >= least_length
        first, last, points = first[long], last[long], points[long]
        raw = LOWER[raw]
        before = np.array([zlib.crc32(f"{p}:".encode()) for p in prefixes], np.uint32)
        text = np.searchsorted(offsets, first, side="right") - 1
        crc = run_crcs(raw, first, last, before[text])
        cut = crc % noise == 0
        kept = run_strings(raw, first[~cut], last[~cut])
        changed = []
        for a, b, size, h in zip(first[cut].tolist(), last[cut].tolist(), points[cut].tolist(), crc[cut].tolist()):
            if size > least_length:
                word = raw[a:b].tobytes().decode()
                changed.append(word[:h % size] + word[h % size + 1:])
        return pa.concat_arrays([kept, pa.array(changed, pa.large_string())])

    found = docs.select(ids, "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """word, n, prefix, whole, repeated: all turns of all words without the character they skip.

    ``whole`` marks the turns that skip nothing. Skipping either of two equal neighbours leaves the
    same turn of the shorter word; ``repeated`` marks all but the first of such.
    """
    size = F.length("word")
    at = F.explode(F.sequence(F.lit(0), size)).alias("at")
    turned = words.select("word", "n", at).select(
        "word", "n", "at",
        F.expr(f"concat(substring(word, at + 1), '{END}', substring(word, 1, at))").alias("turn"),
    )
    whole = turned.select("word", "n", F.col("turn").alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("repeated"))
    short = turned.where("at > 0").select(
        "word", "n", F.expr("substring(turn, 1, length(turn) - 1)").alias("prefix"), F.lit(False).alias("whole"),
        F.expr("substring(turn, -1) = substring(turn, -2, 1)").alias("repeated"),
    )
    return whole.unionByName(short)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: how many words of ``words`` (word, n) are near each, and the best of them.

    Near is one inserted, deleted or replaced code point; best is the most frequent, the smallest of
    equally frequent ones. Words without a near word have no row.
    """
    turns = rotations(words)
    sorted_group = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    all_sorted = sorted_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group = Window.partitionBy("prefix")
    entry = F.struct("n", "word")
    scanned = turns.select(
        "word", "whole", "repeated",
        F.row_number().over(sorted_group).alias("place"),
        F.count(F.lit(1)).over(group).alias("size"),
        F.max("whole").over(group).alias("has_whole"),
        F.count_if(~F.col("whole") & ~F.col("repeated")).over(group).alias("fresh"),
        F.count_if(~F.col("whole")).over(group).alias("replaced"),
        F.nth_value(entry, 1).over(all_sorted).alias("top"), F.nth_value(entry, 2).over(all_sorted).alias("next"),
    ).where("size > 1")
    best = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    others = F.when(F.col("whole"), F.col("fresh")).otherwise(
        F.col("replaced") - 1 + (F.col("has_whole") & ~F.col("repeated")).cast("int"))
    found = scanned.select("word", others.alias("others"), best["n"].alias("best_n"), best["word"].alias("best"))
    ranked = F.struct((-F.col("best_n")).alias("by"), F.col("best").alias("word"))
    out = found.groupBy("word").agg(F.sum("others").alias("n_near"), F.min(ranked).alias("top"))
    return out.select("word", "n_near", (-F.col("top.by")).alias("best_n"), F.col("top.word").alias("best"))


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n).

    A word's form is its best near word if that occurs at least ``factor`` times as often, else NULL.
    The root is where the forms lead. Counts grow by the factor at each step, so a root is at most
    log(largest n) / log(factor) steps away and pointer doubling ends after a few rounds.
    """
    near = neighbours(words)
    ok = F.col("best_n") >= factor * F.col("n")
    found = written(words.join(near, "word", "left").select(
        "word", F.when(ok, F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best_n")).alias("form_n"),
    ), "spelling")
    links = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = written(links.join(on, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-links")
        moved = further.where("moved").limit(1).count()
        discard(links)
        links = further.drop("moved")
        links._written_at = further._written_at
        if not moved:
            break
    return found.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int = 199, factor: int = 5) -> DataFrame:
    """Variants among the words of all texts that occur at least ``least_count`` times."""
    counted = word_counts(docs, least_length, noise).where(F.col("n") >= least_count)
    return variants(written(counted, "spelling-words"), factor)
