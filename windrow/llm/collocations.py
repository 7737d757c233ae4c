"""Collocations: phrases of two and three words that stand together more than their parts explain.

Phrases grow from their prefixes, best first. Words are counted, then pairs of words that occur
often enough. The count of a pair bounds every phrase grown from it: a phrase x y z occurs at most
as often as x y, and what is left after x occurs at least as often as the phrase, so its score is at
most f(x y) / f(x). Each round sets a goal for every language that is not settled, grows all pairs
whose bound reaches it and looks for longer phrases around all pairs that reach it themselves;
growing means one more count over the texts, of these phrases alone. A language is settled when as
many phrases as are asked for survive at its goal or above: whatever was not grown is below it. Else
its goal falls to that of a deeper rank.

Counts are exact. Words go by 64-bit keys, which are checked to be different for all words; what is
counted in a round is chosen by bit tables of a fixed largest size, in which a chance hit only adds
a phrase that is counted like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import discard, ship, written
from windrow.llm.tokens import (
    LOWER, draw_key, give_back, run_hashes, run_strings, runs, scramble, slices, text_bytes, text_column,
)
from windrow.llm.words import CUT_BYTES, byte_set

BLANK = byte_set(0x20, 0x09)
MARKS = byte_set(*b".,;:!?", (0x0A, 0x0D))
SCALE = 1_000_000
NO_LANGUAGE = "und"
MOST_BITS = 26  # a bit table of 8 MB
# The rank of the first goal, and how much deeper each next one lies, as multiples of what is asked for.
FIRST, DEEPER = 2, 8
SALTS = 64


class _Cut:
    """Words of a run of texts: key, text, and whether the next word is in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        raw, offsets = text_bytes(texts)
        self.raw = LOWER[raw]
        self.first, self.last = runs(~(BLANK | MARKS)[self.raw], offsets)
        self.text = np.searchsorted(offsets, self.first, side="right") - 1
        coded = langs.dictionary_encode()
        names = coded.dictionary.to_pylist()
        by_name = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in names], np.uint64)
        self.keys = scramble(run_hashes(self.raw, self.first, self.last) ^ by_name[np.asarray(coded.indices)][self.text])
        marks = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(MARKS[self.raw], out=marks[1:])
        piece = marks[self.first]
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])


def _cuts(batches, seed):
    for batch in batches:
        langs, at = batch.column(0), 0
        for part in slices(text_column(batch.column(1)), CUT_BYTES):
            of = langs.slice(at, len(part))
            at += len(part)
            yield _Cut(part, of, seed), of
        give_back()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return scramble(x + draw_key(3)) ^ y


def _places(keys: np.ndarray, bits: int):
    """Two bits of the table for every key."""
    for turn in (5, 6):
        yield scramble(keys + draw_key(turn)) & np.uint64((1 << bits) - 1)


def _bit_table(keys: DataFrame, count: int):
    """A broadcast table of at most 2^26 bits that holds every key of ``keys`` (x or x, y)."""
    bits = int(min(MOST_BITS, max(10, np.ceil(np.log2(16 * max(count, 1))))))
    pairs = len(keys.columns) > 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c, np.int64).view(np.uint64) for c in batch.columns]
            one = _pair_key(*columns) if pairs else columns[0]
            at = np.unique(np.concatenate(list(_places(one, bits))))
            slot = at >> np.uint64(6)
            heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            words = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), heads)
            yield pa.RecordBatch.from_arrays([_signed(slot[heads]), _signed(words)], names=["slot", "bits"])

    merged = keys.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[np.asarray(merged.column("slot"), np.int64)] = np.asarray(merged.column("bits"), np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast((bits, table))


def _holds(shared, keys: np.ndarray) -> np.ndarray:
    bits, table = shared.value
    out = np.ones(len(keys), bool)
    for at in _places(keys, bits):
        out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _count_words(texts: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        for cut, langs in _cuts(batches, seed):
            if len(cut.keys):
                keys, at, counts = np.unique(cut.keys, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys), langs.take(pa.array(cut.text[at])),
                     run_strings(cut.raw, cut.first[at], cut.last[at]).cast(pa.string()), pa.array(counts)],
                    names=["x", "lang", "word", "f"])

    found = texts.mapInArrow(run, "x long, lang string, word string, f long")
    return found.groupBy("x", "lang", "word").agg(F.sum("f").alias("f"))


def _count_pairs(texts: DataFrame, seed: int, often) -> DataFrame:
    def run(batches):
        for cut, _ in _cuts(batches, seed):
            kept = _holds(often, cut.keys)
            at = np.flatnonzero(cut.joined & kept[1:] & kept[:-1])
            yield pa.RecordBatch.from_arrays([_signed(cut.keys[at]), _signed(cut.keys[at + 1])], names=["x", "y"])

    return texts.mapInArrow(run, "x long, y long").groupBy("x", "y").agg(F.count(F.lit(1)).alias("a"))


def _count_triples(texts: DataFrame, seed: int, often, prefixes, suffixes) -> DataFrame:
    """Counts of x y z where x y is among the prefixes or y z among the suffixes."""
    def run(batches):
        for cut, _ in _cuts(batches, seed):
            at = np.flatnonzero(cut.joined[1:] & cut.joined[:-1])
            x, y, z = (cut.keys[at + i] for i in range(3))
            left, right = _pair_key(x, y), _pair_key(y, z)
            kept = (_holds(prefixes, left) & _holds(often, right)) | (_holds(suffixes, right) & _holds(often, left))
            yield pa.RecordBatch.from_arrays([_signed(c[kept]) for c in (x, y, z)], names=["x", "y", "z"])

    return texts.mapInArrow(run, "x long, y long, z long").groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("a"))


def _score(a: str, l: str, r: str):
    """floor(SCALE * a * a / (l * r)) in whole numbers; at most SCALE, as a is at most l and r."""
    wide = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in (a, l, r)}
    return F.expr(f"CAST(({SCALE} * ({wide[a]} * {wide[a]})) div ({wide[l]} * {wide[r]}) AS LONG)")


def _at_rank(scored: DataFrame, rank: int) -> DataFrame:
    """lang, goal, reached: the score at a rank of each language (0 beyond its last), how many reach it.

    A language has at most SCALE + 1 different scores; they are added up in two steps.
    """
    coarse = scored.groupBy("lang", F.expr("score div 1000").alias("part"), "score").agg(F.count(F.lit(1)).alias("c"))
    parts = coarse.groupBy("lang", "part").agg(F.sum("c").alias("in_part"))
    down = Window.partitionBy("lang").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("above", F.coalesce(F.sum("in_part").over(down), F.lit(0)))
    within = Window.partitionBy("lang", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = coarse.join(parts, ["lang", "part"]).withColumn("reached", F.col("above") + F.sum("c").over(within))
    hit = F.col("reached") >= rank
    return reached.groupBy("lang").agg(
        F.coalesce(F.max(F.when(hit, F.col("score"))), F.lit(0)).alias("goal"),
        F.coalesce(F.min(F.when(hit, F.col("reached"))), F.max("reached")).alias("reached"))


def _scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both cuts of every triple; the lower score counts, the earlier cut of equal ones."""
    left = pairs.select("x", "y", F.col("lang"), F.col("a").alias("f_xy"), F.col("fx").alias("f_x"))
    right = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("f_yz"), F.col("fy").alias("f_z"))
    both = triples.join(left, ["x", "y"]).join(right, ["y", "z"])
    both = both.withColumn("s1", _score("a", "f_x", "f_yz")).withColumn("s2", _score("a", "f_xy", "f_z"))
    early = F.col("s1") <= F.col("s2")
    return both.select(
        "lang", "x", "y", "z", "a", F.when(early, F.col("f_x")).otherwise(F.col("f_xy")).alias("l"),
        F.when(early, F.col("f_yz")).otherwise(F.col("f_z")).alias("r"), F.least("s1", "s2").alias("score"))


def mine_collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Texts (A-Z lower-cased) are cut into pieces at ``.,;:!?`` and line breaks, and those into words at
    spaces and tabs. A phrase of two or three words of one piece is a candidate if it occurs at least
    ``least`` times (a). Cut in two, with l and r the counts of the parts, it scores
    floor(1000000 * a * a / (l * r)); its lowest cut counts. A pair goes where a longer candidate that
    holds it occurs at least ``share`` percent as often. n is the number of words of the language.
    Order: score, a, both descending, then the phrase in byte order.

    NULL languages are ``und``; NULL and empty texts have no words; repeated rows count each; other
    columns are not read. Without candidates there are no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text").where("text IS NOT NULL")
    words = written(_count_words(texts, seed), "words")
    if words.groupBy("x").count().where("count > 1").limit(1).count():
        discard(words)
        return mine_collocations(docs, least, top, share, seed + 1)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    shared = [_bit_table(frequent.select("x"), frequent.count())]

    counted = written(_count_pairs(texts, seed, shared[0]).where(F.col("a") >= least), "pairs")
    pairs = written(
        counted.join(frequent.select("x", "lang", F.col("f").alias("fx")), "x")
        .join(frequent.select(F.col("x").alias("y"), F.col("f").alias("fy")), "y")
        .select("lang", "x", "y", "a", "fx", "fy", _score("a", "fx", "fy").alias("score"),
                F.expr(f"CAST({SCALE} * CAST(a AS DECIMAL(20, 0)) div fx AS LONG)").alias("bound")), "pairs-scored")
    discard(counted)
    shared.append(_bit_table(pairs.select("x", "y"), pairs.count()))

    known, rank, before = None, FIRST * top, None
    while True:
        items = pairs.select("lang", "score")
        if known is not None:
            items = items.union(known.select("lang", "score"))
        goal = _at_rank(items, rank).select("lang", "goal")
        if before is not None:  # settled languages keep their goal
            goal = goal.join(before.where("settled").select("lang", F.col("goal").alias("kept")), "lang", "left").select(
                "lang", F.coalesce("kept", "goal").alias("goal"))
        goal = written(goal, "goals")
        wanted = pairs.join(F.broadcast(goal) if goal.count() <= 1000 else goal, "lang")
        if before is not None:
            wanted = wanted.join(before.where("NOT settled").select("lang"), "lang", "left_semi")
        prefixes = wanted.where("bound >= goal OR score >= goal").select("x", "y")
        suffixes = wanted.where("score >= goal").select("x", "y")
        filters = [_bit_table(part, part.count()) for part in (prefixes, suffixes)]
        grown = _count_triples(texts, seed, shared[1], *filters).where(F.col("a") >= least)
        grown = _scored_triples(grown, pairs)
        if known is not None:
            grown = grown.join(known.select("x", "y", "z"), ["x", "y", "z"], "left_anti").select(known.columns).union(known)
        grown = written(grown, "triples")
        for table in filters:
            table.unpersist()
        discard(*[t for t in (known, before) if t is not None])
        known = grown
        survivors = written(_survivors(pairs, known, goal, share), "survivors")
        done = _at_rank(survivors, top).select("lang", "reached")
        before = written(goal.join(done, "lang", "left").select(
            "lang", "goal", ((F.col("goal") == 0) | (F.coalesce("reached", F.lit(0)) >= top)).alias("settled")), "settled")
        discard(goal)
        if not before.where("NOT settled").limit(1).count():
            break
        discard(survivors)
        rank *= DEEPER
    for table in shared:
        table.unpersist()
    out = _ranked(survivors, frequent, totals, top)
    return out


def _survivors(pairs: DataFrame, triples: DataFrame, goal: DataFrame, share: int) -> DataFrame:
    """Pairs and triples at their language's goal or above, without the pairs that a triple covers."""
    most_after = triples.groupBy("x", "y").agg(F.max("a").alias("after"))
    most_before = triples.groupBy(F.col("y").alias("x"), F.col("z").alias("y")).agg(F.max("a").alias("ahead"))
    kept = pairs.join(most_after, ["x", "y"], "left").join(most_before, ["x", "y"], "left")
    longer = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("ahead", F.lit(0)))
    kept = kept.where(100 * longer < share * F.col("a")).select(
        "lang", "x", "y", F.lit(None).cast("long").alias("z"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    every = kept.union(triples.select(kept.columns))
    return every.join(goal, "lang").where("score >= goal").drop("goal")


def _ranked(survivors: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first rows of every language; each of many parts gives its first ones before they meet."""
    cut = _at_rank(survivors, top).select("lang", "goal")
    near = survivors.join(cut, "lang").where("score >= goal").drop("goal")
    for c in ("x", "y", "z"):
        near = near.join(words.select(F.col("x").alias(c), F.col("word").alias(f"w{c}")), c, "left" if c == "z" else "inner")
    named = near.select("lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = named.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
