"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Training texts are cut into words, and the postings (text key, position, term) of every word that
some benchmark item uses are stored as a table. An item's windows are found in it without reading
texts again: each window starts from its rarest term, whose postings are intersected with the
second rarest at the right distance; what remains names (text, item, alignment) candidates, whose
other positions are then intersected too. Runs of consecutive agreeing positions as long as a
window are exact phrase matches. ``proximity_matches`` answers the looser question, all terms of a
window close together in any order.

Texts are known by a 128-bit content key, so copies of a text share their postings' outcome
however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from windrow.llm.common import key_columns, written
from windrow.storage import BROADCAST_ROWS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]
ITEM = ["c1", "c2"]
# Text keys fall into so many groups; a list of groups that hold candidates is at most this long.
GROUPS = 1 << 20


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of ASCII letters, digits and all other characters."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, CASED_SEPARATORS), "")), F.lit(0)).cast("long")


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows; other joins stay with Spark's choice."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass
class Phrases:
    """Benchmark items by content: their words, all windows, and which item ids have which content."""

    contents: DataFrame  # c1, c2, terms array<long>, n, need
    windows: DataFrame  # c1, c2, start, w1, w2, need
    items: DataFrame  # c1, c2, item
    vocabulary: DataFrame  # word, term


def phrases(items: DataFrame, width: int) -> Phrases:
    """``items`` has item_id and text. Items without words or with NULL text have no windows; NULL
    item ids count as one item named by the empty string; repeated rows count once."""
    cut = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text").cast("string")).alias("words"),
    ).where(F.size("words") > 0)
    cut = written(cut.select(
        "item", "words", F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(7), "words", F.lit(11)).alias("c2")), "items")
    vocabulary = cut.select(F.explode("words").alias("word")).distinct()
    seed = 0
    while True:  # terms are hashes without a collision among the items' words
        named = vocabulary.withColumn("term", F.xxhash64(F.lit(seed), "word"))
        n = named.agg(F.count("word").alias("words"), F.count_distinct("term").alias("terms")).first()
        if n["words"] == n["terms"]:
            break
        seed += 1
    contents = cut.dropDuplicates(ITEM).select(
        *ITEM, F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)).alias("terms"),
        F.size("words").alias("n"), F.least(F.lit(width), F.size("words")).alias("need"))
    contents = written(contents, "contents")
    windows = contents.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("need"))))
    part = F.slice("terms", F.col("start") + 1, F.col("need"))
    windows = written(windows.select(
        *ITEM, "start", F.xxhash64(part).alias("w1"), F.xxhash64(F.lit(7), part, F.lit(11)).alias("w2"), "need"), "windows")
    return Phrases(contents, windows, cut.select(*ITEM, "item").distinct(), named)


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings k1, k2, pos, term of the vocabulary's words in all texts, written as a table.

    Rows of equal texts are alike; readers drop the repeats after narrowing the terms.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(*key_columns(text), words(text).alias("words")).where(F.size("words") > 0)
    found = keyed.select(*KEY, F.posexplode("words").alias("pos", "word")).join(small(vocabulary), "word")
    return written(found.select(*KEY, "pos", "term"), "postings")


def rarest_terms(index: DataFrame, ph: Phrases, width: int) -> DataFrame:
    """One row per different window: its first occurrence (c1, c2, start), need, and its two rarest
    terms t1, t2 at offsets j1, j2. Windows with a term that no text has are left out."""
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    first = ph.windows.groupBy("w1", "w2").agg(F.min(F.struct(*ITEM, "start", "need")).alias("at")).select("w1", "w2", "at.*")
    spread = first.join(ph.contents.select(*ITEM, "terms"), ITEM).select(
        "w1", "w2", *ITEM, "start", "need", F.posexplode(F.slice("terms", F.col("start") + 1, F.col("need"))).alias("j", "term"))
    counted = spread.join(small(frequency), "term", "left")
    ordered = counted.groupBy("w1", "w2", *ITEM, "start", "need").agg(
        # At most ``width`` entries.
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "term"))).alias("by"))
    two = ordered.where(F.col("by")[0]["n"] > 0).withColumn("second", F.get("by", F.least(F.size("by") - 1, F.lit(1))))
    return two.select(
        *ITEM, "start", "need", F.col("by")[0]["term"].alias("t1"), F.col("by")[0]["j"].alias("j1"),
        F.col("second.term").alias("t2"), F.col("second.j").alias("j2"))


def _group() -> Column:
    return F.pmod("k1", F.lit(GROUPS))


def in_groups_of(index: DataFrame, candidates: DataFrame) -> DataFrame:
    """Postings of texts whose key group holds a candidate; the group list has at most 2**20 rows."""
    groups = candidates.select(_group().alias("_g")).distinct()
    return index.withColumn("_g", _group()).join(F.broadcast(groups), "_g", "left_semi").drop("_g")


def phrase_runs(index: DataFrame, ph: Phrases, width: int) -> DataFrame:
    """Exact matches: k1, k2, c1, c2, diag, first, last, need.

    Words diag+first..diag+last of the text are words first..last of the item, at least ``need`` of
    them. Every window that occurs anywhere lies in a run of the item that has it first.
    """
    seeds = rarest_terms(index, ph, width).withColumns({"d": F.col("j2") - F.col("j1"), "base": F.col("start") + F.col("j1")})
    seeds = written(seeds.groupBy("t1", "t2", "d", *ITEM, "base", "need").agg(
        F.min("start").alias("low"), F.max(F.col("start") + F.col("need") - 1).alias("high")), "seeds")
    pairs = seeds.select("t1", "t2", "d").distinct()
    left = index.join(small(pairs), index["term"] == pairs["t1"]).select(
        *KEY, "t1", "t2", "d", (F.col("pos") + F.col("d")).alias("pos"))
    left = written(left.distinct(), "rarest")
    right = in_groups_of(index.join(small(pairs.select(F.col("t2").alias("term")).distinct()), "term", "left_semi"), left)
    right = right.select(*KEY, "pos", F.col("term").alias("t2")).distinct()
    met = left.join(right, [*KEY, "pos", "t2"])
    aligned = met.join(small(seeds), ["t1", "t2", "d"]).select(
        *KEY, *ITEM, "need", (F.col("pos") - F.col("d") - F.col("base")).alias("diag"),
        F.explode(F.sequence("low", "high")).alias("j"))
    needed = aligned.where(F.col("diag") + F.col("j") >= 0).distinct()
    terms = ph.contents.select(*ITEM, F.posexplode("terms").alias("j", "term"))
    needed = written(needed.join(small(terms), [*ITEM, "j"]).withColumn("pos", F.col("diag") + F.col("j")), "aligned")
    wanted = small(needed.select("term").distinct())
    there = in_groups_of(index.join(wanted, "term", "left_semi"), needed).select(*KEY, "pos", "term").distinct()
    agreed = needed.join(there, [*KEY, "pos", "term"])
    # A partition is one item laid over one text at one alignment: no longer than the item.
    order = Window.partitionBy(*KEY, *ITEM, "diag").orderBy("j")
    runs = agreed.withColumn("island", F.col("j") - F.row_number().over(order)).groupBy(*KEY, *ITEM, "diag", "need", "island").agg(
        F.min("j").alias("first"), F.max("j").alias("last"))
    return written(runs.where(F.col("last") - F.col("first") + 1 >= F.col("need")).drop("island"), "runs")


def hit_report(ph: Phrases, runs: DataFrame) -> DataFrame:
    """By text key: n_hit words inside matches, n_items with a matching window, items_sha256."""
    hit = runs.select(*KEY, F.explode(F.sequence(F.col("diag") + F.col("first"), F.col("diag") + F.col("last"))).alias("pos"))
    hit = hit.distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    starts = runs.select(*KEY, *ITEM, F.explode(F.sequence("first", F.col("last") - F.col("need") + 1)).alias("start"))
    seen = starts.join(small(ph.windows.drop("need")), [*ITEM, "start"]).select(*KEY, "w1", "w2").distinct()
    having = ph.windows.select("w1", "w2", *ITEM).distinct().join(small(ph.items), ITEM).select("w1", "w2", "item").distinct()
    named = seen.join(small(having), ["w1", "w2"]).select(*KEY, "item").distinct()
    named = named.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    return hit.join(named, KEY).select(*KEY, "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``width`` consecutive words of an item; an item with fewer words, but some, is one
    window. A document word inside any occurrence of a window is hit. NULL and empty texts have no
    words. Doc ids may be NULL or repeat: each row is answered by its own text. Only doc_id, text,
    item_id and text are read. Without documents there are no rows, without items no hits.
    """
    ph = phrases(items, width)
    report = written(hit_report(ph, phrase_runs(build_index(docs, ph.vocabulary), ph, width)), "hits")
    text = F.col("text").cast("string")
    k1, k2 = key_columns(text)
    # NULL texts match nothing; a number of their own keeps them from gathering in one task.
    rows = docs.select(
        "doc_id", F.coalesce(k1, F.xxhash64("doc_id", F.monotonically_increasing_id())).alias("k1"), k2.alias("k2"),
        word_count(text).alias("n_words"))
    return rows.join(report, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; NULL and empty texts stay."""
    ph = phrases(items, width)
    hit = written(phrase_runs(build_index(docs, ph.vocabulary), ph, width).select(*KEY).distinct(), "hits")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    k1, k2 = key_columns(F.col("row.text").cast("string"))
    return packed.select("row", k1, k2).join(small(hit), KEY, "left_anti").select("row.*")


def proximity_matches(index: DataFrame, ph: Phrases, width: int, slack: int) -> DataFrame:
    """Windows all of whose terms lie within ``slack`` words of an occurrence of their rarest term.

    Returns k1, k2, c1, c2, start, pos (of the rarest term), once each. Order and number of
    occurrences of the terms do not matter. Positions are joined by cells of ``slack`` words.
    """
    windows = rarest_terms(index, ph, width).select(*ITEM, "start", "need", "t1")
    spread = windows.join(ph.contents.select(*ITEM, "terms"), ITEM).select(
        *ITEM, "start", "t1", F.explode(F.array_distinct(F.slice("terms", F.col("start") + 1, F.col("need")))).alias("term"))
    size = spread.groupBy(*ITEM, "start").agg(F.count(F.lit(1)).alias("n_terms"))
    rare = index.join(small(windows.select(F.col("t1").alias("term")).distinct()), "term", "left_semi").distinct()
    at = rare.join(small(spread.withColumnRenamed("term", "other")), rare["term"] == F.col("t1")).select(
        *KEY, F.col("pos").alias("rare_pos"), *ITEM, "start", F.col("other").alias("term"),
        F.explode(F.sequence(F.floor((F.col("pos") - slack) / slack), F.floor((F.col("pos") + slack) / slack))).alias("cell"))
    near = index.join(small(spread.select("term").distinct()), "term", "left_semi").distinct().withColumn(
        "cell", F.floor(F.col("pos") / slack))
    met = at.join(near, [*KEY, "term", "cell"]).where(F.abs(F.col("pos") - F.col("rare_pos")) <= slack)
    full = met.groupBy(*KEY, *ITEM, "start", "rare_pos").agg(F.count_distinct("term").alias("n"))
    return full.join(small(size), [*ITEM, "start"]).where(F.col("n") == F.col("n_terms")).select(
        *KEY, *ITEM, "start", F.col("rare_pos").alias("pos"))
