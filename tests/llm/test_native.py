"""Sharding and decontamination against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from windrow.llm import decontamination as dc
from windrow.llm import sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 700])
def test_positions_are_a_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("k"))
    rows = sharding.shard_rows(df, ["k"], 4, seed=n).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(n))
    assert sorted(r["position"] for r in rows) == list(range(n))
    assert all((r["shard"], r["slot"]) == (r["position"] % 4, r["position"] // 4) for r in rows)


def test_equal_rows_nulls_and_clashing_columns(spark):
    rows = [(None, 1)] * 9000 + [(5, None)] * 3 + [(i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").withColumns({c: F.lit("x") for c in ("_n", "_blk", "shard", "position")})
    out = sharding.shard_rows(df, ["k", "v"], 8)
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, [(r["k"], r["v"]) for r in got])) == sorted(map(repr, rows))
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    again = {(r["k"], r["v"], r["position"]) for r in sharding.shard_rows(df.repartition(7), ["k", "v"], 8).collect()}
    assert again == {(r["k"], r["v"], r["position"]) for r in got}


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_rows(spark.range(0).select(F.col("id").alias("k")), ["k"], 8).collect() == []


def brute(docs, items, width=10):
    cut = []
    for item, text in items:
        w = words(text)
        need = min(width, len(w))
        cut.append(("" if item is None else str(item), {tuple(w[i:i + need]) for i in range(len(w) - need + 1)} if w else set()))
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, windows in cut:
            for win in windows:
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p:p + len(win)]) == win:
                        hit.update(range(p, p + len(win)))
                        named.add(item)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["The", "of", "über", "x1", "Éa", "b"] + [f"w{i}" for i in range(40)]

    def prose(n):
        return " ".join(rnd.choice(vocab) + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))

    items = [(i, prose(rnd.randint(1, 40))) for i in range(12)] + [
        (100, "the the the the the the the the the the the"), (101, ""), (102, None), (103, "rareword"), (None, prose(15)), (7, prose(12))]
    items += [items[0], (104, items[1][1])]
    docs = [(i, prose(rnd.randint(0, 60))) for i in range(40)]
    for i in range(40):
        passage = words(rnd.choice(items)[1])
        at = rnd.randint(0, max(0, len(passage) - 10))
        docs.append((50 + i, f"{prose(5)} {' '.join(passage[at:at + rnd.randint(8, 14)]).upper()} {prose(5)}"))
    docs += [(200, "The " * 300), (201, None), (202, ""), (None, "a rareword"), (203, "!!"), docs[41], docs[41]]
    docs += [(300 + i, docs[41][1]) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k1", "pos", "term", "row")})
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("k1", F.lit(2))
    got = sorted((tuple(r) for r in dc.contamination(frame, tests).collect()), key=repr)
    assert got == brute(docs, items)
    clean = dc.clean_rows(frame, tests)
    assert clean.columns == frame.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in clean.collect()) == sorted(
        repr(d) for d, b in zip(docs, [brute([d], items)[0] for d in docs]) if not b[-1])


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dc.contamination(none, no_items).collect() == []
    assert [tuple(r)[:4] for r in dc.contamination(one, no_items).collect()] == [(1, 3, 0, 0)]


def test_proximity(spark):
    docs = [(0, "alpha x beta y gamma z"), (1, "gamma beta alpha"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "alpha beta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ph = dc.phrases(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), 10)
    found = dc.proximity_matches(dc.build_index(frame, ph.vocabulary), ph, 10, slack=5)
    keyed = frame.select("doc_id", *dc.key_columns(F.col("text"))).join(found, dc.KEY).select("doc_id").distinct()
    assert sorted(r[0] for r in keyed.collect()) == [0, 1]


def test_word_hash_of_the_shards_query(spark):
    row = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()
    assert row[0] == zlib.crc32("é".encode())
