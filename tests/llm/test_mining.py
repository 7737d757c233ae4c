"""Phrases, spelling variants and repeated passages against plain versions over whole texts."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windrow.llm import collocations, spelling, substring_dedup
from windrow.llm.tokens import slices, text_bytes, text_column
from windrow.llm.words import sliding

DOCS = "doc_id long, text string, lang string"
CLASHING = ["1 AS n", "2 AS word", "3 AS x", "'k' AS k1", "4 AS row", "5 AS spans", "6 AS lang_pred", "7 AS score", "8 AS n_words"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- phrases -------------------------------------------------------------------------

def plain_phrases(rows, least, top, share):
    out = {}
    for lang in {r[2] or "und" for r in rows}:
        grams, n = [Counter(), Counter(), Counter()], 0
        for _, text, of in rows:
            if (of or "und") != lang:
                continue
            for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                for size in (1, 2, 3):
                    grams[size - 1].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
        f = {p: c for g in grams for p, c in g.items()}
        scored = []
        for size in (2, 3):
            for p, a in grams[size - 1].items():
                if a < least:
                    continue
                s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, size))
                if size == 2 and any(p in (t[:2], t[1:]) and c >= least and 100 * c >= share * a for t, c in grams[2].items()):
                    continue
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n, -s)
    return out


def phrase_rows(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 60)):
            words += rnd.choice([["New", "York"], ["new", "york", "city"], ["été", "long"], [f"w{rnd.randint(0, 12)}"], ["a.", "b"], ["the"]])
        rows.append((i, " ".join(words), rnd.choice(["en", "fr", None, "und"])))
    return rows + [(500, None, "en"), (501, "", None), (502, "...", "xx"), (None, "new york city", "en"), rows[3], rows[3]]


@pytest.mark.parametrize("seed,top,first", [(1, 2000, 2), (2, 5, 1), (3, 1, 1)])
def test_phrases_are_those_of_the_plain_count(spark, monkeypatch, seed, top, first):
    monkeypatch.setattr(collocations, "FIRST", first)
    monkeypatch.setattr(collocations, "CUT_BYTES", 300)
    rows = phrase_rows(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", *CLASHING)
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
           for r in collocations.mine_collocations(docs, least=3, top=top, share=50).collect()}
    assert got == plain_phrases(rows, 3, top, 50) and len(got) >= 2


def test_a_goal_falls_until_enough_phrases_survive(spark, monkeypatch):
    """Pairs at the top all lie in triples, so the first goal leaves too few."""
    rounds, monk = [], collocations._count_triples
    monkeypatch.setattr(collocations, "_count_triples", lambda *a: rounds.append(1) or monk(*a))
    monkeypatch.setattr(collocations, "FIRST", 1)
    monkeypatch.setattr(collocations, "DEEPER", 2)
    rnd = random.Random(5)
    rows = [(i, " , ".join(rnd.choice([f"p{k} q{k} r{k}" for k in range(6)] + [f"u{k} v{rnd.randint(0, 3)}" for k in range(8)]) for _ in range(40)), "en")
            for i in range(60)]
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
           for r in collocations.mine_collocations(spark.createDataFrame(rows, DOCS), least=10, top=12).collect()}
    assert got == plain_phrases(rows, 10, 12, 50)
    assert len(rounds) >= 2


def test_colliding_keys_are_replaced(spark, monkeypatch):
    seeds, real = [], collocations._count_words

    def count(texts, seed):
        seeds.append(seed)
        found = real(texts, seed)
        return found if seed else found.withColumn("x", F.lit(1).cast("long"))

    monkeypatch.setattr(collocations, "_count_words", count)
    rows = phrase_rows(9, 30)
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
           for r in collocations.mine_collocations(spark.createDataFrame(rows, DOCS), least=3).collect()}
    assert got == plain_phrases(rows, 3, 2000, 50) and seeds == [0, 1]


# --- spelling ------------------------------------------------------------------------

def plain_words(rows, least_length, noise):
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_length:
                out[w] += 1
    return out


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(words, factor):
    form, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
        out[w] = (form[w], n, len(others), words[form[w]] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "CUT_BYTES", 200)
    rnd = random.Random(seed)
    stems = ["Letter", "aaaaaa", "aaaaaaa", "aaabaaa", "étéétéé", "shallow", "hallowÿ", "banana"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 40)):
            w = rnd.choice(stems[:3] * 6 + stems)
            if rnd.random() < 0.25:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("xz") + w[k + 1:]])
            words.append(w)
        rows.append((i, rnd.choice([" ", "-", "9", "日"]).join(words), "en"))
    rows += [(None, "letter letter"), (7, None), (8, ""), rows[0][:2], rows[0][:2]]
    rows = [(*r, None)[:3] for r in rows]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", *CLASHING)
    counted = plain_words(rows, 6, 7)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 6, noise=7).collect()}
    assert got == dict(counted)
    want = plain_variants({w: n for w, n in counted.items() if n >= 2}, 3)
    found = spelling.spelling_variants(docs, 6, 2, noise=7, factor=3).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want
    assert any(v[0] for v in want.values()) and len({v[1] for v in want.values()}) < len(want)


def test_roots_of_long_chains(spark):
    words = [("a" * 6 + "b" * i, 3 ** (i + 1)) for i in range(9)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(words, "word string, n long"), 3).collect()}
    assert set(got.values()) == {words[-1][0]}


def test_carried_on_checksums():
    texts = ["abc", "", "é" * 40, "x"]
    raw, offsets = text_bytes(text_column(pa.array(texts)))
    start = np.array([zlib.crc32(f"{i}:".encode()) for i in range(4)], np.uint32)
    got = spelling.run_crcs(raw, offsets[:-1], offsets[1:], start)
    assert got.tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]


# --- repeated passages -----------------------------------------------------------------

def plain_kept(rows, window):
    cut = [re.findall("[^ \t-\r]+", r[1] or "") for r in rows]
    rank = [(r[0] is None, r[0] or 0) for r in rows]
    first = {}
    for words, k in zip(cut, rank):
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            first[w] = min(first.get(w, k), k)
    out = []
    for (doc_id, *_), words, k in zip(rows, cut, rank):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < k:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, window):
    rnd = random.Random(seed)
    shared = [[f"s{k}_{i}" for i in range(rnd.randint(window - 2, 3 * window))] for k in range(6)]
    few = [["a", "b"] * window, ["same"] * (3 * window)]
    rows = []
    for i in rnd.sample(range(1000), 120):
        words = []
        for _ in range(rnd.randint(0, 6)):
            part = list(rnd.choice(shared + few))
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = f"edit{rnd.randint(0, 9)}"
            a = rnd.randint(0, 3)
            words += part[a:] + [f"own{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.randint(0, 4))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(words), "en"))
    longest = (2000, " ".join(f"t{i % 700}" for i in range(3000)), "en")
    return rows + [longest, (2001, longest[1], "en"), (None, rows[5][1], None), (None, rows[5][1], None), (rows[7][0], rows[8][1], "fr"),
                   (rows[9][0], rows[9][1], "en"), (3000, None, "en"), (3001, "", "en"), (3002, "é É " * window, "en")]


@pytest.mark.parametrize("seed,window,part", [(1, 6, 2_000_000), (2, 7, 400), (3, 50, 3_000)])
def test_passages_removed_are_those_of_all_windows(spark, monkeypatch, seed, window, part):
    monkeypatch.setattr(substring_dedup, "CUT_BYTES", part)
    rows = passages(seed, window)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", *CLASHING)
    found = substring_dedup.remove_repeats(docs, window)
    assert found.columns == ["row", "kept_text", "n_words", "n_removed"]
    got = sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found.collect()), key=repr)
    assert got == plain_kept(rows, window)
    assert sum(r[2] > 0 for r in got) > 20 and all(r[2] == 0 for r in got if r[0] in (3000, 3001, 3002))


def test_a_slice_of_texts_is_cut_in_little_memory():
    texts = text_column(pa.array([" ".join(f"w{(i * 7 + j) % 5000}" for j in range(400)) for i in range(1200)]))
    tracemalloc.start()
    try:
        for part in slices(texts, substring_dedup.CUT_BYTES):
            substring_dedup._Cut(part, 50, 26)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.mine_collocations(none).collect() == []
    assert spelling.spelling_variants(none).collect() == []
    assert substring_dedup.remove_repeats(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " . ", "en")], DOCS)
    assert collocations.mine_collocations(blank).collect() == []
    assert spelling.spelling_variants(blank).collect() == []
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(blank).orderBy("n_words").collect()] == [(0, 0, ""), (1, 0, ".")]


def test_sliding_extremes():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for width in (1, 2, 5, 8, 25):
        assert sliding(x, width, np.minimum).tolist() == [x[i:i + width].min() for i in range(len(x) - width + 1)]
