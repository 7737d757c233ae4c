"""Near duplicates of texts and vectors, components and the pipeline against brute force."""

import collections
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windrow.llm import embedding_dedup, near_duplicates
from windrow.llm.common import written
from windrow.llm.components import connected_components
from windrow.llm.tokens import text_column

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(120)] + [(500, 501), (7, 7)], "star": [(0, i) for i in range(1, 200)] + [(300, 301)],
        "random": [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)], "none": [],
    }[shape]
    got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union()
    for a, b in edges:
        u.join(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    same = collections.defaultdict(set)
    for v in nodes:
        same[got[v]].add(u.find(v))
    assert all(len(s) == 1 for s in same.values()) and len(same) == len({u.find(v) for v in nodes})


def shingle_set(text):
    w = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def text_classes(rows):
    """Smallest doc_id of every doc_id's class, for unique ids."""
    u, sets, first = Union(), {}, {}
    for i, text in rows:
        if text is not None:
            if text in first:
                u.join(i, first[text])
            else:
                first[text], sets[i] = i, shingle_set(text)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            u.join(a, b)
    return {i: u.find(i) for i, _ in rows}


def family(rnd, n, words=150, edits=9):
    vocab = [f"w{i}" for i in range(500)]
    base = [rnd.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(words)] = rnd.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def near_rows():
    rnd = random.Random(3)
    rows = list(enumerate(family(rnd, 160) + family(rnd, 2, edits=1) + family(rnd, 40, words=40, edits=1)))
    rows += [(1000 + i, " ".join(f"v{rnd.randint(0, 400)}" for _ in range(rnd.randint(1, 60)))) for i in range(80)]
    rows += [(1200 + i, rows[0][1]) for i in range(30)]
    rows += [(2000, None), (2001, None), (2002, ""), (2003, ""), (2004, "!!!"), (2005, "!!!"), (2006, "a b"), (2007, "A, b"), (2008, "long " * 3000)]
    return rows


@pytest.mark.parametrize("cell", [512, 16])
@pytest.mark.parametrize("weighted", [False, True])
def test_near_duplicates_equal_brute_force(spark, near_rows, monkeypatch, cell, weighted):
    monkeypatch.setattr(near_duplicates, "CELL", cell)
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k1", "v", "bucket", "sig")})
    got = near_duplicates.deduplicate(docs.repartition(6), weighted=weighted).collect()
    want = text_classes(near_rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = collections.Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_one_row_of_each_class_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (None, "x y z"), (5, None), (5, None), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r"))
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(repr, [
        (1, "a b c d e f"), (None, "x y z"), (5, None), (5, None), (None, None), (9, "")]))
    assert sum(r["kept"] for r in near_duplicates.deduplicate(docs).collect()) == 6
    assert near_duplicates.deduplicate(docs.limit(0)).collect() == [] and near_duplicates.keep_one(docs.limit(0)).collect() == []


def test_signatures_estimate_probability_jaccard():
    rnd = random.Random(9)
    hits = {False: [], True: []}
    for trial in range(60):
        # Words one apart make single shingles by themselves: use four-word gaps to weigh shingles.
        a = [f"t{trial}s{i}" for i in range(30)]
        text_a = " . ".join(" ".join([s] * 5) for s in a)
        text_b = " . ".join(" ".join([s] * 5) for s in a[:20] + [f"u{trial}s{i}" for i in range(10)])
        texts = text_column(pa.array([text_a, text_b]))
        hashes, offsets = near_duplicates.shingles(texts)
        for weighted in hits:
            s = near_duplicates.signatures(hashes, offsets, weighted)
            hits[weighted].append((s[0] == s[1]).mean())
    sets = [shingle_set(t) for t in (text_a, text_b)]
    jaccard = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert np.mean(hits[False]) == pytest.approx(jaccard, abs=0.02)
    # Weighted: copies of a shingle raise its rate of arrival.
    texts = text_column(pa.array(["p q r s t " * 30 + "only in a one two", "p q r s t " * 30 + "only in b six ten"]))
    s = near_duplicates.signatures(*near_duplicates.shingles(texts), True)
    plain = near_duplicates.signatures(*near_duplicates.shingles(texts), False)
    assert (s[0] == s[1]).mean() > (plain[0] == plain[1]).mean() + 0.3
    assert rnd is not None


def vector_rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 32))
    near = x[:60] + rng.standard_normal((60, 32)) * 0.3
    hub = x[:1] + rng.standard_normal((150, 32)) * 0.42
    a = np.vstack([x, near, hub, x[5:6].repeat(12, 0), x[6:7] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(a)]
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] + [1.0] * 31), (9005, [1.0, 2.0]), (9006, [float("inf")] + [1.0] * 31), (None, [1.0] * 32), (9007, [])]
    return a.astype(float), rows + odd


@pytest.mark.parametrize("block", [1024, 32])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    a, rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("label", "w", "uid", "e")})
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df.repartition(5)).collect()}
    assert len(got) == len(rows)
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    links = close.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(len(a))])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    label = np.arange(len(a))
    while True:
        lower = np.minimum(label, np.where(close, label[None, :], len(a)).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(a))]) >= 0.98
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(a)))
    for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0 and not got[None]["kept"]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    start = docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, sf), "test-stage")
        assert docs.columns == start.columns and docs.subtract(before).count() == 0
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality":
            kept = {i for i, _ in rows}
            good, bad = ([i for i, q in labels.items() if q == want] for want in (1, 0))
            assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) < 0.6 * len(bad)
        if name == "near_duplicates":
            want = text_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(i for i, _ in rows) == sorted(set(want.values()))
        if name == "decontamination":
            items = [WORD.findall((r["text"] or "").translate(LOWER)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            wins = {tuple(w[i:i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
            longest = max(map(len, wins))

            def hit(text):
                w = WORD.findall((text or "").translate(LOWER))
                return any(tuple(w[i:i + n]) in wins for n in range(1, longest + 1) for i in range(len(w) - n + 1))

            assert sorted(i for i, _ in rows) == sorted(r["doc_id"] for r in before.collect() if not hit(r["text"]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.collect()} == {i for i, _ in rows}


def test_pipeline_of_odd_tables(spark, folder):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    odd = [(None, None, None, None, None, None), (1, "", "aa", "s", 0, "r"), (2, "ka lo mi tu ka", "aa", None, None, None), (2, "ka lo mi tu ka", "aa", None, None, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, folder), "odd-stage")
        assert docs.count() == (1 if rows else 0)


def test_links_of_a_block_are_fewer_than_its_rows():
    a, b = (x.ravel() for x in np.triu_indices(200, 1))
    # Two groups of near texts: all their pairs link, two joins fewer than texts are enough.
    linked = (a % 2) == (b % 2)
    a, b = a[linked], b[linked]
    at = near_duplicates._joining(a, b)
    assert len(at) == 198
    root = list(range(200))
    for x, y in zip(a[at].tolist(), b[at].tolist()):
        root = [root[x] if r == root[y] else r for r in root]
    assert len(set(root)) == 2 and len({root[i] for i in range(0, 200, 2)}) == 1
