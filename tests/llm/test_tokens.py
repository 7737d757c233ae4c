"""Encoding, token counts, packing and ids on disk against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from windrow.llm import binary_ids, packing, token_counts
from windrow.llm.tokens import Encoder, text_column, word_hashes

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}
PLAIN = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
ODD = [
    "", " ", "\n", "  a b", "a  b\n\n c", "x\ty   z", "é É́ ́x", "<|endoftext|> hi", "0 1 2 a0b", "a\x1cb c", "a <|endoftext|> b", "x<|startoftext|>y\n<|endoftext|>", "<|ENDOFTEXT|> A", "it's I'LL\n'S", "ß Σς",
    "a b\r\nq", "!!! ?? a!b", "日本語 テキスト", "😀 😀😀 a", " x y", None,
]


def ids_of(file, text):
    return PLAIN[file].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \n\t\rabcAB019'é!ß.\x1c　日", max_size=40), max_size=8))
def test_ids_are_those_of_the_whole_text(file, texts):
    flat, offsets = ENCODERS[file].encode(text_column(pa.array(ODD + texts, pa.string())))
    got = [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [ids_of(file, t) for t in ODD + texts]


def test_words_kept_or_forgotten_give_the_same_ids(monkeypatch):
    monkeypatch.setattr("windrow.llm.tokens.CACHED_WORDS", 20)
    monkeypatch.setattr("windrow.llm.tokens.SLICE_BYTES", 64)
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "of", f"w{rnd.randint(0, 99)}"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    coder = Encoder(public_tokenizers.path(FILES[0]))
    forgotten = []
    forget = coder._forget_rare
    coder._forget_rare = lambda: (forgotten.append(1), forget())
    flat, offsets = coder.encode(text_column(pa.array(texts)))
    assert len(forgotten) > 3
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(FILES[0], t) for t in texts]


@pytest.mark.parametrize("file", FILES)
def test_a_known_word_with_a_mark_behind_it_is_not_learned_again(file):
    coder, learned = Encoder(public_tokenizers.path(file)), []
    learn = coder._learn
    coder._learn = lambda words, plain=False: (learned.extend(words), learn(words, plain))[1]
    coder.encode(text_column(pa.array(["so alpha beta2 it gamma", "alpha beta"])))
    del learned[:]
    texts = ["so alpha, beta2. it's gamma!?", "alpha...\nbeta", "so alpha&&&, beta2"]
    flat, offsets = coder.encode(text_column(pa.array(texts)))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(file, t) for t in texts]
    assert not [w for w in learned if any(x in w for x in ("alpha", "beta2", "gamma", "it"))]


@pytest.mark.parametrize("file", FILES)
def test_marks_behind_words_are_cut_as_the_tokenizer_does(file):
    words = ["a", "Zed", "9", "é", "ß", "_", "'s", "'LL", "<", "=", "\u0338", "Σ", "…", ",", "-", "&&", "\x01", "日", "0", "1"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(words + [" "]) for _ in range(rnd.randint(1, 12))) for _ in range(600)]
    flat, offsets = Encoder(public_tokenizers.path(file)).encode(text_column(pa.array(texts)))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(file, t) for t in texts]


@pytest.mark.parametrize("file", FILES)
def test_a_text_longer_than_a_slice(file, monkeypatch):
    monkeypatch.setattr("windrow.llm.tokens.SLICE_BYTES", 500)
    rnd = random.Random(3)
    texts = [" ".join(f"W{rnd.randint(0, 400)}é" for _ in range(n)) for n in (3, 2000, 0, 7)]
    flat, offsets = Encoder(public_tokenizers.path(file)).encode(text_column(pa.array(texts)))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(file, t) for t in texts]


def test_kept_words_take_little_room():
    coder = Encoder(public_tokenizers.path(FILES[0]))
    text = " ".join(f"w{i}" for i in range(40_000))
    first = coder.encode(text_column(pa.array([text])))[0]
    kept = np.count_nonzero(coder.slot_keys)
    assert kept >= 39_999 and len(coder.slot_keys) <= 4 * kept
    assert coder.encode(text_column(pa.array([text])))[0].tolist() == first.tolist()
    assert np.count_nonzero(coder.slot_keys) == kept == coder.filled


def test_word_hashes_tell_words_apart():
    a, _ = word_hashes(text_column(pa.array(["Ab c", "ab", "c!ab É é", None])))
    assert len(a) == 7 and len(set(a.tolist())) == 4 and a[0] == a[2] == a[4]


def corpus(spark, extra=()):
    rnd = random.Random(2)
    texts = [" ".join(f"word{rnd.randint(0, 300)}" for _ in range(rnd.choice([0, 3, 40, 200]))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "again"), (5, "again"), (700, None), (701, ""), *extra]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return rows, df.selectExpr("*", "1 AS ids", "2 AS length", "3 AS rank", "4 AS part")


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_is_best_fit_decreasing_of_every_id(spark, capacity):
    rows, docs = corpus(spark)
    file = public_tokenizers.path(FILES[1])
    got = packing.pack(docs, file, end_id=2, capacity=capacity, keep_ids=True)
    pieces = got.collect()
    want = sorted(ids_of(FILES[1], t) + [2] for _, t in rows)
    spans = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] <= capacity and zlib.crc32(p["ids"]) == p["ids_crc32"]
        spans.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], tuple(np.frombuffer(p["ids"], "<u4").tolist())))
    once = [tuple(x for _, part in sorted(v) for x in part) for k, v in by_doc.items() if k[0] not in (5, None)]
    assert sorted(once) == sorted(tuple(ids_of(FILES[1], t) + [2]) for d, t in rows if d not in (5, None))
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    lengths = sorted((p["length"] for p in pieces), reverse=True)
    assert sorted(sum(length for _, length in s) for s in spans.values()) == sorted(plain_best_fit(lengths, capacity))
    filled = packing.fill_sequences(got).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in filled) and len(filled) == len(spans)


def plain_best_fit(lengths, capacity):
    used = []
    for length in lengths:
        fits = [i for i, u in enumerate(used) if u + length <= capacity]
        if fits:
            used[max(fits, key=lambda i: used[i])] += length
        else:
            used.append(length)
    return used


@settings(max_examples=80, deadline=None)
@given(lengths=st.lists(st.integers(1, 16), max_size=60))
def test_runs_place_every_piece_like_the_plain_loop(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    used = {}
    placed = {x: 0 for x in counts}
    for length, rank, each, window, offset in packing.best_fit_runs(counts, 16).tolist():
        end = min([r for n, r, *_ in packing.best_fit_runs(counts, 16).tolist() if n == length and r > rank], default=counts[length])
        assert rank == placed[length]
        for i in range(rank, end):
            w = window + (i - rank) // each
            assert used.get(w, 0) == offset + (i - rank) % each * length
            used[w] = used.get(w, 0) + length
        placed[length] = end
    assert placed == counts
    assert sorted(used.values()) == sorted(plain_best_fit(sorted(lengths, reverse=True), 16))


def test_ids_on_disk_come_back_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(binary_ids, "BLOCK_TOKENS", 300)
    rows, docs = corpus(spark, [(9, f"hot {i}") for i in range(60)])
    path = f"{folder}/ids"
    binary_ids.write_ids(docs, path, public_tokenizers.path(FILES[0]), end_id=2)
    got = binary_ids.read_ids(spark, path).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted(
        (repr(d), ids_of(FILES[0], t) + [2]) for d, t in rows)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    total = np.bincount([x for _, t in rows for x in ids_of(FILES[0], t) + [2]])
    assert [total[r["id"]] for r in ranks] == sorted(total[total > 0].tolist(), reverse=True)


def test_rows_without_an_id_are_spread(spark, folder):
    docs = spark.range(4000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "concat('word ', id % 7) AS text").repartition(6)
    path = f"{folder}/nameless"
    binary_ids.write_ids(docs, path, public_tokenizers.path(FILES[0]), end_id=2)
    held = [r["docs"] for r in spark.read.parquet(f"{path}/blocks").groupBy("range").agg({"docs": "sum"}).toDF("range", "docs").collect()]
    assert sum(held) == 4000 and max(held) <= 2 * sum(held) / len(held) and len(held) == 32
    got = binary_ids.read_ids(spark, path).orderBy("start").collect()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order) and order.count(-1) == 1334
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 77]), max_size=40))
def test_coding_round_trip(values):
    control, data = binary_ids.encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert binary_ids.decode_values(control, data, len(values)).tolist() == values


def test_length_curve_answers_every_limit(spark):
    rows, docs = corpus(spark)
    curve = token_counts.length_curve(token_counts.length_histogram(docs, public_tokenizers.path(FILES[0])))
    sizes = [len(ids_of(FILES[0], t)) for _, t in rows]
    for r in curve.collect():
        n = r["n_tokens"]
        assert r["docs"] == sizes.count(n) and r["docs_within"] == sum(s <= n for s in sizes)
        assert r["tokens_within"] == sum(s for s in sizes if s <= n) and r["tokens_over"] == sum(s for s in sizes if s > n)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes) and r["quantile"] == sum(s <= n for s in sizes) / len(sizes)
    for r in token_counts.limits(curve, [0, 1, 50, 10_000]).collect():
        assert r["truncated_tokens"] == sum(min(s, r["context"]) for s in sizes)
        assert r["docs_over"] == sum(s > r["context"] for s in sizes)
    got = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(curve, [0.5, 1.0]).collect()}
    assert got == {0.5: sorted(sizes)[-(-len(sizes) // 2) - 1], 1.0: max(sizes)}


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], "doc_id long, text string")
    file = public_tokenizers.path(FILES[0])
    assert packing.pack(none, file, end_id=2).collect() == []
    assert token_counts.length_curve(token_counts.length_histogram(none, file)).collect() == []
    binary_ids.write_ids(none, f"{folder}/none", file, end_id=2)
    assert binary_ids.read_ids(spark, f"{folder}/none").collect() == []
