"""Language, quality and pseudo-likelihood: plain versions, held-out accuracy, odd rows."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windrow.llm import language, pseudo_likelihood as pl, quality, topk
from windrow.llm.queries import held_out, learnable
from windrow.llm.tokens import encoder, text_column

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ñez", "ción", "os", "la"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, lang, rnd.randint(1, 80)), lang) for i in range(240) for lang in [rnd.choice("aa bb cc".split())]]
    mixed = f"{prose(rnd, 'aa', 60)}. {prose(rnd, 'bb', 40)}"
    odd = [(900, mixed, None), (901, None, "aa"), (902, "", "bb"), (903, "123 !?", "cc"), (904, "é", None), (None, prose(rnd, "aa", 9), "zz"), (5, "dup", "aa"), (905, "漢字", None)]
    rows += odd
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("row", "score", "in0")})


def test_language_on_held_out_documents(documents):
    rows, docs = documents
    model = language.fit(docs, learnable("doc_id"))
    assert model.languages == ["aa", "bb", "cc"]
    found = language.identify(docs.select("doc_id", "text", "row", "score"), model)
    got = found.select("row.doc_id", "row.text", "lang_pred", "score", "languages", "shares").withColumn("held", held_out("doc_id")).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, t, lang in rows if i is not None and i < 240}
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    for i in (901, 902, 903):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["languages"]) == ("und", 0.0, [])
    assert by[900]["languages"] == ["aa", "bb"] and abs(by[900]["shares"][0] - 0.6) < 0.05
    assert by[904]["lang_pred"] in truth.values() and by[905]["lang_pred"] in truth.values()
    kept = language.keep_identified(docs, model, 0.4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {901, 902, 903}


def test_two_languages_equal_a_plain_loop():
    rnd = np.random.default_rng(0)
    model = language.Model(["a", "b"], np.log(rnd.dirichlet(np.ones(language.GRAMS), 2).T + 1e-12).astype(np.float32))
    texts = text_column(pa.array(["some words here to read", "more", "and even more of those words to read here"]))
    grams, first, of = language.word_grams(texts)
    ends = [*first[1:], len(grams)]
    shares, _ = model.infer(texts)
    for d in range(3):
        like = [[sum(float(model.log_probability[g, i]) for g in grams[a:b]) for i in range(2)] for a, b, o in zip(first, ends, of) if o == d]
        best = max(range(2), key=lambda i: sum(w[i] for w in like))
        share = 0.5
        for _ in range(language.ROUNDS):
            post = [share / (share + (1 - share) * math.exp(max(-60, min(60, w[1 - best] - w[best])))) for w in like]
            share = sum(post) / len(post)
        gain = sum(math.log(share + (1 - share) * math.exp(max(-60, min(60, w[1 - best] - w[best])))) for w in like)
        want = share if gain > language.PENALTY * math.log(len(like) + 1) else 1.0
        assert shares[d, best] == pytest.approx(want, abs=1e-4)


def words_of(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(3)) for _ in range(n))


def learned(samples):
    """A model of the languages with these sample texts."""
    table = np.stack([np.bincount(language.word_grams(text_column(pa.array([t])))[0], minlength=language.GRAMS) for t in samples.values()], axis=1) + 0.5
    return language.Model(list(samples), np.log(table / table.sum(axis=0)).astype(np.float32))


def test_a_language_like_the_main_one_does_not_hide_a_third():
    rnd = random.Random(3)
    main, third = ["ka", "lo", "mi", "tu", "re", "so"], ["ka", "lo", "mi", "zu", "pe", "xo"]
    model = learned({"a": words_of(rnd, main, 4000), "b": words_of(rnd, main * 9 + ["zu"], 4000), "c": words_of(rnd, third, 4000)})
    texts = [words_of(rnd, main, 85) + " " + words_of(rnd, third, 15) for _ in range(20)]
    shares, _ = model.infer(text_column(pa.array(texts)))
    assert all(x[2] == pytest.approx(0.15, abs=0.07) and (x > 0).sum() == 2 for x in shares)


def plain_sets(model, text):
    """The best penalised likelihood of any set of languages, and of the shares that infer gives."""
    grams, first, _ = language.word_grams(text_column(pa.array([text])))
    like = np.exp(np.add.reduceat(model.log_probability[grams], first, axis=0).astype(float))
    cost = language.PENALTY * math.log(len(like) + 1)

    def value(share):
        return np.log(like @ share).sum() - (np.count_nonzero(share) - 1) * cost

    best = -np.inf
    for size in range(1, like.shape[1] + 1):
        for chosen in itertools.combinations(range(like.shape[1]), size):
            share = np.zeros(like.shape[1])
            share[list(chosen)] = 1 / size
            for _ in range(language.ROUNDS):
                part = like * share
                share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
            best = max(best, value(share))
    return best, value(model.infer(text_column(pa.array([text])))[0][0])


def test_chosen_sets_are_the_best_of_all_sets():
    rnd = random.Random(9)
    pool = ["ka", "lo", "mi", "tu", "re", "so", "zu", "pe", "xo"]
    parts = {x: rnd.sample(pool, 4) for x in "abcd"}
    model = learned({x: words_of(rnd, y, 3000) for x, y in parts.items()})
    for _ in range(60):
        text = " ".join(words_of(rnd, parts[x], rnd.randint(1, 60)) for x in rnd.sample("abcd", rnd.randint(1, 3)))
        best, got = plain_sets(model, text)
        assert got == pytest.approx(best, abs=0.05)


def test_five_languages_in_one_text():
    rnd = random.Random(5)
    parts = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(5)] for x in "abcdef"}
    model = learned({x: words_of(rnd, y, 3000) for x, y in parts.items()})
    shares, _ = model.infer(text_column(pa.array([" ".join(words_of(rnd, parts[x], n) for x, n in zip("abcde", (60, 50, 40, 30, 20)))])))
    assert shares[0] == pytest.approx([0.3, 0.25, 0.2, 0.15, 0.1, 0], abs=0.03)


def test_more_languages_than_a_block(spark):
    rnd = random.Random(2)
    count = language.BLOCK + 44
    own = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(4)] for _ in range(count)]
    rows = [(1, words_of(rnd, own[i], 40), f"l{i:03}") for i in range(count)]
    rows.append((1, " ".join(words_of(rnd, own[i], 40) for i in (3, 299, 150, 77)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs, F.lit(True))
    assert model.languages == [f"l{i:03}" for i in range(count)]
    got = language.identify(docs, model).select("row.lang", "lang_pred", "languages").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"])
    assert [sorted(r["languages"]) for r in got if not r["lang"]] == [["l003", "l077", "l150", "l299"]]


def test_texts_of_languages_never_learned_go(documents, spark):
    _, docs = documents
    rnd = random.Random(7)
    model = language.fit(docs, learnable("doc_id"))
    other = ["".join(rnd.choice("bcdfghjqwxyz") for _ in range(3)) for _ in range(40)]
    rows = [(i, prose(rnd, lang, n)) for i, (lang, n) in enumerate((x, n) for x in SYLLABLES for n in (1, 2, 5, 20, 200))]
    rows += [(100, f"{prose(rnd, 'aa', 60)} {prose(rnd, 'cc', 60)}"), (101, "漢字漢語文章你好世界" * 9), (102, "это русский текст и он длинный " * 4), (103, words_of(rnd, other, 60))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in language.keep_identified(texts, model, 0.4, corpus_pipeline.LEAST_SUPPORT).collect()}
    assert kept == {r[0] for r in rows} - {101, 102, 103}


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, learnable("doc_id"))
    assert language.identify(docs, model).select("lang_pred", "score").first() == ("und", 0.0)
    assert language.identify(docs.limit(0), model).count() == 0


def plain_features(text):
    found = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return len(found) + max(0, len(found) - 1)


def quality_rows():
    rnd = random.Random(6)
    good = ["the", "and", "river", "stone", "walks", "slowly", "home"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(rnd.choice(good) + ("%%%" if bad else "") for _ in range(rnd.randint(3, 60)))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows + [(900, None), (901, ""), (None, "the river"), (7, rows[7][1])], labels + [(None, 1), (4, None), (6, 0), (6, 1)]


def test_features_are_words_marks_and_pairs():
    texts = ["the river, stone!", "", "a%%% b", None]
    codes = quality.features(text_column(pa.array(texts)))
    assert np.bincount(codes // quality.FEATURES, minlength=4).tolist() == [plain_features(t) for t in texts]


def test_quality_separates_and_keeps_clean_rows(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("key", "good", "row", "labelled_id")})
    tags = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("x"))
    got = quality.resample(docs, tags).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 2]
    assert all(r["kept"] for r in unseen if r["doc_id"] % 5) and not any(r["kept"] for r in unseen if r["doc_id"] % 5 == 0)
    assert all(r["log_weight"] == 0 and r["kept"] for r in got if r["doc_id"] in (900, 901))
    full = quality.resample(docs, tags, full_rows=True)
    assert full.columns == docs.columns
    assert sorted(map(repr, [r["doc_id"] for r in full.collect()])) == sorted(repr(r["doc_id"]) for r in got if r["kept"])
    asked = quality.resample(docs, tags, k=50).collect()
    cut = sorted((r["key"] for r in asked), reverse=True)[49]
    assert sum(r["kept"] for r in asked) in (50, 51) and all(r["kept"] == (r["key"] >= cut) for r in asked)


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] for r in quality.resample(docs, none).collect())
    assert quality.resample(docs.limit(0), none).collect() == []


def test_log_weight_is_the_ratio_without_the_text_itself():
    texts = text_column(pa.array(["x y", "x z", "y y y"]))
    codes = quality.features(texts)
    raw = np.bincount(codes % quality.FEATURES, minlength=quality.FEATURES).astype(float)
    target = np.bincount(codes[codes // quality.FEATURES == 1] % quality.FEATURES, minlength=quality.FEATURES).astype(float)
    got = quality.Model(target, raw).log_weights(texts, np.array([0.0, 1.0, 0.0]))
    prior = target.sum() / raw.sum()
    for i in range(3):
        f = codes[codes // quality.FEATURES == i] % quality.FEATURES
        own = np.bincount(f, minlength=quality.FEATURES)
        t, r = target - own * (i == 1), raw - own
        want = sum(
            math.log((t[x] + prior) / (t.sum() + prior * quality.FEATURES)) - math.log((r[x] + 1) / (r.sum() + quality.FEATURES)) for x in f)
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("k", [0, 1, 7, 40, 99, 100, 200])
def test_top_k_by_counting(spark, k):
    rnd = random.Random(k)
    rows = [(rnd.choice([-5, 0, 1 << 40, -(1 << 62), rnd.randint(-9, 9)]), rnd.randint(-(1 << 62), 1 << 62)) for _ in range(100)]
    df = spark.createDataFrame(rows, "a long, b long")
    if k:
        kept = df.where(topk.at_least(["a", "b"], topk.k_th(df, ["a", "b"], k))).collect()
        assert sorted(map(tuple, kept)) == sorted(sorted(rows, reverse=True)[:k])


def small_network():
    v = pl.vocabulary(np.array([50, 3, 9, 1, 0, 7] + [1] * 200))
    return pl.initial_weights(3), v


def test_pseudo_likelihood_equals_a_plain_loop():
    w, v = small_network()
    ids, counts = np.array([0, 2, 5, 1, 0, 0, 3, 205]), np.array([3, 0, 1, 4])
    got = pl.log_probabilities(w, v, ids, counts)
    docs = np.split(ids, np.cumsum(counts)[:-1])
    want = []
    for doc in docs:
        for i in range(len(doc)):
            h = w["bias"].astype(float).copy()
            for slot, d in enumerate((-2, -1, 1, 2)):
                j = i + d
                h += w["embed"][slot][v.row[doc[j]] if 0 <= j < len(doc) else pl.INPUTS]
            logits = np.tanh(h) @ w["out"] + w["out_bias"]
            want.append(logits[v.cls[doc[i]]] - np.log(np.exp(logits).sum()) + v.log_share[doc[i]])
    assert got == pytest.approx(want, abs=1e-4)
    # All tokens of the vocabulary together have probability 1 in any place.
    total = np.exp([pl.log_probabilities(w, v, np.array([0, x, 2]), np.array([3]))[1] for x in range(len(v.cls))]).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_contexts_of_some_places():
    rnd = np.random.default_rng(2)
    counts = np.array([0, 1, 1, 0, 2, 1, 3, 0, 0, 5, 1, 2, 0])
    rows = rnd.integers(0, 90, counts.sum()).astype(np.int32)
    places = rnd.permutation(len(rows))[:9]
    ends, text = np.cumsum(counts), np.repeat(np.arange(len(counts)), counts)
    want = [
        [rows[p + d] if 0 <= p + d < len(rows) and text[p + d] == text[p] else pl.INPUTS for p in range(len(rows))]
        for d in (-2, -1, 1, 2)]
    assert ends[-1] == len(rows) and (pl.contexts(rows, counts) == np.array(want)).all()
    assert (pl.contexts(rows, counts, places) == np.array(want)[:, places]).all()
    assert pl.contexts(rows[:0], counts[:1]).shape == (4, 0)


def test_scores_are_cut_only_where_they_can_be_high():
    w, v = small_network()
    ids, counts = np.array([0, 2, 5, 1]), np.array([4])
    assert not pl._layer(w)[1]
    w["out"] *= 5000
    assert pl._layer(w)[1]
    with np.errstate(over="raise", invalid="raise"):
        assert np.isfinite(pl.log_probabilities(w, v, ids, counts)).all()
    # A hidden value at either end is 1 or -1, whatever the sum.
    w["embed"][0, pl.INPUTS] = np.where(np.arange(pl.HIDDEN) % 2, 1e4, -1e4)
    h = pl._hidden(w, pl.contexts(v.row[ids], counts)[:, :1])
    assert (h[0, :-1] == np.where(np.arange(pl.HIDDEN) % 2, 1, -1)).all() and h[0, -1] == 1


def test_gradients_match_differences():
    w, v = small_network()
    around, cls = pl.contexts(v.row[np.array([0, 1, 2, 5, 5, 1])], np.array([4, 2])), v.cls[np.array([0, 1, 2, 5, 5, 1])]
    g, _ = pl.gradients(w, around, cls)
    for name, at in (("out", (3, 5)), ("bias", (2,)), ("out_bias", (1,)), ("embed", (0, pl.INPUTS, 4)), ("embed", (2, int(v.row[2]), 1))):
        up, down = ({k: x.astype(np.float64) for k, x in w.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        want = (pl.gradients(up, around, cls)[1] - pl.gradients(down, around, cls)[1]) / 2e-4
        assert g[name][at] == pytest.approx(want, abs=1e-4)


def test_every_position_is_a_training_target():
    rnd = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 6, 0] + [40] * 400)
    ids = rnd.integers(0, 200, counts.sum())
    part = pl.parts_of(ids, counts, pl.MASK)
    rounds = part * pl.ROUNDS // pl.MASK
    assert part.min() == 0 and part.max() == pl.MASK - 1 and set(rounds) == set(range(pl.ROUNDS))
    by_place = rounds[9:].reshape(400, 40)
    assert all((by_place == r).mean(axis=0).min() > 0.2 for r in range(pl.ROUNDS))
    assert (part[9:49] == pl.parts_of(ids[9:49], counts[5:6], pl.MASK)).all()


def test_training_counts_every_position(spark):
    texts = [np.arange(n) % 7 for n in (1, 2, 3, 6, 40, 400)]
    v, used = pl.vocabulary(np.bincount(np.concatenate(texts), minlength=200)), []
    docs = spark.createDataFrame([(bytearray(t.astype("<u4").tobytes()),) for t in texts], "ids binary").coalesce(1)

    class Seen:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            made = docs.mapInArrow(run, schema).persist()
            used.append(made.agg(F.max("used")).first()[0])
            return made

    pl.train(Seen(), v)
    assert sum(used) == sum(map(len, texts))


def test_ids_take_two_bytes_and_come_with_their_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "the cat sat on a mat"), (2, None), (3, ""), (None, "zq xv kk"), (1, "the cat " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kind = pl.id_kind(path)
    assert kind == "<u2"
    tokens = pl.token_rows(docs, path, kind).persist()
    got, coder = tokens.collect(), encoder(path)
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [np.frombuffer(r["ids"], kind).tolist() for r in got] == want
    assert sum(r["seen"] is not None for r in got) == 1
    counts = np.bincount(np.concatenate([np.array(w, np.int64) for w in want]))
    found = pl.count_ids(tokens)
    assert (found[:len(counts)] == counts).all() and found.sum() == counts.sum()
    # The counts are all that is read: ids aren't there to be counted.
    assert (pl.count_ids(tokens.select("seen")) == found).all()


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_runs_of_rows_from_the_middle_of_a_batch(kind, monkeypatch):
    texts = [np.arange(n) + 60000 for n in (3, 0, 7, 1, 0, 0, 12, 2)]
    batch = pa.record_batch({"doc_id": pa.array(range(8)), "ids": pa.array([t.astype(kind).tobytes() for t in texts], pa.binary())})
    for most in (1, 8, 100):
        monkeypatch.setattr(pl, "TOKENS_AT_ONCE", most)
        for at, n in ((0, 8), (1, 6), (2, 3), (4, 2), (4, 0)):
            parts = list(pl._texts([batch.slice(at, n)], kind))
            assert [i for rows, _, _ in parts for i in rows.column(0).to_pylist()] == list(range(at, at + n))
            assert [c for _, _, counts in parts for c in counts] == [len(t) for t in texts[at:at + n]]
            assert [i for _, ids, _ in parts for i in ids.tolist()] == [i for t in texts[at:at + n] for i in t.tolist()]
            assert all(len(ids) == counts.sum() and (len(ids) <= most or len(counts) == 1) for _, ids, counts in parts)


def test_training_lowers_the_loss_and_odd_rows_have_scores(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["the cat sat", "on a mat", "and slept well"]) for _ in range(40))) for i in range(60)]
    rows += [(100, "zq xv kk pw " * 20), (101, None), (102, ""), (None, "the cat sat on a mat"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = pl.score_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), rounds=3).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (101, 102):
        assert (by[i]["n_tokens"], by[i]["log_likelihood"], by[i]["per_token"]) == (0, 0.0, None)
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 3}) == 1
    normal = [r["per_token"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60]
    assert by[100]["per_token"] < min(normal)
    untrained = pl.score_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), rounds=0).collect()
    assert np.mean(normal) > np.mean([r["per_token"] for r in untrained if r["doc_id"] is not None and r["doc_id"] < 60]) + 0.1
    assert pl.score_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
