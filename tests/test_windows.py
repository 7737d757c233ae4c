import random

import pytest

from pyspark.sql import functions as F
from support import TOKENS, VOCAB, count_bag, frame, grouped, log, plain_windows
from windrow.operators import windows as wn

SHAPES = [(20, 10), (30, 7), (1, 1), (5, 12), (20, 1)]


def engine_windows(df, w, s, keys, chunks=None, **kw):
    n = wn.number_events(df, VOCAB, keys=keys, carry=["label", "technique"], chunks=chunks)
    rows = wn.bag_windows(n, VOCAB, keys=keys, window=w, stride=s, techniques=True, **kw).collect()
    return {
        tuple(r[k] for k in keys) + (r["window_id"],): (r["bag"], r["attack_events"], r["label"], r["close_ts"], r["technique"])
        for r in rows
    }


@pytest.mark.parametrize("w,s", SHAPES)
def test_stream_windows_equal_a_plain_loop(spark, w, s):
    rows = log(230, seed=w * 31 + s)
    got = engine_windows(frame(spark, rows), w, s, ["session_id"], chunks=5, ngram=2, min_attack=2, min_attack_frac=0.2)
    assert got == plain_windows(rows, w, s, min_attack=2, frac=0.2)


@pytest.mark.parametrize("w,s,chunks", [(20, 10, 1), (20, 10, 6), (7, 3, 6), (60, 15, 6)])
def test_process_windows_equal_a_plain_loop(spark, w, s, chunks):
    rows = log(260, seed=w + chunks, pids=5)
    keys = ["session_id", "pid"]
    assert engine_windows(frame(spark, rows), w, s, keys, chunks, ngram=2) == plain_windows(rows, w, s, per_pid=True)


def test_unigrams_only(spark):
    rows = log(120, seed=5)
    assert engine_windows(frame(spark, rows), 12, 4, ["session_id"], 4, ngram=1) == plain_windows(rows, 12, 4, ngram=1)


@pytest.mark.parametrize("n,expected", [(19, 0), (20, 1), (29, 1), (30, 2)])
def test_short_and_exact_groups(spark, n, expected):
    rows = log(n, seed=n, sessions=1)
    assert len(engine_windows(frame(spark, rows), 20, 10, ["session_id"])) == expected


def test_windows_of_unknown_tokens_stay(spark):
    rows = log(40, seed=1, sessions=1, tokens=["??"])
    got = engine_windows(frame(spark, rows), 20, 10, ["session_id"], ngram=2)
    assert len(got) == 3 and all(v[0] == {} for v in got.values())


@pytest.mark.parametrize("w,s", [(30, 7), (20, 10), (9, 4), (4, 9)])
def test_live_phase(spark, w, s):
    rows = log(150, seed=w, sessions=1)
    got = engine_windows(frame(spark, rows), w, s, ["session_id"], 3, ngram=2, phase=wn.live_phase(w, s))
    ends = {}
    for key, events in grouped(rows, False).items():
        k = 0
        for count in range(1, len(events) + 1):
            if count >= w and count % s == 0:
                ends[key + (k,)] = events[count - 1][1]
                k += 1
    assert {k: v[3] for k, v in got.items()} == ends


def test_one_session_for_all_captures(spark):
    rows = log(100, seed=9)
    merged = [r[:7] + (1,) + r[8:] for r in rows]
    n = wn.number_events(frame(spark, rows), VOCAB, keys=[], carry=["label"], chunks=4)
    got = {(1, r["window_id"]): r["bag"] for r in wn.bag_windows(n, VOCAB, keys=[], window=20, stride=10, ngram=2).collect()}
    assert got == {k: v[0] for k, v in plain_windows(merged, 20, 10).items()}


def test_dominant_technique_alone_agrees(spark):
    rows = log(200, seed=3)
    n = wn.number_events(frame(spark, rows), VOCAB, keys=["session_id"], carry=["label", "technique"], chunks=4)
    got = {(r[0], r[1]): r[2] for r in wn.dominant_technique(n, keys=["session_id"], window=15, stride=5).collect()}
    assert got == {k: v[4] for k, v in plain_windows(rows, 15, 5).items()}


def test_close_times_and_members(spark):
    rows = log(90, seed=4)
    n = wn.number_events(frame(spark, rows), VOCAB, keys=["session_id"], chunks=3)
    want = plain_windows(rows, 12, 5)
    at = dict(keys=["session_id"], window=12, stride=5)
    assert {(r[0], r[1]): r[2] for r in wn.close_times(n, **at).collect()} == {k: v[3] for k, v in want.items()}
    members = wn.window_members(n, **at).groupBy("session_id", "window_id").count().collect()
    assert {(r[0], r[1]): r[2] for r in members} == {k: 12 for k in want}


def test_early_windows(spark):
    rows = log(120, seed=8, pids=6, hot_pid=0.1)
    keys = ["session_id", "pid"]
    n = wn.number_events(frame(spark, rows), VOCAB, keys=keys, chunks=3)
    found = wn.early_windows(n, keys=keys, window=10, risky=[1, 2])
    got = {
        (r["session_id"], r["pid"], r["end_seq"]): r["bag"]
        for r in found.withColumn("bag", wn.bag_of(F.col("tokens"), VOCAB, 2)).collect()
    }
    want = {}
    for key, events in grouped(rows, True).items():
        for i, e in enumerate(events[:9]):
            if i >= 2 and e[6] in ("b", "c"):
                want[key + (i,)] = count_bag([x[6] for x in events[:i + 1]])
    assert got == want


def test_top_features_break_ties_by_number(spark):
    df = spark.createDataFrame([(1, 0, {3: 2.0, 1: 2.0, 0: 5.0, 7: 0.0})], "session_id int, window_id long, weights map<int,double>")
    rows = wn.top_features(df, ["session_id"], "weights", 2).collect()
    assert [(r["rank"], r["feature_idx"], r["weight"]) for r in rows] == [(1, 0, 5.0), (2, 1, 2.0)]


def test_pair_numbers_follow_the_dictionary(spark):
    from windrow.vocabulary import SYSCALL_VOCABULARY as V

    assert len(V.pairs()) == 377 and V.n_features(2) == 398 and V.n_features(1) == 21
    pairs = [(i, j) for i in range(21) for j in range(21)]
    df = spark.createDataFrame(pairs, "l int, r int")
    got = {(x["l"], x["r"]): x["f"] for x in df.select("l", "r", V.pair_feature(F.col("l"), F.col("r")).alias("f")).collect()}
    want = {p: 21 + i for i, p in enumerate(V.pairs())}
    assert got == {(i, j): want.get((V.tokens[i], V.tokens[j])) for i, j in pairs}
