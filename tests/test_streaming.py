import os

import pytest

from pyspark.sql import functions as F
from support import SCHEMA, VOCAB, count_bag, frame, grouped, log
from windrow.operators import windows as wn
from windrow.operators.cooldown import fired_alerts
from windrow.streaming import ingest, scoring


def in_files(spark, rows, folder, parts):
    """Write the log as ``parts`` files in time order, each with its own age."""
    ordered = sorted(rows, key=lambda r: (r[1], r[3], r[0]))
    src = os.path.join(folder, "in")
    os.makedirs(src)
    size = -(-len(ordered) // parts)
    for i in range(parts):
        part = frame(spark, ordered[i * size:(i + 1) * size]).coalesce(1)
        tmp = os.path.join(folder, f"part{i}")
        part.write.parquet(tmp)
        name = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        target = os.path.join(src, f"{i:03d}.parquet")
        with open(os.path.join(tmp, name), "rb") as a, open(target, "wb") as b:
            b.write(a.read())
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return src


def stream_of(spark, src):
    schema = spark.read.parquet(src).schema
    return ingest.stream_events(spark, src, schema, files_per_batch=1)


def test_process_windows_over_batches(spark, folder):
    rows = log(160, seed=21, pids=4)
    live = stream_of(spark, in_files(spark, rows, folder, 5))
    keys = ["session_id", "pid"]
    windows = scoring.process_windows(live, VOCAB, keys=keys, window=12, risky=["b"])
    q = windows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    bagged = scoring.token_bags(spark.read.schema(windows.schema).parquet(f"{folder}/out"), VOCAB, 2)
    got = {(r["session_id"], r["pid"], r["end_seq"]): r["bag"] for r in bagged.collect()}
    want = {}
    for key, events in grouped(rows, True).items():
        for i, e in enumerate(events):
            if i >= 11 or (e[6] == "b" and i >= 2):
                want[key + (i,)] = count_bag([x[6] for x in events[max(0, i - 11):i + 1]])
    assert got == want


@pytest.mark.parametrize("parts,chunks,w,s", [(1, None, 20, 10), (5, 1, 15, 4), (4, 3, 15, 4), (4, 1, 3, 8)])
def test_stream_windows_over_batches(spark, folder, parts, chunks, w, s):
    rows = log(110, seed=parts + w)
    live = stream_of(spark, in_files(spark, rows, folder, parts))

    def then(windows, batch_id):
        windows.write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")

    fold = scoring.StreamWindows(VOCAB, then, state=f"{folder}/state", window=w, stride=s, ngram=2, chunks=chunks)
    ingest.store_and_score(live, f"{folder}/cp", score=fold).awaitTermination()
    got = {(r["session_id"], r["window_id"]): (r["bag"], r["close_ts"], r["event_id"]) for r in spark.read.parquet(f"{folder}/out/*").collect()}
    want = {}
    for key, events in grouped(rows, False).items():
        k = 0
        for n in range(1, len(events) + 1):
            if n >= w and n % s == 0:
                want[key + (k,)] = (count_bag([x[6] for x in events[n - w:n]]), events[n - 1][1], events[n - 1][0])
                k += 1
    assert got == want


def test_a_batch_is_cut_by_its_size(spark, folder, monkeypatch, setting):
    cut, scan = [], scoring.ordered_scan

    def spy(*args, **named):
        cut.append(named["chunks"])
        return scan(*args, **named)

    monkeypatch.setattr(scoring, "ordered_scan", spy)
    setting("spark.sql.shuffle.partitions", 500)
    fold = scoring.StreamWindows(VOCAB, lambda windows, batch_id: None, state=f"{folder}/state", window=20, stride=10)
    fold(frame(spark, log(50, seed=1)), 0)
    assert cut == [4 * spark.sparkContext.defaultParallelism]


def share(windows):
    n = F.coalesce(F.try_element_at("bag", F.lit(1)), F.lit(0))
    return windows.withColumn("probability", n / F.lit(10.0))


def test_stream_alerts_equal_the_replay(spark, folder):
    rows = log(300, seed=4)
    live = stream_of(spark, in_files(spark, rows, folder, 4))
    writer = scoring.AlertWriter(
        share, out=f"{folder}/alerts", state=f"{folder}/fired", cooldown_ns=60, keys=["session_id"], threshold=0.1, clock="close_ts")
    fold = scoring.StreamWindows(VOCAB, writer, state=f"{folder}/state", window=10, stride=5, chunks=2)
    ingest.store_and_score(live, f"{folder}/cp", score=fold).awaitTermination()
    cols = ["session_id", "window_id", "close_ts", "event_id", "comm", "uid", "pid"]
    got = spark.read.parquet(f"{folder}/alerts/*").select(*cols).collect()
    batch = scoring.replay(frame(spark, rows), VOCAB, share, keys=["session_id"], window=10, stride=5, ngram=1, cooldown_ns=60, threshold=0.1)
    assert sorted(got) == sorted(batch.select(*cols).collect()) and len(got) > 5


def test_noise_takes_no_slot_and_both_outputs(spark, folder):
    rows = log(60, seed=2, sessions=1)
    live = scoring.live_events(stream_of(spark, in_files(spark, rows, folder, 3)), ["app1"])
    seen = []
    ingest.store_and_score(live, f"{folder}/cp", store=f"{folder}/store", score=lambda b, i: seen.append(b.count())).awaitTermination()
    kept = [r for r in rows if r[5] != "app1"]
    assert sum(seen) == len(kept) == spark.read.parquet(f"{folder}/store").count()


def test_running_counters(spark, folder):
    rows = log(80, seed=6)
    q = ingest.running_counters(stream_of(spark, in_files(spark, rows, folder, 4))).writeStream.outputMode("complete").format(
        "memory").queryName("counters").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["session_id"]: (r["n_events"], r["unique_pids"], r["unique_uids"]) for r in spark.table("counters").collect()}
    want = {}
    for s in (1, 2):
        mine = [r for r in rows if r[7] == s]
        want[s] = (len(mine), len({r[2] for r in mine}), len({r[4] for r in mine}))
    assert got == want


def test_store_events(spark, folder):
    rows = log(50, seed=7)
    ingest.store_events(stream_of(spark, in_files(spark, rows, folder, 2)), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 50


def test_top_feature_names(spark):
    df = spark.createDataFrame([(1, 0, {1: 0.9, 0: 0.4})], "session_id int, window_id long, weights map<int,double>")
    row = scoring.name_top_features(df, VOCAB, 1, ["session_id"]).first()
    assert row["top_features"] == ["b=0.90", "a=0.40"]


def test_a_backlog_becomes_several_batches(spark, folder):
    src = in_files(spark, log(200, seed=3), folder, 6)
    size = max(os.path.getsize(f"{src}/{f}") for f in os.listdir(src))
    live = ingest.stream_events(spark, src, spark.read.parquet(src).schema, bytes_per_batch=2 * size + 1)
    seen = []
    ingest.store_and_score(live, f"{folder}/cp", score=lambda b, i: seen.append(b.count())).awaitTermination()
    assert sum(seen) == 200 and len(seen) == 3


def test_exact_counters_over_batches(spark, folder):
    rows = [(i, i, (i * 7919) % 100_003 if i % 5 else None, i, i % 3, "c", "a", 1 + i % 2, 0, "") for i in range(400)]
    live = stream_of(spark, in_files(spark, rows, folder, 4))
    counters = ingest.ExactCounters(f"{folder}/counts", f"{folder}/state")
    ingest.store_and_score(live, f"{folder}/cp", score=counters).awaitTermination()
    got = {r["session_id"]: (r["n_events"], r["unique_pids"], r["unique_uids"]) for r in spark.read.parquet(f"{folder}/counts/3").collect()}
    for s in (1, 2):
        mine = [r for r in rows if r[7] == s]
        assert got[s] == (len(mine), len({r[2] for r in mine if r[2] is not None}), len({r[4] for r in mine}))
    # One row per session, kind and range of ids; events and missing ids have a row each.
    assert spark.read.parquet(f"{folder}/state/3").count() <= 2 * (1 + 4 + 1 + 1 + 1)
