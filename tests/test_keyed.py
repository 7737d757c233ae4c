"""Windows released by the watermark against a plain loop over the same arrivals."""

import os
import random

import pytest

from support import VOCAB, frame, log
from test_streaming import stream_of
from windrow.streaming import keyed

KEYS = ["session_id", "pid"]
SECOND = 1_000_000_000


def arrivals(rows, spread, seed):
    """The log in the order of arrival: each event is up to ``spread`` ns later than it happened."""
    rnd = random.Random(seed)
    return [r for _, r in sorted((r[1] + rnd.randint(0, spread), r) for r in rows)]


def in_arrival_files(spark, rows, folder, parts):
    src = os.path.join(folder, "in")
    os.makedirs(src)
    size = -(-len(rows) // parts)
    files = [rows[i * size:(i + 1) * size] for i in range(parts)]
    # Heartbeats far ahead let the watermark pass everything.
    files += [[(-i, rows[0][1] + i * 10**7 * SECOND, -i, 0, 0, "beat", "??", -1, 0, "")] for i in (1, 2)]
    for i, part in enumerate(files):
        frame(spark, part).coalesce(1).write.parquet(f"{folder}/part{i}")
        name = next(f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet"))
        target = os.path.join(src, f"{i:03d}.parquet")
        with open(f"{folder}/part{i}/{name}", "rb") as a, open(target, "wb") as b:
            b.write(a.read())
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return src, files


def plain(files, delay_ms, bucket_ms, window, idle_ms=None, least=3):
    """Windows and late events of the same batches by a plain loop."""
    mark, kept, late = 0, [], []
    for part in files:
        for r in part:
            bucket = r[1] // 1_000_000 // bucket_ms
            (late if (bucket + 1) * bucket_ms <= mark else kept).append(r)
        mark = max([mark, *(r[1] // 1000 // 1000 - delay_ms for r in part)])
    out, by_key = {}, {}
    for r in sorted(kept, key=lambda r: (r[1], r[3], r[0])):
        by_key.setdefault((r[7], r[2]), []).append(r)
    for key, events in by_key.items():
        seen, buffer, expires = 0, [], None
        for r in events:
            end = (r[1] // 1_000_000 // bucket_ms + 1) * bucket_ms
            if expires is not None and expires < end:
                seen, buffer = 0, []
            buffer = [*buffer, r[6]][-window:]
            if seen >= window - 1 or (r[6] == "b" and seen >= least - 1):
                out[r[0]] = (key, seen, tuple(VOCAB.tokens.index(t) if t in VOCAB.tokens else -1 for t in buffer))
            seen += 1
            expires = end + idle_ms if idle_ms is not None else None
    return out, {r[0] for r in late}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def run(spark, files_dir, folder, **how):
    live = stream_of(spark, files_dir)
    windows = keyed.released_windows(live, VOCAB, keys=KEYS, risky=["b"], **how)
    query = keyed.start_released(windows, f"{folder}/out", f"{folder}/late", f"{folder}/cp")
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/out/*").collect()
    late = spark.read.parquet(f"{folder}/late/*").collect()
    return {r["event_id"]: ((r["session_id"], r["pid"]), r["end_seq"], tuple(r["tokens"])) for r in got}, {r["event_id"] for r in late}, query


@pytest.mark.parametrize("spread,delay_ms", [(0, 0), (40 * SECOND, 60_000), (90 * SECOND, 2_000)])
def test_out_of_order_events_give_the_windows_of_the_ordered_log(spark, folder, spread, delay_ms):
    rows = arrivals(log(240, seed=31, pids=4, step=4 * SECOND), spread, 7)
    src, files = in_arrival_files(spark, rows, folder, 4)
    got, late, _ = run(spark, src, folder, window=8, delay_ms=delay_ms, bucket_ms=5_000)
    want, want_late = plain(files, delay_ms, 5_000, 8)
    assert late == want_late and got == want and len(got) > 50
    if spread == 40 * SECOND:
        assert not late
    if spread > 60 * SECOND:
        assert len(late) > 5


def test_an_idle_process_leaves_the_store(spark, folder):
    rows = log(120, seed=5, pids=6, hot_pid=0.2, step=3 * SECOND)
    pause = 3_000 * SECOND
    # After half of the log all processes are silent for a long time.
    middle = sorted(rows, key=lambda r: r[1])[60][1]
    rows = arrivals([(*r[:1], r[1] + (pause if r[1] >= middle else 0), *r[2:]) for r in rows], 0, 1)
    src, files = in_arrival_files(spark, rows, folder, 6)
    got, late, query = run(spark, src, folder, window=5, delay_ms=0, bucket_ms=2_000, idle_ms=600_000)
    want, _ = plain(files, 0, 2_000, 5, idle_ms=600_000)
    assert got == want and not late
    # Only the heartbeat that waited for the last one is left.
    states = spark.read.format("statestore").option("stateVarName", "place").load(f"{folder}/cp")
    assert [tuple(r["key"]) for r in states.collect()] in ([], [(-1, -1)])


def test_a_stopped_stream_goes_on_where_it_was(spark, folder):
    rows = arrivals(log(120, seed=9, pids=3, step=2 * SECOND), 5 * SECOND, 2)
    src, files = in_arrival_files(spark, rows, folder, 4)
    how = dict(window=6, delay_ms=10_000, bucket_ms=1_000)
    first = run(spark, src, folder, **how)
    again = run(spark, src, folder, **how)
    assert first[:2] == again[:2] == plain(files, 10_000, 1_000, 6)
