import bisect
import random

import pytest

from pyspark.sql import functions as F
from support import frame, grouped, log
from windrow.operators import ordered
from windrow.operators.ordered import CHUNK, cut_into_chunks, last_at_or_before, next_at_or_after, ordered_scan
from windrow.schema import EVENT_ORDER


@pytest.mark.parametrize("chunks", [1, 6])
@pytest.mark.parametrize("keys", [[], ["session_id"], ["session_id", "pid"]])
def test_numbering_lags_and_sums(spark, chunks, keys):
    rows = log(300, seed=chunks)
    out = ordered_scan(
        frame(spark, rows), keys, EVENT_ORDER, seq="seq", total="n", lags={"before": "syscall_name"},
        sums={"attacks": F.col("label")}, totals={"all_attacks": F.col("label")}, chunks=chunks,
    ).collect()
    place = {"session_id": 7, "pid": 2}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        groups.setdefault(tuple(r[place[k]] for k in keys), []).append(r)
    want = {}
    for events in groups.values():
        run = 0
        for i, e in enumerate(events):
            run += e[8]
            want[e[0]] = (i, len(events), events[i - 1][6] if i else None, run, sum(x[8] for x in events))
    assert {r["event_id"]: (r["seq"], r["n"], r["before"], r["attacks"], r["all_attacks"]) for r in out} == want


def test_chunks_advance_with_the_order_and_split_a_hot_time(spark):
    rnd = random.Random(1)
    base = 1_700_000_000_000_000_000
    # Most events share one nanosecond; the next ones differ by less than a double can tell.
    rows = [(i, base if rnd.random() < 0.7 else base + rnd.randint(-3, 3), rnd.randint(0, 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, timestamp_ns long, tid long")
    got = cut_into_chunks(df, EVENT_ORDER, 8).collect()
    got.sort(key=lambda r: (r["timestamp_ns"], r["tid"], r["event_id"]))
    ids = [r[CHUNK] for r in got]
    assert ids == sorted(ids)
    sizes = {c: ids.count(c) for c in set(ids)}
    assert max(sizes.values()) <= 2000 * 0.3


def test_forward_as_of_matches_binary_search(spark):
    rnd = random.Random(2)
    for chunks in (1, 4, 9):
        left = [(i, rnd.choice([1, 2]), rnd.randint(0, 300)) for i in range(150)]
        right = [(rnd.choice([1, 2]), rnd.randint(0, 280)) for _ in range(60)]
        got = next_at_or_after(
            spark.createDataFrame(left, "id int, k int, t long"), spark.createDataFrame(right, "k int, u long"), ["k"], "t", "u", "found", chunks
        ).collect()
        want = {}
        for i, k, t in left:
            times = sorted(u for kk, u in right if kk == k)
            at = bisect.bisect_left(times, t)
            want[i] = times[at] if at < len(times) else None
        assert {r["id"]: r["found"] for r in got} == want


def test_an_empty_input(spark):
    empty = frame(spark, log(5)).where("false")
    assert ordered_scan(empty, ["session_id"], EVENT_ORDER, seq="seq", chunks=4).count() == 0


@pytest.mark.parametrize("chunks", [1, 4])
def test_rows_without_a_time_take_no_part_in_the_order(spark, monkeypatch, chunks):
    cut = []

    def spy(df, *rest):
        cut.append(df.where("_t IS NULL").count())
        return cut_into_chunks(df, *rest)

    monkeypatch.setattr(ordered, "cut_into_chunks", spy)
    left = spark.createDataFrame([(i, i if i % 10 == 0 else None, f"n{i}") for i in range(100)], "id long, t long, note string")
    right = spark.createDataFrame([(5, "a"), (40, "b")], "at long, name string")
    found = last_at_or_before(left, right, [], F.col("t"), "at", "last", chunks)
    assert found.columns == ["id", "t", "note", "last"] and cut == [0]
    got = sorted((r["id"], r["t"], r["note"], r["last"] and tuple(r["last"])) for r in found.collect())
    last = lambda i: None if i % 10 or i < 5 else (5, "a") if i < 40 else (40, "b")
    assert got == [(i, None if i % 10 else i, f"n{i}", last(i)) for i in range(100)]
