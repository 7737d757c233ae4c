import random

import pytest

from pyspark.sql import functions as F
from support import frame, grouped, log
from windrow.operators import intervals as iv
from windrow.operators import reports as rp
from windrow.operators.segments import disjoint_segments, sweep

TL = "ordinal long, technique string, start_ns long, end_ns long"


def first_match(t, spans):
    return next((n for _, n, s, e in sorted(spans) if t is not None and s <= t <= e), None)


@pytest.mark.parametrize("bound", [50_000, 0])
def test_first_interval_small_and_large(spark, bound, setting):
    setting("windrow.broadcast_rows", bound)
    rnd = random.Random(3)
    spans = [(i, f"t{i}", s, s + rnd.randint(0, 120)) for i, s in enumerate(rnd.sample(range(-200, 1500), 60))]
    rows = [(i, rnd.randint(-300, 1700) if i % 9 else None) for i in range(500)]
    found = iv.first_interval(
        spark.createDataFrame(rows, "id int, t long"), F.col("t"), spark.createDataFrame(spans, TL))
    assert {r["id"]: r["technique"] for r in found.collect()} == {i: first_match(t, spans) for i, t in rows}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_rows_that_share_an_id_and_equal_intervals(spark, bound, setting):
    setting("windrow.broadcast_rows", bound)
    spans = [(i, f"t{i}", 100, 100_000) for i in range(2000)] + [(2000, "early", 10, 20)]
    rows = spark.createDataFrame([(1, 15), (1, 5_000), (1, 100_001)], "id int, t long")
    found = iv.first_interval(rows, F.col("t"), spark.createDataFrame(spans, TL)).collect()
    assert {r["t"]: r["technique"] for r in found} == {15: "early", 5_000: "t0", 100_001: None}


@pytest.mark.parametrize("chunks,shape", [(1, 300), (5, 300), (9, 3000)])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_segments_are_disjoint_and_name_the_first_interval(spark, chunks, shape, keys):
    rnd = random.Random(chunks)
    spans = [(i, f"t{i}", s, s + rnd.choice([-1, 0, 3, 40, shape]), i % 2) for i, s in enumerate(rnd.choices(range(-200, 1500), k=80))]
    timeline = spark.createDataFrame(spans, TL + ", k int")
    found = disjoint_segments(timeline, keys, chunks).collect()
    for k in (0, 1):
        mine = [s[:4] for s in spans if not keys or s[4] == k]
        cut = sorted((r["start_ns"], r["end_ns"], r["technique"]) for r in found if not keys or r["k"] == k)
        assert all(a[1] < b[0] for a, b in zip(cut, cut[1:])) and len(cut) <= 2 * len(mine) + 1 + 2 * chunks
        for t in range(-250, 5000):
            held = [n for a, b, n in cut if a <= t <= b]
            assert held == ([first_match(t, mine)] if first_match(t, mine) else [])


def test_six_thousand_overlapping_intervals_are_few_segments(spark):
    spans = [(i, i * 7 % 500, i * 7 % 500 + 10_000) for i in range(6000)]
    cut = sweep(spans)
    assert len(cut) <= 2 * len(spans) + 1 and all(a[2] < b[1] for a, b in zip(cut, cut[1:]))
    rows = spark.createDataFrame([(t,) for t in range(0, 10_600, 13)], "t long")
    timeline = spark.createDataFrame([(o, f"t{o}", a, b) for o, a, b in spans], TL)
    got = {r["t"]: r["technique"] for r in iv.first_interval(rows, F.col("t"), timeline).collect()}
    by_ordinal = [(o, f"t{o}", a, b) for o, a, b in spans]
    assert got == {t: first_match(t, by_ordinal) for t in got}


def test_capture_zone(spark):
    hour = 3_600_000_000_000
    spans = spark.createDataFrame([(0, "a", 10 * hour, 11 * hour)], TL)
    rows = spark.createDataFrame([(0, 7, "1970-01-01 12:30:00")], "event_id long, cgroup_id long, w string")
    rows = rows.withColumn("timestamp_human", F.col("w").cast("timestamp_ntz"))
    assert iv.label_events(rows, 7, spans, capture_zone="+02:00").first()["technique"] == "a"
    assert iv.label_events(rows, 7, spans).first()["technique"] == "unattributed"


def test_bounds_belong_to_the_interval(spark):
    spans = spark.createDataFrame([(0, "a", 10, 20), (1, "b", 21, 30)], TL)
    rows = spark.createDataFrame([(i,) for i in (9, 10, 20, 21, 30, 31)], "t long")
    found = iv.first_interval(rows, F.col("t"), spans).collect()
    assert {r["t"]: r["technique"] for r in found} == {9: None, 10: "a", 20: "a", 21: "b", 30: "b", 31: None}


@pytest.mark.parametrize("chunks", [1, 3])
def test_touching_intervals_overlap(spark, chunks):
    good = [(0, "a", 0, 9), (1, "b", 10, 19), (2, "c", 30, 40), (3, "d", 50, 60)]
    iv.require_disjoint(spark.createDataFrame(good, TL), chunks=chunks)
    for bad in ((4, "e", 19, 25), (4, "e", 35, 36), (4, "e", 45, 50)):
        with pytest.raises(ValueError):
            iv.require_disjoint(spark.createDataFrame(good + [bad], TL), chunks=chunks)


def test_label_events(spark):
    second = 1_000_000_000
    spans = spark.createDataFrame([(0, "a", 10 * second, 20 * second)], TL)
    rows = [(0, 7, "1970-01-01 00:00:10"), (1, 7, "1970-01-01 00:00:20.000001"), (2, 7, None), (3, 8, "1970-01-01 00:00:15"), (4, None, "1970-01-01 00:00:15")]
    df = spark.createDataFrame(rows, "event_id long, cgroup_id long, w string").withColumn("timestamp_human", F.col("w").cast("timestamp_ntz"))
    got = {r["event_id"]: (r["label"], r["technique"]) for r in iv.label_events(df, 7, spans).collect()}
    assert got == {0: (1, "a"), 1: (1, "unattributed"), 2: (1, "unattributed"), 3: (0, ""), 4: (0, "")}
    without = iv.label_events(df, 7, spans.where("false")).collect()
    assert {r["technique"] for r in without} == {""}


@pytest.mark.parametrize("chunks", [1, 5])
def test_bursts_and_latency(spark, chunks):
    rows, gap = log(200, seed=11, step=20), 25
    got = iv.attack_bursts(frame(spark, rows), gap, chunks=chunks)
    want = {}
    for (session,), events in grouped(rows, False).items():
        last = None
        for e in (e for e in events if e[8] == 1):
            if last is None or e[1] - last > gap:
                want[e[0]] = (session, e[1], e[9])
            last = e[1]
    assert {r["event_id"]: (r["session_id"], r["onset_ts"], r["technique"]) for r in got.collect()} == want
    closes = [(s, t + d, 1) for s, t, _ in list(want.values())[:20] for d in (-5, 7)] + [(1, 0, 0)]
    scored = spark.createDataFrame(closes, "session_id int, close_ts long, pred int")
    lat = {r["event_id"]: r["latency_ms"] for r in iv.detection_latency(got, scored, chunks=chunks).collect()}
    for event, (session, t, _) in want.items():
        after = [c for s, c, p in closes if s == session and p and c >= t]
        assert lat[event] == ((min(after) - t) / 1e6 if after else None)


@pytest.mark.parametrize("chunks", [1, 4])
def test_latency_numbers(spark, chunks):
    import numpy as np

    values = [3.0, 1.5, None, 9.0, 4.25, None, 2.0]
    rows = [(i, "a" if i % 2 else "", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, technique string, latency_ms double")
    s = rp.latency_stats(df, chunks=chunks).first()
    seen = [v for v in values if v is not None]
    assert (s["n_bursts"], s["detected"], s["missed"], s["max_ms"]) == (7, 5, 2, 9.0)
    assert s["median_ms"] == pytest.approx(np.median(seen)) and s["p90_ms"] == pytest.approx(np.percentile(seen, 90))
    by = {r["technique"]: (r["n"], r["median_ms"]) for r in rp.latency_by_technique(df, chunks=chunks).collect()}
    assert by == {"a": (2, 5.25), "unattributed": (3, 3.0)}
    none = rp.latency_stats(df.where("latency_ms IS NULL"), chunks=chunks).first()
    assert (none["detected"], none["median_ms"]) == (0, None)
