import random

import pytest

from support import fold_cooldown
from windrow.operators.cooldown import fired_alerts

SCHEMA = "session_id int, timestamp_ns long, tid long, event_id long, note string"


@pytest.mark.parametrize("chunks", [1, 7])
@pytest.mark.parametrize("spread,cooldown", [(4000, 50), (400, 30), (60, 25), (3000, 5000)])
def test_fold_equals_the_sequential_rule(spark, chunks, spread, cooldown):
    rnd = random.Random(spread + cooldown)
    # Session 1 is busy (one long chain of close anomalies), session 2 sparse.
    rows = [(1 if rnd.random() < 0.8 else 2, rnd.randint(0, spread), rnd.randint(0, 3), i, f"n{i}") for i in range(500)]
    fired = fired_alerts(spark.createDataFrame(rows, SCHEMA), cooldown, keys=["session_id"], chunks=chunks).collect()
    for session in (1, 2):
        mine = [r for r in rows if r[0] == session]
        got = sorted((r["timestamp_ns"], r["event_id"], r["note"]) for r in fired if r["session_id"] == session)
        want = []
        for t in fold_cooldown([r[1] for r in mine], cooldown):
            first = min((r for r in mine if r[1] == t), key=lambda r: (r[2], r[3]))
            want.append((t, first[3], first[4]))
        assert got == want


def test_evenly_spaced_anomalies_never_merge(spark):
    rows = [(1, 3 * i, 0, i, "") for i in range(1000)]
    fired = fired_alerts(spark.createDataFrame(rows, SCHEMA), 10, keys=["session_id"], chunks=16).collect()
    assert sorted(r["timestamp_ns"] for r in fired) == fold_cooldown([r[1] for r in rows], 10)


def test_exactly_the_cooldown_fires(spark):
    rows = [(1, 0, 0, 0, ""), (1, 9, 0, 1, ""), (1, 10, 0, 2, ""), (1, 19, 0, 3, ""), (1, 20, 0, 4, "")]
    fired = fired_alerts(spark.createDataFrame(rows, SCHEMA), 10, keys=["session_id"]).collect()
    assert sorted(r["timestamp_ns"] for r in fired) == [0, 10, 20]


@pytest.mark.parametrize("chunks", [1, 5])
def test_many_keys_are_folded_together(spark, chunks):
    rnd = random.Random(chunks)
    # 3,000 light keys, one heavy key, and rows without a key, which never fire.
    keys = list(range(3000)) * 3 + [-1] * 6000 + [None] * 10
    rows = [(k, rnd.randint(0, 2000), 0, i, "") for i, k in enumerate(keys)]
    plan = fired_alerts(spark.createDataFrame(rows, SCHEMA), 40, keys=["session_id"], chunks=chunks)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    got, times = {}, {}
    for r in plan.collect():
        got.setdefault(r["session_id"], []).append(r["timestamp_ns"])
    for k, t, *_ in rows:
        if k is not None:
            times.setdefault(k, []).append(t)
    assert {k: sorted(v) for k, v in got.items()} == {k: fold_cooldown(v, 40) for k, v in times.items()}
