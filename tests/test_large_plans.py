"""Rules of the plans for large inputs: sizes, odd order columns, one evaluation, late alerts."""

import pytest
from pyspark.sql import functions as F

from windrow.operators import cooldown, ordered, sampling
from windrow.operators.metrics import ranking_quality
from windrow.sources import events as src
from windrow.sources import feeds
from windrow.storage import file_bytes, scratch, shared_dir
from windrow.streaming.scoring import AlertWriter


def test_sizes_are_those_of_the_files(spark, folder):
    spark.range(1000).repartition(4).write.parquet(f"{folder}/t")
    import os

    size = sum(os.path.getsize(f"{folder}/t/{f}") for f in os.listdir(f"{folder}/t") if f.endswith(".parquet"))
    df = spark.read.parquet(f"{folder}/t")
    assert file_bytes(df) == file_bytes(df.where("id > 3").groupBy("id").count()) == size
    assert file_bytes(spark.range(3)) is None


def test_only_heavy_keys_are_cut(spark, folder, monkeypatch):
    """A hundred thousand small processes and a busy one: the table of chunks knows the busy one alone."""
    seen = []
    cut = ordered.cut_into_chunks
    monkeypatch.setattr(ordered, "cut_into_chunks", lambda df, *a: seen.append(df.select("pid").distinct().count()) or cut(df, *a))
    df = spark.range(130_000).selectExpr("IF(id % 4 = 0, -1, id) AS pid", "id * 7919 % 130003 AS t", "id")
    out = ordered.ordered_scan(df, ["pid"], ["t", "id"], seq="seq", total="n", lags={"before": "t"}, chunks=8)
    row = out.where("pid = -1").agg(F.max("seq"), F.min("n"), F.count_if(F.col("before") < F.col("t")), F.count_if(F.col("before").isNull())).first()
    assert tuple(row) == (32_499, 32_500, 32_499, 1)
    assert out.where("pid <> -1").agg(F.max("seq"), F.max("n"), F.count("before")).first()[0:3] == (0, 1, 0)
    assert seen == [1]
    assert ordered.ordered_scan(df.where("pid <> -1"), ["pid"], ["t"], seq="seq", chunks=8).agg(F.max("seq")).first()[0] == 0
    assert seen == [1]


def test_a_text_column_with_a_common_prefix_is_split(spark):
    df = spark.range(5000).selectExpr("concat('capture_2026_', lpad(cast(id AS string), 6, '0')) AS name", "id")
    sizes = [r["count"] for r in ordered.cut_into_chunks(df, ["name", "id"], 8).groupBy(ordered.CHUNK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


@pytest.mark.parametrize("chunks", [1, 6])
def test_nan_and_text_in_the_order(spark, chunks):
    rows = [(float(i % 7), f"{'s' * (i % 15)}{i % 3}", i) for i in range(200)] + [(float("nan"), "x", 900), (float("inf"), "y", 901)]
    df = spark.createDataFrame(rows, "v double, name string, id long")
    got = ordered.ordered_scan(df, [], ["v", "name", "id"], seq="seq", chunks=chunks).orderBy("seq").collect()
    want = [r["id"] for r in df.orderBy("v", "name", "id").collect()]
    assert [r["id"] for r in got] == want and [r["seq"] for r in got] == list(range(202))
    by_text = ordered.ordered_scan(df, [], ["name", "id"], seq="seq", chunks=chunks).orderBy("seq").collect()
    assert [r["id"] for r in by_text] == [r["id"] for r in df.orderBy("name", "id").collect()]


def test_cooldown_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(1, 10 * i, 0, i) for i in range(50)], "session_id int, timestamp_ns long, tid long, event_id long")
    for chunks in (1, 5):
        before = seen.value
        cooldown.fired_alerts(df.mapInPandas(count, df.schema), 25, keys=["session_id"], chunks=chunks).collect()
        assert seen.value - before == 50


def test_a_late_event_does_not_displace_an_alert(spark, folder):
    schema = "session_id int, timestamp_ns long, event_id long, probability double"
    writer = AlertWriter(lambda w: w, out=f"{folder}/out", state=f"{folder}/state", cooldown_ns=60, keys=["session_id"])
    writer(spark.createDataFrame([(1, 100, 0, 0.9), (2, 5, 9, 0.9)], schema), 0)
    writer(spark.createDataFrame([(1, 95, 1, 0.9), (1, 155, 2, 0.9), (1, 160, 3, 0.9)], schema), 1)
    writer(spark.createDataFrame([(2, 60, 4, 0.9), (2, 70, 5, 0.9)], schema), 2)
    fired = spark.read.parquet(f"{folder}/out").select("session_id", "timestamp_ns").collect()
    assert sorted(map(tuple, fired)) == [(1, 100), (1, 160), (2, 5), (2, 70)]


def test_repeated_sampling_keys_are_refused(spark):
    rows = spark.createDataFrame([(1,)] * 40, "id int")
    with pytest.raises(ValueError, match="repeats"):
        sampling.sample_n(rows, ["id"], 7)
    assert sampling.sample_n(rows, ["id"], 40).count() == 40


def test_split_evaluates_its_input_at_most_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "id int, label int")
    sampling.stratified_split(df.mapInPandas(count, df.schema), ["id"]).collect()
    assert seen.value <= 200


def test_areas_beyond_the_range_of_longs(spark, monkeypatch):
    from windrow.operators import metrics

    steps = spark.createDataFrame(
        [(2_000_000_000, 0, 2_000_000_000, 0, 2_000_000_000, 20_000_000_000),
         (0, 20_000_000_000, 2_000_000_000, 20_000_000_000, 2_000_000_000, 20_000_000_000)],
        "tp long, fp long, cum_tp long, cum_fp long, n_pos long, n_neg long")
    monkeypatch.setattr(metrics, "score_steps", lambda *a, **k: steps)
    row = ranking_quality(steps).first()
    assert row["auc"] == 1.0 and row["average_precision"] == 1.0


def test_captures_are_read_by_their_headers(spark, folder):
    with open(f"{folder}/syscalls_normal_1.csv", "w") as f:
        f.write("pid,timestamp_ns,comm,syscall_name,label\n7,100,sh,openat,0\n")
    with open(f"{folder}/syscalls_attack_2.csv", "w") as f:
        f.write("timestamp_ns,pid,tid,comm,syscall_name,label,extra\n200,8,9,nc,execve,1,zz\n")
    rows = src.read_events(spark, folder).orderBy("timestamp_ns").collect()
    assert [(r["timestamp_ns"], r["pid"], r["tid"], r["comm"], r["label"]) for r in rows] == [(100, 7, 7, "sh", 0), (200, 8, 9, "nc", 1)]
    with open(f"{folder}/syscalls_bad_3.csv", "w") as f:
        f.write("pid,comm\n1,x\n")
    with pytest.raises(ValueError, match="no column"):
        src.read_events(spark, folder)


def test_fractional_feed_times_and_unreadable_bounds(spark):
    lines = spark.createDataFrame([
        ('{"rule": "a", "output_fields": {"evt.time": 1.7e18}}',), ('{"rule": "b", "output_fields": {"evt.time": 1700000000000000001}}',),
        ('{"rule": "c", "output_fields": {"evt.time": 1700000000000000001.0}}',), ('{"rule": "d", "output_fields": {"evt.time": "x"}}',)], "value string")
    got = {r["rule"]: r["time_ns"] for r in feeds.parse_rule_alerts(lines).collect()}
    assert got == {"a": 1_700_000_000_000_000_000, "b": 1_700_000_000_000_000_001, "c": 1_700_000_000_000_000_000}
    bad = spark.createDataFrame([("t\t1\tnever", 0)], "value string, ordinal long")
    with pytest.raises(Exception, match="unreadable bound"):
        feeds.parse_timeline(bad).collect()


def test_a_scope_leaves_no_tables(spark):
    import os

    before = set(os.listdir(shared_dir(spark)))
    df = spark.createDataFrame([(1, 10 * i, 0, i) for i in range(50)], "session_id int, timestamp_ns long, tid long, event_id long")
    with scratch(spark):
        assert cooldown.fired_alerts(df, 25, keys=["session_id"], chunks=5).count() == 17
        assert set(os.listdir(shared_dir(spark))) > before
    assert set(os.listdir(shared_dir(spark))) == before


def test_old_stream_state_is_deleted(spark, folder):
    import os

    from windrow.streaming.scoring import Versions

    state = Versions(f"{folder}/state")
    for i in range(4):
        state.save(spark.range(i), i)
    assert sorted(os.listdir(f"{folder}/state")) == ["2", "3"]
    assert state.before(spark.range(1), 4, "id long").count() == 3
