import json

import pytest

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from windrow.functions import scalars as sc
from windrow.plans.label import label_capture
from windrow.schema import EVENT_SCHEMA
from windrow.sources import events as src
from windrow.sources import feeds

HEAD = ",".join(EVENT_SCHEMA.names)


def capture(path, rows, head=HEAD):
    with open(path, "w") as f:
        f.write(head + "\n" + "\n".join(rows) + "\n")


def line(ts, pid, comm, nr, name, cgroup, human="2026-01-01 00:00:05.000001"):
    return f"{ts},{human},{pid},1,{pid},0,0,{comm},{nr},{name},0,0,0,0,,1,{cgroup},0"


def test_read_events(spark, folder):
    capture(f"{folder}/syscalls_attack_1.csv", [line(5, 1, "gcc", 59, "execve", 3), line(6, 1, "sh", 2, "open", 3)])
    capture(f"{folder}/syscalls_normal_2.csv", [line(7, 4294967295, "", 9, "mmap", 4)])
    capture(f"{folder}/other.csv", [line(9, 2, "sh", 2, "open", 3)])
    df = src.read_events(spark, folder, exclude_comm=["gcc"])
    got = {(r["timestamp_ns"], r["pid"], r["comm"], r["session_id"]) for r in df.collect()}
    # A row without a process name is kept.
    assert got == {(6, 1, "sh", "syscalls_attack_1"), (7, 4294967295, None, "syscalls_normal_2")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "filename" not in plan and "arg1" not in plan
    with pytest.raises(AnalysisException):
        src.read_events(spark, f"{folder}/nothing").count()


def test_raw_capture_needs_the_scope_column(spark, folder):
    capture(f"{folder}/a.csv", [line(5, 1, "sh", 59, "execve", 3)])
    assert src.read_raw_captures(spark, [f"{folder}/a.csv"]).count() == 1
    old = HEAD.replace(",cgroup_id", "")
    capture(f"{folder}/b.csv", ["1"], old)
    with pytest.raises(ValueError, match="cgroup_id"):
        src.read_raw_captures(spark, [f"{folder}/*.csv"])


def test_label_capture_end_to_end(spark, folder):
    capture(f"{folder}/a.csv", [
        line(5, 1, "stealthy", 59, "execve", 3), line(6, 2, "sh", 2, "open", 4),
        line(7, 1, "cycle", 101, "ptrace", 3, "2026-01-01 00:00:09.0"), line(8, 1, "cycle", 101, "ptrace", 3, "soon"),
    ])
    # 2026-01-01 00:00:00 UTC is 1767225600
    with open(f"{folder}/t.tsv", "w") as f:
        f.write("stealthy\t1767225604.5\t1767225606\nbad line\nptrace\t1767225609\t1767225610.25\n")
    timeline = feeds.read_timeline(spark, f"{folder}/t.tsv")
    raw = src.read_raw_captures(spark, [f"{folder}/a.csv"])
    labeled, check = label_capture(raw, 3, timeline, f"{folder}/out")
    got = {r["timestamp_ns"]: (r["label"], r["technique"]) for r in labeled.collect()}
    assert got == {5: (1, "stealthy"), 6: (0, ""), 7: (1, "ptrace"), 8: (1, "unattributed")}
    assert check.first()["status"] == "ok"
    with pytest.raises(ValueError, match="scope"):
        label_capture(raw, 99, timeline)


def test_read_labeled_fills_techniques(spark, folder):
    capture(f"{folder}/l.csv", [line(5, 1, "sh", 59, "execve", 3) + ",", line(6, 1, "ld", 2, "open", 3) + ",x"], HEAD + ",technique")
    assert [r["technique"] for r in src.read_labeled(spark, f"{folder}/l.csv").collect()] == [""]


def test_missing_timeline_warns(spark, folder):
    with pytest.warns(UserWarning):
        assert feeds.read_timeline(spark, f"{folder}/none.tsv").count() == 0


def test_attack_cgroup(spark, folder):
    with open(f"{folder}/cg.txt", "w") as f:
        f.write(" 4026 \n")
    assert src.attack_cgroup(spark, f"{folder}/cg.txt") == 4026
    assert src.attack_cgroup(spark, "77") == 77 and src.attack_cgroup(spark, 5) == 5


def test_rule_feed_is_tolerant(spark, folder):
    good = {"rule": "r1", "output_fields": {"evt.time": 1767225604000000001, "x": 1}, "extra": [1]}
    as_text = {"rule": "r2", "output_fields": {"evt.time": "12"}}
    lines = [json.dumps(good), "", "{broken", json.dumps({"rule": "r"}), json.dumps({"output_fields": {"evt.time": 5}}),
             json.dumps({"rule": "r", "output_fields": {"evt.time": 0}}), "{'rule': 'single'}", json.dumps(as_text)]
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write("\n".join(lines))
    got = {(r["rule"], r["time_ns"]) for r in feeds.read_rule_alerts(spark, f"{folder}/a.jsonl").collect()}
    assert got == {("r1", 1767225604000000001), ("r2", 12)}


def test_signature_feed_keeps_detections(spark, folder):
    def doc(props, **kw):
        return json.dumps({"timestamp": 9, "cgroupId": 3, "metadata": {"Properties": props}, **kw})

    lines = [doc({"signatureID": "S1", "signatureName": "n"}), doc({"signatureID": "S2"}), doc(None), doc({}),
             doc({"signatureID": ""}), doc({"signatureID": "S3"}, timestamp=None), json.dumps({"timestamp": 1}), "junk", ""]
    with open(f"{folder}/b.jsonl", "w") as f:
        f.write("\n".join(lines))
    got = [tuple(r) for r in feeds.read_signature_alerts(spark, f"{folder}/b.jsonl").collect()]
    assert sorted(got) == [("S1", "n", 9, 3), ("S2", "S2", 9, 3)]


def test_text_and_time_clean_up(spark):
    df = spark.createDataFrame([(bytearray(b"ab\x00\x00"),), (bytearray(b"\xff\x00z\x00"),), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(sc.clean_text(F.col("b"))).collect()] == ["ab", "�\x00z", ""]
    times = ["2026-01-01 00:00:05.000001", "2026-01-01 00:00:05", "2026-13-01 00:00:05.0", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(sc.parse_human_time(F.col("t"))).collect()]
    assert got[0].microsecond == 1 and got[1:] == [None] * 4


def test_call_names_and_labels(spark):
    df = spark.createDataFrame([(59,), (333,), (257,)], "syscall_nr int")
    assert {r["syscall_name"] for r in sc.name_calls(df).collect()} == {"execve", "syscall_333", "openat"}
    row = spark.range(1).select(sc.session_label(F.lit("attack")), sc.session_label(F.lit("mixed")), sc.is_root(F.lit(0))).first()
    assert tuple(row) == (1, 0, 1)
    same = spark.createDataFrame([(0.5,)], "p double").select(sc.decide(F.col("p"), 0.5), sc.decide(F.col("p"), 0.5, strict=True)).first()
    assert tuple(same) == (1, 0)


def test_equal_names_in_two_folders_are_two_sessions(spark, folder):
    import gzip
    import os

    for name in ("a", "b"):
        os.makedirs(f"{folder}/{name}")
        capture(f"{folder}/{name}/run.csv", [line(5, 1, "sh", 59, "execve", 3)])
    capture(f"{folder}/a/alone.csv", [line(6, 1, "sh", 59, "execve", 3)])
    with gzip.open(f"{folder}/b/packed.csv.gz", "wt") as f:
        f.write(HEAD + "\n" + line(7, 1, "sh", 59, "execve", 3) + "\n")
    ids = {r["session_id"] for r in src.read_raw_captures(spark, [f"{folder}/*/*.csv", f"{folder}/b/*.gz"]).collect()}
    assert len(ids) == 4 and "alone" in ids and sum(i.endswith("/run") for i in ids) == 2


def test_headers_cost_no_spark_jobs(spark, folder):
    for i in range(6):
        capture(f"{folder}/syscalls_{i}.csv", [line(5 + i, 1, "sh", 59, "execve", 3)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        src.read_events(spark, folder)
        assert len(tracker.getJobIdsForGroup("headers")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
