"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F
from support import VOCAB, frame, log
from windrow.operators import intervals as iv
from windrow.operators import windows as wn
from windrow.operators.ordered import ordered_scan
from windrow.schema import EVENT_ORDER


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def on_disk(spark, folder):
    frame(spark, log(200, seed=1)).write.parquet(f"{folder}/ev")
    return spark.read.parquet(f"{folder}/ev")


def numbered(spark, folder, chunks=6):
    return wn.number_events(on_disk(spark, folder), VOCAB, keys=["session_id"], carry=["label"], chunks=chunks)


def test_windows_cost_two_row_shuffles(spark, folder):
    p = plan(wn.bag_windows(numbered(spark, folder), VOCAB, keys=["session_id"], window=20, stride=10, ngram=2))
    # Rows: once by (session, chunk), once by window. The table of chunks: two small ones.
    assert len(re.findall(r"Exchange hashpartitioning\(session_id#\d+, window_id", p)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 4
    assert "SinglePartition" not in p and "Python" not in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_only_needed_columns_are_read(spark, folder):
    p = plan(wn.bag_windows(numbered(spark, folder), VOCAB, keys=["session_id"], window=20, stride=10))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert "comm" not in schema and "technique" not in schema and "uid" not in schema


def test_filters_reach_the_scan(spark, folder):
    df = on_disk(spark, folder).where(F.col("session_id") == 1)
    p = plan(ordered_scan(df, ["session_id"], EVENT_ORDER, seq="seq", chunks=1).select("event_id", "seq"))
    assert "EqualTo(session_id,1)" in p


def test_one_sequence_never_meets_in_one_task(spark, folder):
    """Without keys only the table of chunks goes to a single partition."""
    p = plan(ordered_scan(on_disk(spark, folder), [], EVENT_ORDER, seq="seq", chunks=6))
    single = [line for line in p.splitlines() if "SinglePartition" in line]
    assert len(single) == 1
    rows = next(line for line in p.splitlines() if "Exchange hashpartitioning(_chunk" in line)
    assert rows


def test_interval_join_moves_no_rows(spark, folder):
    spans = spark.createDataFrame([(0, "a", 0, 10)], "ordinal long, technique string, start_ns long, end_ns long")
    events = on_disk(spark, folder)
    p = plan(iv.first_interval(events, F.col("timestamp_ns"), spans))
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p
    left = p[p.index("BroadcastHashJoin"):p.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in left
