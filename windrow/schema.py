"""Column types of the event log and of the tables derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw capture, in file order. Unsigned 32-bit ids need long; the monotonic
# nanosecond clock stays a long because Spark timestamps stop at microseconds.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("timestamp_human", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("ppid", T.LongType()),
        T.StructField("tid", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("comm", T.StringType()),
        T.StructField("syscall_nr", T.IntegerType()),
        T.StructField("syscall_name", T.StringType()),
        T.StructField("arg1", T.LongType()),
        T.StructField("arg2", T.LongType()),
        T.StructField("arg3", T.LongType()),
        T.StructField("return_value", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("is_root", T.IntegerType()),
        T.StructField("cgroup_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
    ]
)

LABELED_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField("technique", T.StringType())])

# What windowing and the denylist need; nothing else is read from disk.
TRAINING_COLUMNS = ["timestamp_ns", "pid", "comm", "syscall_name", "label"]

TIMELINE_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("technique", T.StringType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
    ]
)

# Total order of events: the clock, then thread, then the ingest id breaks ties.
EVENT_ORDER = ["timestamp_ns", "tid", "event_id"]
