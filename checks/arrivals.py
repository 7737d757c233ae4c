"""The events table arriving as a stream: four slices of files by time of arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import surrogate as sg
from windrow.streaming import ingest

SLICES = 4
SLICE_DAYS = 8
ROWS_PER_FILE = 5_000_000
# Event times start here; a slice takes eight days of arrivals, the last one the rest.
FIRST = "2024-01-01"
DAY_MS = 86_400_000

IN_ORDER = "ts"
# Up to four hours late; one in 97 three days late.
SHUFFLED = "ts + make_dt_interval(IF(event_id * 7919 % 97 = 0, 3, 0), int(event_id % 5))"
SHUFFLED_SQL = "ts + to_hours(event_id % 5) + to_days(CASE WHEN event_id * 7919 % 97 = 0 THEN 3 ELSE 0 END)"


def slice_sql(arrival: str) -> str:
    return f"least({SLICES - 1}, greatest(0, date_diff('day', DATE '{FIRST}', CAST({arrival} AS DATE)) // {SLICE_DAYS}))"


def arriving(spark, sf, folder: str, arrival: str = IN_ORDER, heartbeat: bool = False):
    """Stream of the table's files, one slice a batch, oldest first, read as a call log.

    The heartbeat is one row far ahead of all others, after which the watermark has passed them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.read.parquet(f"{sf}/events.parquet")
    late = F.expr(f"least({SLICES - 1}, greatest(0, datediff(date({arrival}), DATE '{FIRST}') div {SLICE_DAYS}))")
    files = raw.count() // ROWS_PER_FILE + 1
    for i in range(SLICES):
        raw.where(late == i).repartition(files).write.mode("append").parquet(folder)
    if heartbeat:
        raw.limit(1).select(*[
            F.lit(-1).cast("long").alias(c) if c in ("event_id", "user_id")
            else F.lit("2200-01-01").cast(raw.schema[c].dataType).alias(c) if c == "ts" else F.col(c) for c in raw.columns
        ]).write.mode("append").parquet(folder)
    return sg.as_log(ingest.stream_events(spark, folder, raw.schema, files_per_batch=files))
