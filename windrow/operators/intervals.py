"""Joins of events with intervals of time, and bursts of attack events."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.scalars import event_label, int_div, wall_ns
from windrow.operators.ordered import last_at_or_before, next_at_or_after, ordered_scan
from windrow.operators.segments import disjoint_segments, places_below, sweep
from windrow.schema import EVENT_ORDER
from windrow.storage import broadcast_rows
from windrow.vocabulary import UNATTRIBUTED

MIN_BINS = 4096
_SEGMENTS = [
    T.StructField("_starts", T.ArrayType(T.LongType())), T.StructField("_ends", T.ArrayType(T.LongType())),
    T.StructField("_techniques", T.ArrayType(T.StringType())),
]


def overlapping_intervals(timeline: DataFrame, keys: list[str] = (), chunks: int | None = None) -> DataFrame:
    """Intervals that begin at or before the end of the one before them.

    Both ends belong to an interval, so touching intervals overlap.
    """
    keys = list(keys)
    order = ["start_ns", "end_ns", "ordinal"]
    scanned = ordered_scan(timeline, keys, order, lags={"prev_end_ns": "end_ns"}, chunks=chunks)
    return scanned.where("start_ns <= prev_end_ns")


def require_disjoint(timeline: DataFrame, keys: list[str] = (), chunks: int | None = None) -> None:
    found = overlapping_intervals(timeline, keys, chunks).first()
    if found:
        raise ValueError(f"timeline intervals overlap at {found['technique']} ({found['start_ns']})")


def rows_if_small(timeline: DataFrame) -> list[Row] | None:
    """The timeline's rows if their number is within the broadcast bound.

    Reads at most one row more than the bound.
    """
    most = broadcast_rows(timeline.sparkSession)
    rows = timeline.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _bin(t: Column, width: int) -> Column:
    return int_div(t - F.pmod(t, F.lit(width)), width)


def first_interval(
    rows: DataFrame, time_ns: Column, timeline: DataFrame | list[Row], *, out: str = "technique", keys: list[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Add the technique of the first interval (file order) holding ``time_ns``.

    Both ends are included; no match gives NULL. The timeline is cut into disjoint segments, at most
    two per interval and one more, so a row is tested against one segment however many intervals hold
    it, rows do not multiply and need no id. A timeline of checked size is swept on the driver and
    broadcast; a larger one is swept in chunks and meets the rows in one backward as-of join.
    """
    keys = list(keys)
    small = timeline if isinstance(timeline, list) else rows_if_small(timeline)
    if small is not None:
        return _with_broadcast_segments(rows, time_ns, small, out, keys)
    segments = disjoint_segments(timeline, keys)
    found = last_at_or_before(rows, segments, keys, time_ns, "start_ns", "_segment", chunks)
    return found.withColumn(
        out, F.when(time_ns <= F.col("_segment.end_ns"), F.col("_segment.technique"))).drop("_segment")


def _with_broadcast_segments(rows: DataFrame, time_ns: Column, spans: list[Row], out: str, keys: list[str]) -> DataFrame:
    """Segments in bins of equal width, as sorted arrays; a row finds its own by bisection of its bin."""
    by_key, names = defaultdict(list), {}
    for s in spans:
        key = tuple(s[k] for k in keys)
        by_key[key].append((s["ordinal"], s["start_ns"], s["end_ns"]))
        names.setdefault((key, s["ordinal"]), s["technique"])
    cut = [(key, *segment) for key, held in by_key.items() for segment in sweep(held)]
    covered = sum(end - start for _, _, start, end in cut)
    # Wide enough that n segments fall into at most 3 n + MIN_BINS bins.
    width = max(1, math.ceil(covered / max(MIN_BINS, len(cut))))
    bins = defaultdict(list)
    for key, ordinal, start, end in cut:
        for b in range(start // width, end // width + 1):
            bins[(*key, b)].append((start, end, names[key, ordinal]))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_bin", T.LongType()), *_SEGMENTS])
    table = rows.sparkSession.createDataFrame([(*at, *map(list, zip(*sorted(held)))) for at, held in bins.items()], schema)
    most = max(map(len, bins.values()), default=1)
    timed = rows.withColumn("_t", time_ns).withColumn("_bin", _bin(F.col("_t"), width))
    met = timed.join(F.broadcast(table), [*keys, "_bin"], "left").withColumn(
        "_at", places_below(F.col("_starts"), F.col("_t"), most) - 1)
    inside = (F.col("_at") >= 0) & (F.col("_t") <= F.get("_ends", F.col("_at")))
    return met.withColumn(out, F.when(inside, F.get("_techniques", F.col("_at")))).drop(
        "_bin", "_t", "_at", "_starts", "_ends", "_techniques")


def label_events(
    events: DataFrame, attack_cgroup, timeline: DataFrame | None, *, human_time: str = "timestamp_human",
    check: bool = True, capture_zone: str = "UTC",
) -> DataFrame:
    """Add ``label`` (scope) and ``technique`` (timeline) to raw events.

    Attack events outside every interval, or without a readable wall time, are
    ``unattributed``; normal events have technique ''. Without a timeline no
    event has a technique. ``capture_zone`` is the time zone of the host that
    wrote the wall times; timeline bounds are seconds since 1970.
    """
    labeled = events.withColumn("label", event_label(F.col("cgroup_id"), attack_cgroup))
    if timeline is None:
        return labeled.withColumn("technique", F.lit(""))
    # Timeline bounds are kept to the microsecond, as the wall clock of events is.
    micros = timeline.withColumns(
        {c: F.bround(F.col(c).cast("decimal(20,0)") / 1000, 0).cast("long") * 1000 for c in ("start_ns", "end_ns")}
    )
    small = rows_if_small(micros)
    if small == []:
        return labeled.withColumn("technique", F.lit(""))
    if check and small is None:
        require_disjoint(micros)
    elif check:
        ordered = sorted(small, key=lambda s: (s["start_ns"], s["end_ns"]))
        for before, after in zip(ordered, ordered[1:]):
            if after["start_ns"] <= before["end_ns"]:
                raise ValueError(f"timeline intervals overlap at {after['technique']} ({after['start_ns']})")
    # Only attack rows look the timeline up; the others get a NULL time.
    wall = F.to_utc_timestamp(F.col(human_time).cast("timestamp"), capture_zone)
    t = F.when(F.col("label") == 1, wall_ns(wall))
    found = first_interval(labeled, t, micros if small is None else small, out="technique")
    return found.withColumn(
        "technique",
        F.when(F.col("label") == 1, F.coalesce("technique", F.lit(UNATTRIBUTED))).otherwise(F.lit("")),
    )


def attack_bursts(
    events: DataFrame, gap_ns: int, *, keys: list[str] = ("session_id",), order: list[str] = EVENT_ORDER,
    chunks: int | None = None,
) -> DataFrame:
    """Onset of each burst: the first attack event after more than ``gap_ns`` without one.

    The burst carries its first event's technique.
    """
    keys, clock = list(keys), order[0]
    carry = [c for c in ("technique",) if c in events.columns]
    attacks = events.where("label = 1").select(*dict.fromkeys([*keys, *order, *carry]))
    scanned = ordered_scan(attacks, keys, order, lags={"_prev": clock}, chunks=chunks)
    starts = F.col("_prev").isNull() | (F.col(clock) - F.col("_prev") > gap_ns)
    return scanned.where(starts).select(*keys, "event_id", F.col(clock).alias("onset_ts"), *carry)


def detection_latency(
    bursts: DataFrame, scored: DataFrame, *, keys: list[str] = ("session_id",), chunks: int | None = None
) -> DataFrame:
    """Each burst with the first flagged window close at or after its onset.

    ``latency_ms`` is NULL for a burst that no later window detects.
    """
    closes = scored.where("pred = 1").select(*keys, "close_ts")
    found = next_at_or_after(bursts, closes, list(keys), "onset_ts", "close_ts", "alarm_ts", chunks, once=True)
    return found.withColumn("latency_ms", (F.col("alarm_ts") - F.col("onset_ts")) / F.lit(1e6))


def semi_anti(events: DataFrame, known: DataFrame, dropped: DataFrame, on: str = "comm") -> DataFrame:
    """Rows with a known ``on`` (kind ``known``), and rows whose ``on`` is not dropped (kind ``kept``)."""
    def side(table: DataFrame, how: str, kind: str) -> DataFrame:
        named = table.select(on).distinct()
        few = named.limit(broadcast_rows(events.sparkSession) + 1).count() <= broadcast_rows(events.sparkSession)
        return events.join(F.broadcast(named) if few else named, on, how).withColumn("kind", F.lit(kind))

    return side(known, "left_semi", "known").unionByName(side(dropped, "left_anti", "kept"))
