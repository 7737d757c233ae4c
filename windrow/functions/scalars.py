"""Row-wise expressions: clean-up, clocks, labels and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.storage import small_table
from windrow.vocabulary import SYSCALL_NUMBERS

_HUMAN_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$"
_NUL_TAIL = "\\x00+$"


def int_div(value: Column, by: int) -> Column:
    """Whole-number division towards zero, without a detour through doubles."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def clean_text(raw: Column) -> Column:
    """Fixed-size byte field to text: bad UTF-8 replaced, trailing NULs removed."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), _NUL_TAIL, "")


def parse_human_time(text: Column) -> Column:
    """Naive local time with up to six fraction digits; anything else gives NULL."""
    return F.when(text.rlike(_HUMAN_TIME), text.try_cast("timestamp_ntz"))


def format_human_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def wall_ns(ts: Column) -> Column:
    """Naive time as nanoseconds since 1970 (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def seconds_to_ns(seconds: Column) -> Column:
    """Decimal seconds (text or number) to whole nanoseconds, NULL if unreadable."""
    return F.round(seconds.try_cast("decimal(28,9)") * F.lit(1_000_000_000), 0).try_cast("long")


def ns_to_time(ns: Column) -> Column:
    return F.timestamp_micros(int_div(ns, 1000))


def ns_to_ms(ns: Column) -> Column:
    return ns / F.lit(1e6)


def is_root(uid: Column) -> Column:
    return F.coalesce(uid == 0, F.lit(False)).cast("int")


def session_label(name: Column) -> Column:
    """1 for an attack capture, 0 for any other."""
    return F.when(name == "attack", 1).otherwise(0)


def event_label(cgroup: Column, attack_cgroup) -> Column:
    """1 inside the attack scope; a missing scope counts as outside."""
    return F.coalesce(cgroup == attack_cgroup, F.lit(False)).cast("int")


def decide(probability: Column, threshold: float, strict: bool = False) -> Column:
    """Offline decisions include the threshold, live ones (``strict``) do not."""
    return ((probability > threshold) if strict else (probability >= threshold)).cast("int")


def name_calls(events: DataFrame, numbers: dict[str, int] = SYSCALL_NUMBERS) -> DataFrame:
    """Add ``syscall_name`` from ``syscall_nr``; unknown numbers give ``syscall_<nr>``."""
    dim = small_table(events.sparkSession, [(n, t) for t, n in numbers.items()], "_nr int, _name string")
    fallback = F.concat(F.lit("syscall_"), F.col("syscall_nr").cast("string"))
    return (
        events.join(F.broadcast(dim), events["syscall_nr"] == dim["_nr"], "left")
        .withColumn("syscall_name", F.coalesce("_name", fallback))
        .drop("_nr", "_name")
    )


def keep_monitored(events: DataFrame, numbers: list[int], self_pid: int | None = None) -> DataFrame:
    """Keep monitored call numbers and drop the collector's own process."""
    kept = events.where(F.col("syscall_nr").isin(list(numbers)))
    return kept if self_pid is None else kept.where(F.col("pid") != self_pid)


def drop_comms(events: DataFrame, names) -> DataFrame:
    """Drop listed process names. Rows without a name stay; an empty list drops nothing."""
    names = list(names or [])
    if not names:
        return events
    return events.where(~F.coalesce(F.col("comm").isin(names), F.lit(False)))


def enrich(events: DataFrame, session_name: Column) -> DataFrame:
    return events.withColumns({"is_root": is_root(F.col("uid")), "label": session_label(session_name)})
