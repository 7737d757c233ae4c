"""The driver's ``events`` table read as a system-call log, in Spark and in SQL.

Both sides define the same view: types of event stand for calls, users for
processes. ``signup`` is outside the vocabulary on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.vocabulary import TECHNIQUES, Vocabulary

VOCAB = Vocabulary.of(["click", "purchase", "error", "view"], ["error", "purchase"])
ATTACK_CGROUP = 3
DENYLIST = ["app11"]
KEYS = ["session_id"]
PID_KEYS = ["session_id", "pid"]
DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000
GAP_NS = 90 * 60 * 1_000_000_000
W, S, FRAC = 20, 10, 0.2
SCORE_SCALE = 500.0
NAMES = TECHNIQUES


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(raw: DataFrame) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    pid = F.col("user_id")
    number = (
        F.when(F.col("event_type") == "click", 59)
        .when(F.col("event_type") == "purchase", 105)
        .when(F.col("event_type") == "error", 101)
        .when(F.col("event_type") == "view", 257)
        .otherwise(99)
    )
    return raw.select(
        "event_id",
        ns.alias("timestamp_ns"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp_human"),
        pid.alias("pid"),
        pid.alias("tid"),
        (pid % 7).alias("uid"),
        F.concat(F.lit("app"), (pid % 12).cast("string")).alias("comm"),
        F.col("event_type").alias("syscall_name"),
        number.alias("syscall_nr"),
        (pid % 10).alias("cgroup_id"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), 1).otherwise(2).alias("session_id"),
        "value",
        "props",
    )


EV = """
ev AS (
  SELECT event_id, epoch_us(ts) * 1000 AS timestamp_ns, ts AS timestamp_human,
         user_id AS pid, user_id AS tid, user_id % 7 AS uid,
         concat('app', user_id % 12) AS comm, event_type AS syscall_name,
         CASE event_type WHEN 'click' THEN 59 WHEN 'purchase' THEN 105
              WHEN 'error' THEN 101 WHEN 'view' THEN 257 ELSE 99 END AS syscall_nr,
         user_id % 10 AS cgroup_id,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS session_id,
         value, props
  FROM events
)"""

# Labelled and filtered events, numbered over the session and over the process.
SEQ = EV + """,
lab AS (
  SELECT *, CASE WHEN cgroup_id = 3 THEN 1 ELSE 0 END AS label
  FROM ev WHERE comm <> 'app11'
),
seq AS (
  SELECT *,
         row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ns, tid, event_id) - 1 AS seq,
         count(*) OVER (PARTITION BY session_id) AS n_total,
         row_number() OVER (PARTITION BY session_id, pid ORDER BY timestamp_ns, tid, event_id) - 1 AS pseq,
         count(*) OVER (PARTITION BY session_id, pid) AS pn_total
  FROM lab
)"""

# Vocabulary and critical pairs, derived from the distinct tokens of the log.
DICT = """
voc AS (
  SELECT * FROM (VALUES (0, 'click', false), (1, 'purchase', true), (2, 'error', true), (3, 'view', false))
    v(idx, token, is_critical)
),
bi AS (
  SELECT 4 + row_number() OVER (ORDER BY a.idx, b.idx) - 1 AS feature_idx, a.token AS a, b.token AS b
  FROM voc a, voc b WHERE a.is_critical OR b.is_critical
),
feat AS (
  SELECT idx AS feature_idx, token AS feature FROM voc
  UNION ALL SELECT feature_idx, concat(a, '→', b) FROM bi
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes)


# Windows by plain membership: every window id, its events, its label.
WIN = """
win AS (
  SELECT session_id, seq // 10 - 1 AS window_id, seq - 19 AS start_seq, seq AS end_seq, timestamp_ns AS close_ts
  FROM seq WHERE seq >= 19 AND (seq - 19) % 10 = 0
),
mem AS (
  SELECT w.session_id, w.window_id, w.start_seq, w.end_seq, w.close_ts, s.seq, s.syscall_name, s.label, s.event_id,
         lag(s.syscall_name) OVER (PARTITION BY w.session_id, w.window_id ORDER BY s.seq) AS prev
  FROM win w JOIN seq s ON s.session_id = w.session_id AND s.seq BETWEEN w.start_seq AND w.end_seq
),
wlab AS (
  SELECT session_id, window_id, min(start_seq) AS start_seq, max(end_seq) AS end_seq, max(close_ts) AS close_ts,
         sum(label) AS attack_events,
         CASE WHEN sum(label) >= 1 AND sum(label) >= 4.0 THEN 1 ELSE 0 END AS label
  FROM mem GROUP BY session_id, window_id
)"""

# Unigram and critical-pair counts of those windows.
BAG = """
bag AS (
  SELECT session_id, window_id, feature_idx, count(*) AS cnt FROM (
    SELECT m.session_id, m.window_id, v.idx AS feature_idx FROM mem m JOIN voc v ON v.token = m.syscall_name
    UNION ALL
    SELECT m.session_id, m.window_id, b.feature_idx FROM mem m JOIN bi b ON b.a = m.prev AND b.b = m.syscall_name
  ) GROUP BY ALL
)"""


# --- timelines and alert feeds, derived from the log ---------------------------

FIRST_DAY = 19_723  # 2024-01-01 in days since 1970
_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def _name(d):
    return F.get(F.array(*[F.lit(n) for n in NAMES]), (d % len(NAMES)).cast("int"))


def _days(ev: DataFrame) -> DataFrame:
    day = F.call_function("div", F.col("timestamp_ns"), F.lit(DAY_NS))
    return ev.select(day.alias("day")).distinct()


def timeline(ev: DataFrame) -> DataFrame:
    """One technique per day, 06:00 to 18:00."""
    d, start = F.col("day") - FIRST_DAY, F.col("day") * DAY_NS
    return _days(ev).select(
        d.alias("ordinal"), _name(d).alias("technique"),
        (start + 6 * HOUR_NS).alias("start_ns"), (start + 18 * HOUR_NS).alias("end_ns"),
    )


TIMELINE = f"""
tl AS (
  SELECT d AS ordinal, ({_NAME_LIST})[d % 14 + 1] AS technique,
         day * {DAY_NS} + 6 * {HOUR_NS} AS start_ns, day * {DAY_NS} + 18 * {HOUR_NS} AS end_ns
  FROM (SELECT DISTINCT timestamp_ns // {DAY_NS} AS day, timestamp_ns // {DAY_NS} - {FIRST_DAY} AS d FROM ev)
)"""


def overlapping_timeline(ev: DataFrame) -> DataFrame:
    """Two overlapping intervals per day; the earlier listed one wins."""
    d, start = F.col("day") - FIRST_DAY, F.col("day") * DAY_NS
    one = F.struct((2 * d).alias("ordinal"), _name(d + 5).alias("technique"),
                   (start + 10 * HOUR_NS).alias("start_ns"), (start + 20 * HOUR_NS).alias("end_ns"))
    two = F.struct((2 * d + 1).alias("ordinal"), _name(d).alias("technique"),
                   (start + 6 * HOUR_NS).alias("start_ns"), (start + 18 * HOUR_NS).alias("end_ns"))
    return _days(ev).select(F.inline(F.array(one, two)))


OVERLAPPING = f"""
dd AS (SELECT DISTINCT timestamp_ns // {DAY_NS} AS day, timestamp_ns // {DAY_NS} - {FIRST_DAY} AS d FROM ev),
otl AS (
  SELECT 2 * d AS ordinal, ({_NAME_LIST})[(d + 5) % 14 + 1] AS technique,
         day * {DAY_NS} + 10 * {HOUR_NS} AS start_ns, day * {DAY_NS} + 20 * {HOUR_NS} AS end_ns FROM dd
  UNION ALL
  SELECT 2 * d + 1, ({_NAME_LIST})[d % 14 + 1],
         day * {DAY_NS} + 6 * {HOUR_NS}, day * {DAY_NS} + 18 * {HOUR_NS} FROM dd
)"""


def timeline_lines(ev: DataFrame) -> DataFrame:
    """A timeline line per event; every tenth lacks a field."""
    def seconds(ns):
        whole = F.call_function("div", ns, F.lit(1_000_000_000))
        micros = F.call_function("div", ns, F.lit(1000)) % 1_000_000
        return F.concat_ws(".", whole.cast("string"), F.lpad(micros.cast("string"), 6, "0"))

    t = F.col("timestamp_ns")
    short = F.concat_ws("\t", "syscall_name", seconds(t))
    full = F.concat_ws("\t", short, seconds(t + 5_000_000_000))
    return ev.select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 10 == 0, short).otherwise(full).alias("value"))


TIMELINE_LINES = """
tlines AS (
  SELECT event_id AS ordinal,
         concat(syscall_name, chr(9), timestamp_ns // 1000000000, '.', lpad(CAST(timestamp_ns // 1000 % 1000000 AS VARCHAR), 6, '0'),
                CASE WHEN event_id % 10 = 0 THEN '' ELSE
                concat(chr(9), (timestamp_ns + 5000000000) // 1000000000, '.',
                       lpad(CAST((timestamp_ns + 5000000000) // 1000 % 1000000 AS VARCHAR), 6, '0')) END) AS value
  FROM ev
)"""


def _k():
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


def rule_lines(ev: DataFrame) -> DataFrame:
    """Rule alerts as JSON text: broken lines, lines without a rule, without a time."""
    rule = F.concat(F.lit('"rule":"rule'), (_k() % 7).cast("string"), F.lit('"'))
    time = F.concat(F.lit('"output_fields":{"evt.time":'), F.col("timestamp_ns").cast("string"), F.lit("}"))
    line = (
        F.when(F.col("event_id") % 10 == 0, F.lit('{"rule": broken'))
        .when(_k() % 10 == 0, F.concat(F.lit("{"), time, F.lit("}")))
        .when(_k() % 10 == 1, F.concat(F.lit("{"), rule, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), rule, F.lit(","), time, F.lit("}")))
    )
    return ev.select("event_id", line.alias("value"))


RULE_LINES = """
rlines AS (
  SELECT event_id, CASE
    WHEN event_id % 10 = 0 THEN '{"rule": broken'
    WHEN k % 10 = 0 THEN concat('{"output_fields":{"evt.time":', timestamp_ns, '}}')
    WHEN k % 10 = 1 THEN concat('{"rule":"rule', k % 7, '"}')
    ELSE concat('{"rule":"rule', k % 7, '","output_fields":{"evt.time":', timestamp_ns, '}}') END AS value
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM ev)
)"""
RULE_ALERTS = """
alerts_a AS (
  SELECT event_id, json_extract_string(value, '$.rule') AS rule,
         CAST(json_extract_string(value, '$.output_fields."evt.time"') AS BIGINT) AS time_ns
  FROM (SELECT event_id, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS value FROM rlines)
  WHERE json_extract_string(value, '$.rule') IS NOT NULL
    AND json_extract_string(value, '$.output_fields."evt.time"') IS NOT NULL
)"""


def attributed_rule_alerts(ev: DataFrame) -> DataFrame:
    from windrow.operators.intervals import first_interval
    from windrow.sources.feeds import parse_rule_alerts

    alerts = parse_rule_alerts(rule_lines(ev), "event_id")
    return first_interval(alerts, F.col("time_ns"), overlapping_timeline(ev))


def signature_lines(ev: DataFrame) -> DataFrame:
    """Detections mixed with raw events, null properties and broken lines."""
    sid = F.concat(F.lit('"signatureID":"SIG-'), (_k() % 7).cast("string"), F.lit('"'))
    name = F.concat(F.lit('"signatureName":"name'), (_k() % 7).cast("string"), F.lit('"'))
    props = (
        F.when(_k() % 10 == 0, F.lit("null"))
        .when(_k() % 10 == 1, F.concat(F.lit("{"), sid, F.lit("}")))
        .when(_k() % 10 == 2, F.lit('{"signatureID":""}'))
        .otherwise(F.concat(F.lit("{"), sid, F.lit(","), name, F.lit("}")))
    )
    line = F.concat(
        F.lit('{"timestamp":'), F.col("timestamp_ns").cast("string"), F.lit(',"cgroupId":'), F.col("cgroup_id").cast("string"),
        F.lit(',"metadata":{"Properties":'), props, F.lit("}}"),
    )
    return ev.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("{oops")).otherwise(line).alias("value"))


SIGNATURE_LINES = """
slines AS (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{oops' ELSE
    concat('{"timestamp":', timestamp_ns, ',"cgroupId":', cgroup_id, ',"metadata":{"Properties":',
      CASE WHEN k % 10 = 0 THEN 'null'
           WHEN k % 10 = 1 THEN concat('{"signatureID":"SIG-', k % 7, '"}')
           WHEN k % 10 = 2 THEN '{"signatureID":""}'
           ELSE concat('{"signatureID":"SIG-', k % 7, '","signatureName":"name', k % 7, '"}') END, '}}') END AS value
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM ev)
)"""
SIGNATURE_ALERTS = """
alerts_b AS (
  SELECT event_id, json_extract_string(value, '$.metadata.Properties.signatureID') AS signature_id,
         coalesce(json_extract_string(value, '$.metadata.Properties.signatureName'),
                  json_extract_string(value, '$.metadata.Properties.signatureID')) AS signature_name,
         CAST(json_extract_string(value, '$.timestamp') AS BIGINT) AS time_ns,
         CAST(json_extract_string(value, '$.cgroupId') AS BIGINT) AS cgroup_id
  FROM (SELECT event_id, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS value FROM slines)
  WHERE coalesce(json_extract_string(value, '$.metadata.Properties.signatureID'), '') <> ''
)"""
