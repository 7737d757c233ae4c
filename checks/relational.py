"""Checked queries over sources, scalars and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import surrogate as sg
from windrow.functions import scalars as sc
from windrow.operators import intervals as iv
from windrow.operators import reports as rp
from windrow.sources import events as src
from windrow.sources import feeds
from windrow.storage import shared_dir, small_table
from windrow.vocabulary import pair_dictionary

QUERIES, ORACLE = {}, {}
KNOWN = ["app3", "app5", "app7"]
NUMBERS = {"click": 59, "purchase": 105, "error": 101, "view": 257}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def ev(spark, sf):
    return sg.events_view(spark, sf)


# --- sources -----------------------------------------------------------------

@query(sg.with_sql(sg.EV) + " SELECT event_id, session_id, pid, syscall_name, timestamp_ns FROM ev")
def scan_union(spark, sf):
    e = ev(spark, sf).select("event_id", "session_id", "pid", "syscall_name", "timestamp_ns")
    return src.union_sessions(e.where("session_id = 1"), e.where("session_id = 2"))


@query(sg.with_sql(sg.EV) + " SELECT timestamp_ns, pid, comm, syscall_name FROM ev")
def scan_pruned(spark, sf):
    return ev(spark, sf).select("timestamp_ns", "pid", "comm", "syscall_name")


@query(sg.with_sql(sg.EV) + """
SELECT event_id, comm, CASE WHEN cgroup_id = 3 THEN syscall_name ELSE '' END AS technique
FROM ev WHERE comm <> 'app11'""")
def read_labeled(spark, sf):
    e = ev(spark, sf).select("event_id", "comm", F.when(F.col("cgroup_id") == 3, F.col("syscall_name")).alias("technique"))
    return src.normalize_labeled(e, sg.DENYLIST)


@query(sg.with_sql(sg.EV, sg.TIMELINE_LINES) + """
SELECT ordinal, parts[1] AS technique,
       CAST(CAST(parts[2] AS DECIMAL(28,9)) * 1000000000 AS BIGINT) AS start_ns,
       CAST(CAST(parts[3] AS DECIMAL(28,9)) * 1000000000 AS BIGINT) AS end_ns
FROM (SELECT ordinal, string_split(value, chr(9)) AS parts FROM tlines) WHERE len(parts) = 3""")
def timeline_scan(spark, sf):
    return feeds.parse_timeline(sg.timeline_lines(ev(spark, sf)))


@query(sg.with_sql(sg.EV, sg.RULE_LINES, sg.RULE_ALERTS) + " SELECT event_id, rule, time_ns FROM alerts_a")
def alerts_a(spark, sf):
    return feeds.parse_rule_alerts(sg.rule_lines(ev(spark, sf)), "event_id")


@query(sg.with_sql(sg.EV, sg.SIGNATURE_LINES, sg.SIGNATURE_ALERTS)
       + " SELECT event_id, signature_id, signature_name, time_ns, cgroup_id FROM alerts_b")
def alerts_b(spark, sf):
    return feeds.parse_signature_alerts(sg.signature_lines(ev(spark, sf)), "event_id")


# --- scalars -----------------------------------------------------------------

@query(sg.with_sql(sg.EV) + """
SELECT event_id, CASE syscall_nr WHEN 59 THEN 'click' WHEN 105 THEN 'purchase' WHEN 101 THEN 'error'
                 WHEN 257 THEN 'view' ELSE concat('syscall_', syscall_nr) END AS syscall_name
FROM ev""")
def code_lookup(spark, sf):
    return sc.name_calls(ev(spark, sf).drop("syscall_name"), NUMBERS).select("event_id", "syscall_name")


@query(sg.with_sql(sg.EV) + " SELECT event_id, comm, concat(syscall_name, 'é') AS filename FROM ev")
def clean_text(spark, sf):
    pad = F.lit("\x00\x00")
    return ev(spark, sf).select(
        "event_id",
        sc.clean_text(F.concat("comm", pad).cast("binary")).alias("comm"),
        sc.clean_text(F.concat("syscall_name", F.lit("é"), pad).cast("binary")).alias("filename"),
    )


@query(sg.with_sql(sg.EV) + """
SELECT event_id, CASE WHEN uid = 0 THEN 1 ELSE 0 END AS is_root, CASE WHEN comm = 'app3' THEN 1 ELSE 0 END AS label
FROM ev""")
def enrich_event(spark, sf):
    name = F.when(F.col("comm") == "app3", "attack").otherwise("normal")
    return sc.enrich(ev(spark, sf), name).select("event_id", "is_root", "label")


@query(sg.with_sql(sg.EV) + """
SELECT event_id, strftime(timestamp_human, '%Y-%m-%d %H:%M:%S.%f') AS human,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE timestamp_human END AS parsed
FROM ev""")
def parse_ts(spark, sf):
    human = sc.format_human_time(F.col("timestamp_human"))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), human)).otherwise(human)
    return ev(spark, sf).select("event_id", human.alias("human"), sc.parse_human_time(text).alias("parsed"))


@query(sg.with_sql(sg.EV) + """
SELECT event_id, timestamp_human AS wall, timestamp_ns // 1000000000 AS whole_s,
       round(timestamp_ns / 1000000.0, 3) AS ms, timestamp_ns AS ns
FROM ev""")
def clock_convert(spark, sf):
    ns = F.col("timestamp_ns")
    return ev(spark, sf).select(
        "event_id", sc.ns_to_time(ns).cast("timestamp_ntz").alias("wall"), sc.int_div(ns, 1_000_000_000).alias("whole_s"),
        F.round(sc.ns_to_ms(ns), 3).alias("ms"), sc.wall_ns(F.col("timestamp_human")).alias("ns"),
    )


@query(sg.with_sql(sg.EV) + " SELECT event_id, syscall_nr FROM ev WHERE syscall_nr IN (59, 105, 101, 257) AND pid <> 5")
def monitored_filter(spark, sf):
    return sc.keep_monitored(ev(spark, sf), list(NUMBERS.values()), self_pid=5).select("event_id", "syscall_nr")


@query(sg.with_sql(sg.EV) + """
SELECT event_id, CASE WHEN comm = 'app0' THEN NULL ELSE comm END AS comm
FROM ev WHERE comm <> 'app11'""")
def denylist_filter(spark, sf):
    with_nulls = ev(spark, sf).withColumn("comm", F.when(F.col("comm") != "app0", F.col("comm")))
    return sc.drop_comms(with_nulls, sg.DENYLIST).select("event_id", "comm")


@query(sg.with_sql(sg.SEQ) + """
SELECT event_id, session_id, syscall_name FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ns, tid, event_id) AS n FROM ev)
WHERE syscall_name IN ('error', 'purchase') OR n % 25 = 0""")
def event_digest(spark, sf):
    return rp.event_digest(ev(spark, sf), ["error", "purchase"]).select("event_id", "session_id", "syscall_name")


@query(sg.with_sql(sg.EV) + " SELECT event_id, CASE WHEN cgroup_id = 3 THEN 1 ELSE 0 END AS label FROM ev")
def label_events(spark, sf):
    return ev(spark, sf).select("event_id", sc.event_label(F.col("cgroup_id"), sg.ATTACK_CGROUP).alias("label"))


@query(sg.with_sql(sg.EV, sg.DICT) + """
SELECT event_id, coalesce(idx, -1) AS idx FROM ev LEFT JOIN voc ON token = syscall_name""")
def vocab_index(spark, sf):
    indexed = sg.VOCAB.with_index(ev(spark, sf), "syscall_name", "idx")
    return indexed.select("event_id", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query(sg.with_sql(sg.EV, sg.DICT) + """
SELECT feature_idx, a, b, concat(a, '→', b) AS feature FROM bi
WHERE a IN (SELECT syscall_name FROM ev) AND b IN (SELECT syscall_name FROM ev)""")
def bigram_dictionary(spark, sf):
    seen = ev(spark, sf).select(F.col("syscall_name").alias("token")).distinct()
    return pair_dictionary(sg.VOCAB.table(spark).join(seen, "token", "left_semi"))


@query(sg.with_sql(sg.EV) + """
SELECT event_id, CASE WHEN value / 500.0 >= 0.1 THEN 1 ELSE 0 END AS offline,
       CASE WHEN value / 500.0 > 0.1 THEN 1 ELSE 0 END AS live
FROM ev""")
def threshold_decision(spark, sf):
    p = F.col("value") / sg.SCORE_SCALE
    return ev(spark, sf).select(
        "event_id", sc.decide(p, 0.1).alias("offline"), sc.decide(p, 0.1, strict=True).alias("live")
    )


# --- joins -------------------------------------------------------------------

@query(sg.with_sql(sg.EV, sg.TIMELINE) + """
SELECT event_id, CASE WHEN cgroup_id = 3 THEN 1 ELSE 0 END AS label,
       CASE WHEN cgroup_id <> 3 THEN '' ELSE coalesce(technique, 'unattributed') END AS technique
FROM ev LEFT JOIN tl ON timestamp_ns BETWEEN start_ns AND end_ns""")
def technique_interval_join(spark, sf):
    e = ev(spark, sf)
    return iv.label_events(e, sg.ATTACK_CGROUP, sg.timeline(e)).select("event_id", "label", "technique")


@query(sg.with_sql(sg.EV, sg.RULE_LINES, sg.RULE_ALERTS, sg.OVERLAPPING) + """
SELECT event_id, rule, (SELECT arg_min(o.technique, o.ordinal) FROM otl o
                        WHERE a.time_ns BETWEEN o.start_ns AND o.end_ns) AS technique
FROM alerts_a a""")
def alert_first_match(spark, sf):
    return sg.attributed_rule_alerts(ev(spark, sf)).select("event_id", "rule", "technique")


@query(sg.with_sql(sg.EV, sg.RULE_LINES, sg.RULE_ALERTS, sg.OVERLAPPING) + """
SELECT coalesce(technique, 'benign') AS technique, count(*) AS n_alerts FROM (
  SELECT (SELECT arg_min(o.technique, o.ordinal) FROM otl o
          WHERE a.time_ns BETWEEN o.start_ns AND o.end_ns) AS technique FROM alerts_a a)
GROUP BY 1""")
def alerts_by_technique(spark, sf):
    return rp.alerts_by_technique(sg.attributed_rule_alerts(ev(spark, sf)))


@query(sg.with_sql(sg.EV, sg.RULE_LINES, sg.RULE_ALERTS) + " SELECT rule, count(*) AS n FROM alerts_a GROUP BY rule")
def alerts_by_rule(spark, sf):
    return rp.value_counts(feeds.parse_rule_alerts(sg.rule_lines(ev(spark, sf))), "rule")


@query(sg.with_sql(sg.EV, sg.SIGNATURE_LINES, sg.SIGNATURE_ALERTS) + """
SELECT concat(signature_id, ': ', signature_name) AS signature, count(*) AS total,
       count(*) FILTER (cgroup_id = 3) AS attack, count(*) FILTER (cgroup_id <> 3) AS benign
FROM alerts_b GROUP BY 1""")
def signature_attribution(spark, sf):
    alerts = feeds.parse_signature_alerts(sg.signature_lines(ev(spark, sf)))
    return rp.signature_attribution(alerts, sg.ATTACK_CGROUP)


@query(sg.with_sql(sg.EV) + """
SELECT event_id, comm, 'known' AS kind FROM ev WHERE comm IN ('app3', 'app5', 'app7')
UNION ALL SELECT event_id, comm, 'kept' FROM ev WHERE comm NOT IN ('app11')""")
def semi_anti(spark, sf):
    known = small_table(spark, [(c,) for c in KNOWN], "comm string")
    dropped = small_table(spark, [(c,) for c in sg.DENYLIST], "comm string")
    return iv.semi_anti(ev(spark, sf).select("event_id", "comm"), known, dropped)


@query(sg.with_sql(sg.EV) + """
SELECT count(*) AS n_rows, count(*) FILTER (cgroup_id <> 3) AS n_normal, count(*) FILTER (cgroup_id = 3) AS n_attack,
       round(count(*) FILTER (cgroup_id = 3) * 100.0 / count(*), 6) AS attack_pct, session_id
FROM ev GROUP BY session_id""")
def class_counts(spark, sf):
    e = ev(spark, sf).withColumn("label", sc.event_label(F.col("cgroup_id"), sg.ATTACK_CGROUP))
    return rp.class_counts(e, sg.KEYS).withColumn("attack_pct", F.round("attack_pct", 6))


@query(sg.with_sql(sg.EV) + """
SELECT comm, count(*) AS n FROM ev GROUP BY comm""")
def value_counts(spark, sf):
    return rp.value_counts(ev(spark, sf), "comm")


@query(sg.with_sql(sg.EV, sg.TIMELINE) + """
SELECT technique, count(*) AS n FROM (
  SELECT coalesce(technique, 'unattributed') AS technique
  FROM ev LEFT JOIN tl ON timestamp_ns BETWEEN start_ns AND end_ns WHERE cgroup_id = 3)
GROUP BY technique""")
def attack_events_by_technique(spark, sf):
    e = ev(spark, sf)
    labeled = iv.label_events(e, sg.ATTACK_CGROUP, sg.timeline(e)).where("label = 1")
    return rp.value_counts(labeled, "technique")


@query(sg.with_sql(sg.EV) + """
SELECT n_known, n_attack, round(n_attack * 100.0 / n_known, 6) AS attack_pct,
       CASE WHEN n_known = 0 THEN 'none seen' WHEN n_attack * 100.0 / n_known < 95 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT count(*) AS n_known, count(*) FILTER (cgroup_id = 3) AS n_attack FROM ev
      WHERE comm IN ('app3', 'app5', 'app7'))""")
def label_crosscheck(spark, sf):
    e = ev(spark, sf).withColumn("label", sc.event_label(F.col("cgroup_id"), sg.ATTACK_CGROUP))
    return rp.label_crosscheck(e, KNOWN).withColumn("attack_pct", F.round("attack_pct", 6))


@query(sg.with_sql(sg.EV) + """
SELECT session_id, round(el, 2) AS duration_s, n AS total_events, round(n / greatest(el, 0.001), 2) AS events_per_sec,
       unique_pids, unique_uids, dist AS distribution
FROM (SELECT session_id, (max(timestamp_ns) - min(timestamp_ns)) / 1000000000.0 AS el, count(*) AS n,
             count(DISTINCT pid) AS unique_pids, count(DISTINCT uid) AS unique_uids FROM ev GROUP BY session_id)
JOIN (SELECT session_id, string_agg(concat(syscall_name, '=', c), ',' ORDER BY syscall_name) AS dist
      FROM (SELECT session_id, syscall_name, count(*) AS c FROM ev GROUP BY ALL) GROUP BY session_id)
USING (session_id)""")
def session_summary(spark, sf):
    """Summaries as a capture writes them at its end, read back from the store."""
    made = rp.session_summary(ev(spark, sf))
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    src.write_summary(made, path)
    pairs = F.transform(F.map_entries("syscall_distribution"), lambda p: F.concat_ws("=", p["key"], p["value"].cast("string")))
    return spark.read.schema(made.schema).json(path).withColumn("distribution", F.array_join(F.array_sort(pairs), ",")).drop(
        "syscall_distribution"
    )


@query(sg.with_sql(sg.EV) + """
SELECT session_id, syscall_name, n, round(n * 100.0 / sum(n) OVER (PARTITION BY session_id), 6) AS pct
FROM (SELECT session_id, syscall_name, count(*) AS n FROM ev GROUP BY ALL)""")
def name_distribution(spark, sf):
    return rp.name_distribution(ev(spark, sf)).withColumn("pct", F.round("pct", 6))


@query(sg.with_sql(sg.EV) + """
SELECT DISTINCT 'pid' AS "column", CAST(pid AS VARCHAR) AS value FROM ev
UNION SELECT DISTINCT 'uid', CAST(uid AS VARCHAR) FROM ev
UNION SELECT DISTINCT 'syscall_name', syscall_name FROM ev""")
def distinct_values(spark, sf):
    return rp.distinct_values(ev(spark, sf), ["pid", "uid", "syscall_name"])
