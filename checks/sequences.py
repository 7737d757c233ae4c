"""Checked queries over ordered events: numbering, windows, bursts, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import surrogate as sg
from windrow.functions import scalars as sc
from windrow.functions.weights import Idf, idf_table
from windrow.operators import cooldown as cd
from windrow.operators import intervals as iv
from windrow.operators import reports as rp
from windrow.operators import windows as wn
from windrow.operators.ordered import ordered_scan
from windrow.schema import EVENT_ORDER
from windrow.storage import materialize

QUERIES, ORACLE = {}, {}
HOUR = 3_600_000_000_000


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def labeled(spark, sf, timeline=False):
    e = sc.drop_comms(sg.events_view(spark, sf), sg.DENYLIST)
    if timeline:
        return iv.label_events(e, sg.ATTACK_CGROUP, sg.timeline(e))
    return e.withColumn("label", sc.event_label(F.col("cgroup_id"), sg.ATTACK_CGROUP))


def numbered(spark, sf, keys=sg.KEYS, carry=("label",), timeline=False):
    return wn.number_events(labeled(spark, sf, timeline), sg.VOCAB, keys=keys, carry=list(carry))


def bags(spark, sf, keys=sg.KEYS, window=sg.W, stride=sg.S, **kw):
    kw.setdefault("min_attack_frac", sg.FRAC)
    kw.setdefault("ngram", 2)
    return wn.bag_windows(numbered(spark, sf, keys), sg.VOCAB, keys=keys, window=window, stride=stride, **kw)


def spine_sql(keys, w, s, phase=0, seq="seq"):
    """Windows and their labels straight from the definition, for any W, S and phase."""
    k = ", ".join(keys)
    wk = ", ".join(f"w.{c}" for c in keys)
    on = " AND ".join(f"w.{c} = s.{c}" for c in keys)
    return sg.with_sql(sg.SEQ) + f"""
    SELECT {wk}, w.window_id, w.start_seq, w.end_seq, max(s.timestamp_ns) AS close_ts,
           CAST(sum(s.label) AS BIGINT) AS attack_events,
           CASE WHEN sum(s.label) >= 1 AND sum(s.label) >= {sg.FRAC * w} THEN 1 ELSE 0 END AS label
    FROM (SELECT {k}, ({seq} - {w - 1} - {phase}) // {s} AS window_id, {seq} - {w - 1} AS start_seq, {seq} AS end_seq
          FROM seq WHERE {seq} >= {w - 1 + phase} AND ({seq} - {w - 1} - {phase}) % {s} = 0) w
    JOIN seq s ON {on} AND s.{seq} BETWEEN w.start_seq AND w.end_seq
    GROUP BY {wk}, w.window_id, w.start_seq, w.end_seq"""


NUMBERING = "row_number() OVER (PARTITION BY {} ORDER BY timestamp_ns, tid, event_id) - 1 AS seq"


@query(sg.with_sql(sg.EV) + f" SELECT event_id, session_id, {NUMBERING.format('session_id')} FROM ev")
def global_seq(spark, sf):
    e = sg.events_view(spark, sf)
    return ordered_scan(e, sg.KEYS, EVENT_ORDER, seq="seq").select("event_id", "session_id", "seq")


@query(sg.with_sql(sg.EV) + " SELECT event_id, row_number() OVER (ORDER BY timestamp_ns, tid, event_id) - 1 AS seq FROM ev")
def merged_seq(spark, sf):
    """One sequence over all captures together."""
    e = sg.events_view(spark, sf)
    return ordered_scan(e, [], EVENT_ORDER, seq="seq", chunks=16).select("event_id", "seq")


@query(sg.with_sql(sg.EV) + f" SELECT event_id, session_id, pid, {NUMBERING.format('session_id, pid')} FROM ev")
def per_key_seq(spark, sf):
    e = sg.events_view(spark, sf)
    return ordered_scan(e, sg.PID_KEYS, EVENT_ORDER, seq="seq").select("event_id", "session_id", "pid", "seq")


@query(spine_sql(["session_id"], sg.W, sg.S))
def count_windows(spark, sf):
    return bags(spark, sf).drop("bag")


@query(spine_sql(["session_id"], 30, 7))
def uneven_windows(spark, sf):
    return bags(spark, sf, window=30, stride=7).drop("bag")


@query(spine_sql(["session_id"], 10, 25))
def sparse_windows(spark, sf):
    return bags(spark, sf, window=10, stride=25).drop("bag")


@query(spine_sql(["session_id"], 30, 7, phase=5))
def live_stream_windows(spark, sf):
    """The windows a live scorer of the whole stream fires on."""
    return bags(spark, sf, window=30, stride=7, phase=wn.live_phase(30, 7)).drop("bag")


@query(spine_sql(["session_id", "pid"], sg.W, sg.S, seq="pseq"))
def process_windows(spark, sf):
    return bags(spark, sf, keys=sg.PID_KEYS).drop("bag")


@query(spine_sql(["session_id", "pid"], 20, 1, seq="pseq"))
def live_process_windows(spark, sf):
    """The windows a live per-process scorer fires on once its buffer is full."""
    return bags(spark, sf, keys=sg.PID_KEYS, window=20, stride=1).drop("bag")


@query(sg.with_sql(sg.SEQ, sg.WIN) + """
SELECT session_id, window_id, CAST(attack_events AS BIGINT) AS attack_events, label,
       CASE WHEN attack_events >= 1 THEN 1 ELSE 0 END AS any_attack,
       CASE WHEN attack_events >= 3 AND attack_events >= 2.0 THEN 1 ELSE 0 END AS three_attacks
FROM wlab""")
def window_label(spark, sf):
    a = F.col("attack_events")
    return bags(spark, sf).select(
        "session_id", "window_id", "attack_events", "label", wn.window_label(a, sg.W).alias("any_attack"),
        wn.window_label(a, sg.W, 3, 0.1).alias("three_attacks"),
    )


@query(sg.with_sql(sg.SEQ, sg.DICT, sg.WIN, sg.BAG) + " SELECT * FROM bag WHERE feature_idx < 4")
def unigram_counts(spark, sf):
    return wn.long_features(bags(spark, sf, ngram=1), sg.KEYS)


@query(sg.with_sql(sg.SEQ, sg.DICT, sg.WIN, sg.BAG) + """
SELECT session_id, window_id, feature_idx, feature, cnt FROM bag JOIN feat USING (feature_idx) WHERE feature_idx >= 4""")
def bigram_counts(spark, sf):
    names = F.broadcast(sg.VOCAB.feature_table(spark, 2))
    long = wn.long_features(bags(spark, sf), sg.KEYS).where(F.col("feature_idx") >= 4)
    return long.join(names, "feature_idx")


@query(sg.with_sql(sg.SEQ, sg.DICT) + """
SELECT event_id, session_id, seq, feature_idx FROM (
  SELECT event_id, session_id, seq, syscall_name,
         lag(syscall_name) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM seq)
JOIN bi ON a = prev AND b = syscall_name""")
def bigram_pairs(spark, sf):
    n = numbered(spark, sf)
    pair = sg.VOCAB.pair_feature(F.col("prev_token"), F.col("token")).alias("feature_idx")
    return n.select("event_id", "session_id", "seq", pair).where("feature_idx IS NOT NULL")


@query(sg.with_sql(sg.SEQ, sg.WIN) + " SELECT session_id, window_id, close_ts FROM win")
def window_close(spark, sf):
    return wn.close_times(numbered(spark, sf), keys=sg.KEYS, window=sg.W, stride=sg.S)


@query(sg.with_sql(sg.SEQ, sg.WIN) + " SELECT session_id, window_id, seq, event_id FROM mem")
def window_membership(spark, sf):
    members = wn.window_members(numbered(spark, sf), keys=sg.KEYS, window=sg.W, stride=sg.S)
    return members.select("session_id", "window_id", "seq", "event_id")


LABELED_SEQ = sg.with_sql(sg.SEQ, sg.TIMELINE, sg.WIN) + """,
tseq AS (
  SELECT s.*, CASE WHEN s.label = 0 THEN '' ELSE coalesce(t.technique, 'unattributed') END AS technique
  FROM seq s LEFT JOIN tl t ON s.timestamp_ns BETWEEN t.start_ns AND t.end_ns
),
tcount AS (
  SELECT w.session_id, w.window_id, t.technique, count(*) AS c, min(t.seq) AS first_seq
  FROM win w JOIN tseq t ON t.session_id = w.session_id AND t.seq BETWEEN w.start_seq AND w.end_seq
  WHERE t.label = 1 AND t.technique <> '' GROUP BY ALL
),
dom AS (
  SELECT w.session_id, w.window_id, coalesce(c.technique, 'unattributed') AS technique
  FROM win w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id, window_id ORDER BY c DESC, first_seq) AS r
                        FROM tcount) c
    ON c.session_id = w.session_id AND c.window_id = w.window_id AND c.r = 1
)"""


@query(LABELED_SEQ + " SELECT * FROM dom")
def dominant_technique(spark, sf):
    n = numbered(spark, sf, carry=("label", "technique"), timeline=True)
    return wn.dominant_technique(n, keys=sg.KEYS, window=sg.W, stride=sg.S)


# A window's probability is its share of critical tokens.
SCORED = LABELED_SEQ + """,
share AS (SELECT session_id, window_id, count(*) FILTER (syscall_name IN ('error', 'purchase')) / 20.0 AS probability
          FROM mem GROUP BY ALL),
scored AS (
  SELECT l.session_id, l.window_id, l.close_ts, l.label, s.probability,
         CASE WHEN s.probability >= 0.4 THEN 1 ELSE 0 END AS pred, d.technique
  FROM wlab l JOIN share s USING (session_id, window_id) JOIN dom d USING (session_id, window_id)
)"""


def scored_windows(spark, sf, events=None):
    events = labeled(spark, sf, timeline=True) if events is None else events
    n = wn.number_events(events, sg.VOCAB, keys=sg.KEYS, carry=["label", "technique"])
    w = wn.bag_windows(n, sg.VOCAB, keys=sg.KEYS, window=sg.W, stride=sg.S, min_attack_frac=sg.FRAC, techniques=True)
    critical = [F.coalesce(F.try_element_at("bag", F.lit(i)), F.lit(0)) for i in (1, 2)]
    p = w.withColumn("probability", (critical[0] + critical[1]) / F.lit(float(sg.W)))
    scored = p.withColumn("pred", sc.decide(F.col("probability"), 0.4))
    return scored.select("session_id", "window_id", "close_ts", "label", "probability", "pred", "technique")


@query(SCORED + " SELECT session_id, window_id, label, pred, technique, round(probability, 6) AS probability FROM scored")
def window_align(spark, sf):
    return scored_windows(spark, sf).drop("close_ts").withColumn("probability", F.round("probability", 6))


BURSTS = f"""
att AS (SELECT *, lag(timestamp_ns) OVER (PARTITION BY session_id ORDER BY timestamp_ns, tid, event_id) AS prev
        FROM tseq WHERE label = 1),
bursts AS (SELECT session_id, event_id, timestamp_ns AS onset_ts, technique FROM att
           WHERE prev IS NULL OR timestamp_ns - prev > {sg.GAP_NS})"""


@query(LABELED_SEQ + "," + BURSTS + " SELECT * FROM bursts")
def attack_bursts(spark, sf):
    return iv.attack_bursts(labeled(spark, sf, timeline=True), sg.GAP_NS)


LATENCY = """
lat AS (
  SELECT b.*, (SELECT min(s.close_ts) FROM scored s
               WHERE s.session_id = b.session_id AND s.pred = 1 AND s.close_ts >= b.onset_ts) AS alarm_ts
  FROM bursts b
),
lms AS (SELECT *, (alarm_ts - onset_ts) / 1000000.0 AS latency_ms FROM lat)"""


def latency(spark, sf):
    events = labeled(spark, sf, timeline=True)
    bursts = iv.attack_bursts(events, sg.GAP_NS)
    return iv.detection_latency(bursts, scored_windows(spark, sf, events))


@query(",".join([SCORED, BURSTS, LATENCY]) + " SELECT session_id, event_id, onset_ts, technique, coalesce(alarm_ts, -1) AS alarm_ts, round(latency_ms, 3) AS latency_ms FROM lms")
def asof_forward(spark, sf):
    return latency(spark, sf).withColumns(
        {"latency_ms": F.round("latency_ms", 3), "alarm_ts": F.coalesce("alarm_ts", F.lit(-1))}
    )


@query(",".join([SCORED, BURSTS, LATENCY]) + """
SELECT count(*) AS n_bursts, count(latency_ms) AS detected, count(*) FILTER (latency_ms IS NULL) AS missed,
       round(avg(latency_ms), 2) AS mean_ms, round(max(latency_ms), 5) AS max_ms,
       round(quantile_cont(latency_ms, 0.5), 5) AS median_ms, round(quantile_cont(latency_ms, 0.9), 5) AS p90_ms
FROM lms""")
def latency_stats(spark, sf):
    stats = rp.latency_stats(latency(spark, sf))
    return stats.withColumns({c: F.round(c, d) for c, d in (("mean_ms", 2), ("max_ms", 5), ("median_ms", 5), ("p90_ms", 5))})


@query(",".join([SCORED, BURSTS, LATENCY]) + """
SELECT technique, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 5) AS median_ms
FROM lms WHERE latency_ms IS NOT NULL GROUP BY technique""")
def latency_by_technique(spark, sf):
    return rp.latency_by_technique(latency(spark, sf)).withColumn("median_ms", F.round("median_ms", 5))


@query(SCORED + """
SELECT technique, count(*) AS n_windows, CAST(sum(pred) AS BIGINT) AS n_detected, round(sum(pred) * 1.0 / count(*), 6) AS recall
FROM scored WHERE label = 1 GROUP BY technique HAVING count(*) >= 2""")
def technique_recall(spark, sf):
    return rp.technique_recall(scored_windows(spark, sf), min_windows=2).withColumn("recall", F.round("recall", 6))


CARD = ",".join([SCORED, sg.RULE_LINES, sg.RULE_ALERTS, sg.OVERLAPPING]) + f""",
names AS (SELECT unnest({sg._NAME_LIST}) AS technique, generate_subscripts({sg._NAME_LIST}, 1) - 1 AS ordinal),
hit AS (SELECT technique, count(*) AS c FROM (
          SELECT (SELECT arg_min(o.technique, o.ordinal) FROM otl o WHERE a.time_ns BETWEEN o.start_ns AND o.end_ns) AS technique
          FROM alerts_a a) GROUP BY technique),
rec AS (SELECT technique, count(*) AS n, sum(pred) * 1.0 / count(*) AS recall FROM scored WHERE label = 1 GROUP BY technique),
card AS (SELECT ordinal, technique, CASE WHEN coalesce(hit.c, 0) > 0 THEN 'yes' ELSE 'no' END AS tool_hit,
                coalesce(rec.n, 0) AS n_windows, round(rec.recall, 6) AS recall, coalesce(rec.recall >= 0.5, false) AS model_hit
         FROM names LEFT JOIN hit USING (technique) LEFT JOIN rec USING (technique))"""


def scorecard(spark, sf):
    alerts = sg.attributed_rule_alerts(sg.events_view(spark, sf))
    return rp.technique_scorecard(alerts, rp.technique_recall(scored_windows(spark, sf)))


@query(CARD + " SELECT CAST(ordinal AS INTEGER) AS ordinal, technique, tool_hit, n_windows, recall, model_hit FROM card")
def technique_scorecard(spark, sf):
    return scorecard(spark, sf).withColumn("recall", F.round("recall", 6))


@query(CARD + """
SELECT count(*) FILTER (tool_hit = 'yes') AS tool_caught, count(*) FILTER (model_hit) AS model_caught, count(*) AS n_techniques
FROM card""")
def scorecard_totals(spark, sf):
    return rp.scorecard_totals(scorecard(spark, sf))


# --- weights -------------------------------------------------------------------

IDF = """
nwin AS (SELECT count(*) AS n FROM win),
idf AS (
  SELECT feature_idx, count(*) AS df, max(n) AS n, ln((1.0 + max(n)) / (1 + count(*))) + 1 AS idf
  FROM bag, nwin GROUP BY feature_idx
)"""
WEIGHTS = """
raw AS (SELECT session_id, window_id, feature_idx, (1 + ln(cnt)) * idf AS w FROM bag JOIN idf USING (feature_idx)),
weights AS (SELECT session_id, window_id, feature_idx, w / sqrt(sum(w * w) OVER (PARTITION BY session_id, window_id)) AS weight
            FROM raw)"""
BAGGED = sg.with_sql(sg.SEQ, sg.DICT, sg.WIN, sg.BAG, IDF, WEIGHTS)


@query(BAGGED + " SELECT feature_idx, df, n, round(idf, 6) AS idf FROM idf")
def document_frequency(spark, sf):
    return idf_table(bags(spark, sf)).withColumn("idf", F.round("idf", 6))


def weighted(spark, sf):
    w = materialize(bags(spark, sf), "windows")
    return Idf.fit(w, sg.VOCAB.n_features(2)).transform(w)


@query(BAGGED + " SELECT session_id, window_id, feature_idx, round(weight, 6) AS weight FROM weights")
def tfidf(spark, sf):
    return weighted(spark, sf).select(*sg.KEYS, "window_id", F.explode("weights").alias("feature_idx", "weight")).withColumn(
        "weight", F.round("weight", 6)
    )


@query(sg.with_sql(sg.SEQ, sg.DICT, sg.WIN, sg.BAG) + """
SELECT session_id, window_id, r AS rank, feature_idx, CAST(cnt AS DOUBLE) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, window_id ORDER BY cnt DESC, feature_idx) AS r FROM bag)
WHERE r <= 5""")
def window_top_features(spark, sf):
    w = bags(spark, sf).withColumn("weights", F.transform_values("bag", lambda k, v: v.cast("double")))
    return wn.top_features(w, sg.KEYS, "weights", 5)


@query(sg.with_sql(sg.SEQ, sg.DICT, sg.WIN, sg.BAG) + """
SELECT feature_idx, feature,
       round(coalesce(sum(cnt) FILTER (label = 0), 0) * 1.0 / (SELECT count(*) FROM wlab WHERE label = 0), 6) AS mean_normal,
       round(coalesce(sum(cnt) FILTER (label = 1), 0) * 1.0 / (SELECT count(*) FROM wlab WHERE label = 1), 6) AS mean_attack,
       round(coalesce(sum(cnt), 0) * 1.0 / (SELECT count(*) FROM wlab), 6) AS mean_all
FROM feat LEFT JOIN (SELECT bag.*, label FROM bag JOIN wlab USING (session_id, window_id)) USING (feature_idx)
GROUP BY feature_idx, feature""")
def feature_profile(spark, sf):
    means = {c: F.round(c, 6) for c in ("mean_normal", "mean_attack", "mean_all")}
    return rp.feature_profile(bags(spark, sf), sg.VOCAB, 2).withColumns(means)


@query(BAGGED + """
SELECT feature_idx, feature, importance, importance > (SELECT median(importance) FROM imp) AS above_median
FROM (SELECT feature_idx, round(df * 1.0 / n, 6) AS importance FROM idf) JOIN feat USING (feature_idx)
ORDER BY importance DESC, feature_idx LIMIT 5""".replace("(SELECT median(importance) FROM imp)", "(SELECT median(round(df * 1.0 / n, 6)) FROM idf)"))
def top_features(spark, sf):
    """Ranking rule on the share of windows holding a feature (the forest's own ranking: rf_importance)."""
    share = F.round(F.col("df") / F.col("n"), 6)
    imp = idf_table(bags(spark, sf)).select("feature_idx", share.alias("importance"))
    named = imp.join(F.broadcast(sg.VOCAB.feature_table(spark, 2)), "feature_idx")
    return rp.top_by_importance(named, 5)


# --- live scoring rules, in batch ------------------------------------------------

@query(sg.with_sql(sg.SEQ, sg.DICT) + """,
trig AS (SELECT session_id, pid, pseq AS end_seq FROM seq
         WHERE syscall_name IN ('error', 'purchase') AND pseq BETWEEN 2 AND 18),
em AS (SELECT t.*, s.pseq, s.syscall_name,
              lag(s.syscall_name) OVER (PARTITION BY t.session_id, t.pid, t.end_seq ORDER BY s.pseq) AS prev
       FROM trig t JOIN seq s ON s.session_id = t.session_id AND s.pid = t.pid AND s.pseq <= t.end_seq)
SELECT session_id, pid, end_seq, feature_idx, count(*) AS cnt FROM (
  SELECT em.*, idx AS feature_idx FROM em JOIN voc ON token = syscall_name
  UNION ALL SELECT em.*, feature_idx FROM em JOIN bi ON a = prev AND b = syscall_name)
GROUP BY ALL""")
def early_windows(spark, sf):
    n = numbered(spark, sf, keys=sg.PID_KEYS)
    risky = [sg.VOCAB.tokens.index(t) for t in ("error", "purchase")]
    found = wn.early_windows(n, keys=sg.PID_KEYS, window=sg.W, risky=risky)
    bag = wn.bag_of(F.col("tokens"), sg.VOCAB, 2)
    return found.select(*sg.PID_KEYS, "end_seq", F.explode(bag).alias("feature_idx", "cnt"))


def cooldown_sql(keys, cooldown):
    k = ", ".join(keys)
    on = " AND ".join(f"n.{c} = a.{c}" for c in keys)
    up = " AND ".join(f"n.{c} = f.{c}" for c in keys)
    return sg.with_sql(sg.EV).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    an AS (SELECT {k}, timestamp_ns AS t, arg_min(event_id, (tid, event_id)) AS event_id
           FROM ev WHERE value >= 50 GROUP BY {k}, timestamp_ns),
    nxt AS (SELECT {", ".join("a." + c for c in keys)}, a.t, a.event_id,
                   (SELECT min(n.t) FROM an n WHERE {on} AND n.t >= a.t + {cooldown}) AS nt FROM an a),
    fired AS (
      SELECT {k}, min(t) AS t FROM an GROUP BY {k}
      UNION ALL
      SELECT {", ".join("f." + c for c in keys)}, n.nt FROM fired f JOIN nxt n ON {up} AND n.t = f.t WHERE n.nt IS NOT NULL
    )
    SELECT {", ".join("f." + c for c in keys)}, n.event_id, f.t AS timestamp_ns FROM fired f JOIN nxt n ON {up} AND n.t = f.t"""


def anomalies(spark, sf):
    return sg.events_view(spark, sf).where(F.col("value") >= 50).select("session_id", "pid", *EVENT_ORDER)


@query(cooldown_sql(["session_id"], 6 * HOUR))
def alert_cooldown(spark, sf):
    fired = cd.fired_alerts(anomalies(spark, sf), 6 * HOUR, keys=sg.KEYS)
    return fired.select("session_id", "event_id", "timestamp_ns")


@query(cooldown_sql(["session_id", "pid"], 48 * HOUR))
def process_cooldown(spark, sf):
    fired = cd.fired_alerts(anomalies(spark, sf), 48 * HOUR, keys=sg.PID_KEYS)
    return fired.select("session_id", "pid", "event_id", "timestamp_ns")


@query(cooldown_sql(["session_id"], 6 * HOUR).replace(
    "SELECT f.session_id, n.event_id, f.t AS timestamp_ns FROM", "SELECT f.session_id, count(*) AS n_alerts FROM") + " GROUP BY f.session_id")
def alert_count(spark, sf):
    fired = cd.fired_alerts(anomalies(spark, sf), 6 * HOUR, keys=sg.KEYS)
    return fired.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_alerts"))
