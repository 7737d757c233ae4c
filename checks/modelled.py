"""Queries over models and streams. Streams are checked by SQL, models by rows."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import surrogate as sg
from checks.arrivals import DAY_MS, IN_ORDER, SHUFFLED, SHUFFLED_SQL, arriving, slice_sql
from checks.sequences import bags, labeled, spine_sql
from windrow.functions.weights import Idf
from windrow.models import forest as rf
from windrow.models.isolation import CONTAMINATION, train_isolation_forest
from windrow.operators import reports as rp
from windrow.operators import sampling as sp
from windrow.operators.metrics import ranking_quality
from windrow.plans import evaluate as evaluation
from windrow.plans import train as training
from windrow.storage import materialize, shared_dir
from windrow.streaming import ingest, keyed, scoring

QUERIES, ORACLE = {}, {}
KEY = ["session_id", "window_id"]
N = sg.VOCAB.n_features(2)
HOUR = 3_600_000_000_000


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# --- models ------------------------------------------------------------------------

def vectors(spark, sf):
    """Weighted windows of both sessions; session 1 trains, session 2 tests."""
    windows = materialize(bags(spark, sf), "windows")
    idf = Idf.fit(windows.where("session_id = 1"), N)
    return materialize(training.to_vectors(windows, N, idf).select(*KEY, "label", "features"), "vectors")


def fitted(spark, sf):
    v = vectors(spark, sf)
    balanced = sp.undersample(v.where("session_id = 1"), KEY, 2.0)
    return rf.train_forest(balanced), v


# A model's numbers depend on its random draws, so the SQL states what must hold for any draw: which
# rows there are, their labels, and that every value keeps its rule.
FEATURES = sg.with_sql(sg.EV, sg.DICT)
WINDOWS = sg.with_sql(sg.SEQ, sg.WIN)


@query(FEATURES + " SELECT feature_idx, feature, true AS in_range, 1.0::DOUBLE AS total FROM feat")
def rf_train(spark, sf):
    """Importance of every feature in the fitted forest: between 0 and 1, together 1."""
    model, _ = fitted(spark, sf)
    found = rf.importances(model, sg.VOCAB, 2, spark)
    return found.select(
        "feature_idx", "feature", F.col("importance").between(0, 1).alias("in_range"),
        F.round(F.sum("importance").over(Window.partitionBy()), 9).alias("total"))


@query(WINDOWS + """
SELECT session_id, window_id, label, true AS in_range, true AS pred_follows, true AS better_than_chance FROM wlab WHERE session_id = 2""")
def rf_score(spark, sf):
    """Every test window scored: a probability, the prediction it implies, and a ranking that tells the classes apart."""
    model, v = fitted(spark, sf)
    scored = materialize(
        rf.score_forest(model, v.where("session_id = 2")).select(*KEY, "label", "probability", "pred"), "scored")
    better = ranking_quality(scored).first()["auc"] > 0.5
    return scored.select(
        *KEY, "label", F.col("probability").between(0, 1).alias("in_range"),
        (F.col("pred") == (F.col("probability") >= 0.5).cast("int")).alias("pred_follows"), F.lit(better).alias("better_than_chance"))


@query()
def rf_importance(spark, sf):
    model, _ = fitted(spark, sf)
    return rp.top_by_importance(rf.importances(model, sg.VOCAB, 2, spark), 5)


@query("""
SELECT (t.i * 9 + d.i * 3 + l.i)::INTEGER AS ordinal, t.v::INTEGER AS trees, d.v::INTEGER AS depth, l.v::INTEGER AS leaf, true AS in_range
FROM (VALUES (0, 100), (1, 200), (2, 300)) t(i, v), (VALUES (0, 30), (1, 10), (2, 20)) d(i, v), (VALUES (0, 1), (1, 2), (2, 5)) l(i, v)""")
def rf_grid(spark, sf):
    """The whole search of 27 points, each cross-validated over three folds."""
    v = vectors(spark, sf).where("session_id = 1")
    _, results = rf.cross_validate(v, KEY, grid=rf.FOREST_GRID, folds=3)
    rows = [
        (i, p["numTrees"], p["maxDepth"], p["minInstancesPerNode"], 0 <= float(m) <= 1 and 0 <= float(d) <= 0.5)
        for i, (p, m, d) in enumerate(results)
    ]
    return spark.createDataFrame(rows, "ordinal int, trees int, depth int, leaf int, in_range boolean")


@query()
def window_grid(spark, sf):
    """Every stride of two window sizes, cross-validated with the search's own forests."""
    return training.tune_windows(labeled(spark, sf), sg.VOCAB, [20, 40], per_pid=False, ngram=2, min_attack_frac=sg.FRAC)


@query()
def cross_session_eval(spark, sf):
    """All window sizes, trained on one session and tested on the other."""
    e = labeled(spark, sf)
    return evaluation.cross_session(e.where("session_id = 1"), e.where("session_id = 2"), sg.VOCAB, min_attack_frac=0.1)


@query("""
SELECT name, value::DOUBLE AS value, true AS in_range
FROM (VALUES ('window', 20), ('stride', 10), ('ngram', 2), ('features', 16), ('cv_f1', NULL), ('auc', NULL), ('f1', NULL)) f(name, value)""")
def detector_overview(spark, sf):
    """How a stored detector was made, and that what it reaches on its stored test windows is a share.

    Trained, cross-validated, saved with its split and read back.
    """
    run = run_folder(spark)
    detector, _, _ = training.train(
        labeled(spark, sf), sg.VOCAB, window=sg.W, stride=sg.S, per_pid=False, ngram=2, tfidf=True, balance_ratio=2.0,
        min_attack_frac=sg.FRAC, split_path=f"{run}/split")
    detector.save(spark, f"{run}/model")
    facts = evaluation.evaluate_saved(spark, f"{run}/model", f"{run}/split")["overview"]
    reached = F.col("name").isin("cv_f1", "auc", "f1")
    return facts.select(
        "name", F.when(~reached, F.col("value")).alias("value"), (~reached | F.col("value").between(0, 1)).alias("in_range"))


@query(WINDOWS + " SELECT session_id, window_id, true AS same FROM wlab WHERE session_id = 2")
def model_roundtrip(spark, sf):
    """Scores of a detector before saving and after loading are the same."""
    model, v = fitted(spark, sf)
    path = f"{shared_dir(spark)}/detector-{uuid.uuid4().hex}"
    saved = rf.Detector(model, list(sg.VOCAB.tokens), sorted(sg.VOCAB.critical), sg.W, sg.S, False, 2)
    saved.save(spark, path)
    loaded = rf.Detector.load(spark, path)
    test = v.where("session_id = 2")
    before = rf.score_forest(saved.model, test).select(*KEY, F.col("probability").alias("before"))
    after = rf.score_forest(loaded.model, test).select(*KEY, F.col("probability").alias("after"))
    return before.join(after, KEY).select(*KEY, (F.col("before") == F.col("after")).alias("same"))


def arrays(spark, sf):
    return vectors(spark, sf).select(*KEY, "label", vector_to_array("features").alias("x"))


@query(WINDOWS + " SELECT count(*) AS n_windows, true AS share_as_asked FROM wlab WHERE session_id = 1 AND label = 0")
def iforest_train(spark, sf):
    """Normal training windows above the fitted offset: the share asked for."""
    normal = arrays(spark, sf).where("session_id = 1 AND label = 0")
    model = train_isolation_forest(normal, KEY)
    flagged = model.score(normal)
    return flagged.agg(
        F.count(F.lit(1)).alias("n_windows"), (F.abs(F.avg("pred") - CONTAMINATION) < 0.01).alias("share_as_asked"))


@query(WINDOWS + " SELECT session_id, window_id, label, true AS in_range, true AS pred_follows FROM wlab WHERE session_id = 2")
def iforest_score(spark, sf):
    """Every test window scored: an anomaly is what lies above the offset."""
    a = arrays(spark, sf)
    model = train_isolation_forest(a.where("session_id = 1 AND label = 0"), KEY)
    return model.score(a.where("session_id = 2")).select(
        *KEY, "label", F.col("score").between(-1, 1).alias("in_range"),
        (F.col("pred") == (F.col("score") > 0).cast("int")).alias("pred_follows"))


@query(WINDOWS + " SELECT session_id, window_id, label, true AS uncorrelated FROM wlab")
def project_2d(spark, sf):
    """All windows on two components, which share no variance."""
    flat = materialize(rf.project_2d(vectors(spark, sf), [*KEY, "label"]), "projected")
    spread = flat.agg(F.abs(F.covar_pop("x", "y")).alias("c"), F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    return flat.select(*KEY, "label", F.lit(spread["c"] <= 1e-9 * max(1.0, spread["x"] * spread["y"])).alias("uncorrelated"))


# --- streams -------------------------------------------------------------------------

def stream(spark, sf):
    """The events table arriving in four batches, mapped to the log view."""
    return arriving(spark, sf, f"{run_folder(spark)}/files")


def run_folder(spark):
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@query(sg.with_sql(sg.EV) + " SELECT event_id, session_id, pid, syscall_name, timestamp_ns FROM ev")
def stream_ingest(spark, sf):
    """Events stored by session, read back."""
    run = run_folder(spark)
    ingest.store_events(stream(spark, sf), f"{run}/store", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/store").select("event_id", "session_id", "pid", "syscall_name", "timestamp_ns")


@query(sg.with_sql(sg.EV) + " SELECT event_id, session_id, pid, false AS scored FROM ev UNION ALL SELECT event_id, session_id, pid, true FROM ev")
def stream_store_and_score(spark, sf):
    """Each batch stored and handed to a scorer, which keeps what it was given."""
    run = run_folder(spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{run}/scored/batch={batch_id}")

    ingest.store_and_score(stream(spark, sf), f"{run}/checkpoint", store=f"{run}/store", score=keep).awaitTermination()
    sides = [spark.read.parquet(f"{run}/{name}/*").select("event_id", "session_id", "pid", F.lit(name == "scored").alias("scored")) for name in ("store", "scored")]
    return sides[0].union(sides[1])


@query(sg.with_sql(sg.EV) + " SELECT session_id, syscall_name, count(*) AS n FROM ev GROUP BY ALL")
def stream_counters(spark, sf):
    run = run_folder(spark)

    def latest(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{run}/counts/{batch_id}")

    q = (
        ingest.running_names(stream(spark, sf)).writeStream.outputMode("complete").foreachBatch(latest)
        .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{run}/counts/{q.lastProgress['batchId']}")


@query(sg.with_sql(sg.EV) + """
SELECT session_id, count(*) AS n_events, count(DISTINCT pid) AS unique_pids, count(DISTINCT uid) AS unique_uids FROM ev GROUP BY session_id""")
def stream_exact_counters(spark, sf):
    """Exact numbers after the last batch, from bitmaps joined batch by batch."""
    run = run_folder(spark)
    counters = ingest.ExactCounters(f"{run}/counts", f"{run}/state")
    q = ingest.store_and_score(stream(spark, sf), f"{run}/checkpoint", score=counters)
    q.awaitTermination()
    return spark.read.parquet(f"{run}/counts/{q.lastProgress['batchId']}")


def released(spark, sf, arrival=IN_ORDER, delay_ms=0, bucket_ms=8 * DAY_MS):
    """Windows and late events of the stream, released by the watermark."""
    run = run_folder(spark)
    live = scoring.live_events(arriving(spark, sf, f"{run}/files", arrival, heartbeat=True), sg.DENYLIST)
    windows = keyed.released_windows(
        live, sg.VOCAB, keys=sg.PID_KEYS, window=sg.W, delay_ms=delay_ms, bucket_ms=bucket_ms, risky=["error", "purchase"])
    keyed.start_released(windows, f"{run}/windows", f"{run}/late", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/windows/*"), spark.read.parquet(f"{run}/late/*")


@query(sg.with_sql(sg.SEQ) + """
SELECT session_id, pid, pseq AS end_seq, event_id, CAST(least(pseq + 1, 20) AS INTEGER) AS n_tokens FROM seq
WHERE pseq >= 19 OR (pseq >= 2 AND syscall_name IN ('error', 'purchase'))""")
def stream_per_key(spark, sf):
    """Windows of processes over four batches in order."""
    return released(spark, sf)[0].select("session_id", "pid", "end_seq", "event_id", F.size("tokens").alias("n_tokens"))


# A row is late if the day it happened on had ended a day before the latest event of earlier batches.
ARRIVED = sg.with_sql(sg.EV) + f""",
lab AS (SELECT * FROM ev WHERE comm <> 'app11'),
arrived AS (SELECT *, {slice_sql(SHUFFLED_SQL.replace('ts', 'timestamp_human'))} AS slice FROM lab),
latest AS (SELECT slice, max(timestamp_ns // 1000000) AS ms FROM arrived GROUP BY slice),
marks AS (SELECT a.slice, coalesce(max(b.ms), {DAY_MS}) - {DAY_MS} AS mark FROM latest a LEFT JOIN latest b ON b.slice < a.slice GROUP BY a.slice),
judged AS (
  SELECT arrived.*, (timestamp_ns // 1000000 // {DAY_MS} + 1) * {DAY_MS} <= mark AS late FROM arrived JOIN marks USING (slice)),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, pid ORDER BY timestamp_ns, tid, event_id) - 1 AS pseq
  FROM judged WHERE NOT late)"""


@query(ARRIVED + """
SELECT session_id, pid, pseq AS end_seq, event_id, CAST(least(pseq + 1, 20) AS INTEGER) AS n_tokens, false AS late FROM seq
WHERE pseq >= 19 OR (pseq >= 2 AND syscall_name IN ('error', 'purchase'))
UNION ALL SELECT session_id, pid, -1, event_id, 0, true FROM judged WHERE late""")
def stream_out_of_order(spark, sf):
    """Windows of a stream that arrives out of order, and the late events of the side table."""
    windows, late = released(spark, sf, SHUFFLED, delay_ms=DAY_MS, bucket_ms=DAY_MS)
    cols = ["session_id", "pid", "end_seq", "event_id", "n_tokens", "late"]
    found = windows.withColumns({"n_tokens": F.size("tokens"), "late": F.lit(False)}).select(*cols)
    return found.union(late.withColumns(
        {"end_seq": F.lit(-1).cast("long"), "n_tokens": F.lit(0), "late": F.lit(True)}).select(*cols))


@query(sg.with_sql(sg.SEQ, sg.DICT) + """,
trig AS (SELECT session_id, pid, pseq AS end_seq FROM seq
         WHERE pseq >= 19 OR (pseq >= 2 AND syscall_name IN ('error', 'purchase'))),
em AS (SELECT t.*, s.pseq, s.syscall_name,
              lag(s.syscall_name) OVER (PARTITION BY t.session_id, t.pid, t.end_seq ORDER BY s.pseq) AS prev
       FROM trig t JOIN seq s ON s.session_id = t.session_id AND s.pid = t.pid AND s.pseq BETWEEN t.end_seq - 19 AND t.end_seq)
SELECT session_id, pid, end_seq, feature_idx, count(*) AS cnt FROM (
  SELECT em.*, idx AS feature_idx FROM em JOIN voc ON token = syscall_name
  UNION ALL SELECT em.*, feature_idx FROM em JOIN bi ON a = prev AND b = syscall_name)
GROUP BY ALL""")
def stream_parity(spark, sf):
    """Counts of the stream's windows; the SQL counts them from the definition."""
    bagged = scoring.token_bags(released(spark, sf)[0], sg.VOCAB, 2)
    return bagged.select(*sg.PID_KEYS, "end_seq", F.explode("bag").alias("feature_idx", "cnt"))


def critical_share(window):
    """Stand-in for a model: the share of critical tokens in the window."""

    def score(windows):
        counts = [F.coalesce(F.try_element_at("bag", F.lit(i)), F.lit(0)) for i in (1, 2)]
        weights = F.transform_values("bag", lambda k, v: v.cast("double"))
        return windows.withColumn("probability", (counts[0] + counts[1]) / F.lit(float(window))).withColumn("weights", weights)

    return score


@query(spine_sql(["session_id"], 30, 7, phase=5).replace(
    "SELECT w.session_id, w.window_id, w.start_seq, w.end_seq, max(s.timestamp_ns) AS close_ts,",
    "SELECT w.session_id, w.window_id, w.start_seq, w.end_seq, close_ts FROM (SELECT w.session_id, w.window_id, w.start_seq, w.end_seq, max(s.timestamp_ns) AS close_ts,") + ") w")
def stream_global(spark, sf):
    run = run_folder(spark)

    def then(windows, batch_id):
        windows.write.mode("overwrite").parquet(f"{run}/windows/{batch_id}")

    fold = scoring.StreamWindows(sg.VOCAB, then, state=f"{run}/state", window=30, stride=7, ngram=2)
    live = scoring.live_events(stream(spark, sf), sg.DENYLIST)
    ingest.store_and_score(live, f"{run}/checkpoint", score=fold).awaitTermination()
    return spark.read.parquet(f"{run}/windows/*").select("session_id", "window_id", "start_seq", "end_seq", "close_ts")


REPLAY = sg.with_sql(sg.SEQ).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
lw AS (SELECT session_id, (seq - 34) // 7 AS window_id, seq - 29 AS start_seq, seq AS end_seq, timestamp_ns AS t, event_id
       FROM seq WHERE seq >= 34 AND (seq - 34) % 7 = 0),
an AS (SELECT w.session_id, w.window_id, w.t, w.event_id FROM lw w
       JOIN seq s ON s.session_id = w.session_id AND s.seq BETWEEN w.start_seq AND w.end_seq
       GROUP BY ALL HAVING count(*) FILTER (s.syscall_name IN ('error', 'purchase')) / 30.0 > 0.5),
nxt AS (SELECT a.*, (SELECT min(n.t) FROM an n WHERE n.session_id = a.session_id AND n.t >= a.t + {6 * HOUR}) AS nt FROM an a),
fired AS (SELECT session_id, min(t) AS t FROM an GROUP BY session_id
          UNION ALL SELECT f.session_id, n.nt FROM fired f JOIN nxt n ON n.session_id = f.session_id AND n.t = f.t WHERE n.nt IS NOT NULL)
SELECT session_id, window_id, event_id, t AS close_ts FROM fired JOIN an USING (session_id, t)"""


@query(REPLAY)
def replay_alerts(spark, sf):
    fired = scoring.replay(
        labeled(spark, sf), sg.VOCAB, critical_share(30), keys=sg.KEYS, window=30, stride=7, ngram=1, cooldown_ns=6 * HOUR
    )
    return fired.select("session_id", "window_id", "event_id", "close_ts")


@query(REPLAY)
def stream_alerts(spark, sf):
    """The replay's alerts, raised by the streaming scorer."""
    run = run_folder(spark)
    writer = scoring.AlertWriter(
        critical_share(30), out=f"{run}/alerts", state=f"{run}/fired", cooldown_ns=6 * HOUR, keys=sg.KEYS, clock="close_ts"
    )
    fold = scoring.StreamWindows(sg.VOCAB, writer, state=f"{run}/state", window=30, stride=7, ngram=1)
    live = scoring.live_events(stream(spark, sf), sg.DENYLIST)
    ingest.store_and_score(live, f"{run}/checkpoint", score=fold).awaitTermination()
    return spark.read.parquet(f"{run}/alerts/*").select("session_id", "window_id", "event_id", "close_ts")


PROCESS_REPLAY = sg.with_sql(sg.SEQ).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
trig AS (SELECT session_id, pid, pseq AS end_seq, event_id, timestamp_ns AS t FROM seq
         WHERE pseq >= 19 OR (pseq >= 2 AND syscall_name IN ('error', 'purchase'))),
an AS (SELECT g.session_id, g.pid, g.end_seq, g.event_id, g.t FROM trig g
       JOIN seq s ON s.session_id = g.session_id AND s.pid = g.pid AND s.pseq BETWEEN g.end_seq - 19 AND g.end_seq
       GROUP BY ALL HAVING count(*) FILTER (s.syscall_name IN ('error', 'purchase')) / 20.0 > 0.3),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pid, t ORDER BY event_id) AS r FROM an) WHERE r = 1),
nxt AS (SELECT a.*, (SELECT min(n.t) FROM firsts n WHERE n.session_id = a.session_id AND n.pid = a.pid AND n.t >= a.t + {48 * HOUR}) AS nt
        FROM firsts a),
fired AS (SELECT session_id, pid, min(t) AS t FROM firsts GROUP BY session_id, pid
          UNION ALL SELECT f.session_id, f.pid, n.nt FROM fired f
          JOIN nxt n ON n.session_id = f.session_id AND n.pid = f.pid AND n.t = f.t WHERE n.nt IS NOT NULL)
SELECT session_id, pid, end_seq, event_id, t AS close_ts FROM fired JOIN firsts USING (session_id, pid, t)"""
RISKY = ["error", "purchase"]
# The five heaviest features of each alert's window, heaviest first.
NAMED_ALERTS = PROCESS_REPLAY.replace(
    "SELECT session_id, pid, end_seq, event_id, t AS close_ts FROM fired", """,
alerts AS (SELECT session_id, pid, end_seq, event_id, t AS close_ts FROM fired""").replace(
    "WHERE n.nt IS NOT NULL)\n,", "WHERE n.nt IS NOT NULL),") + """),
weighed AS (
  SELECT a.*, v.idx, v.token, count(*) AS c FROM alerts a
  JOIN seq s ON s.session_id = a.session_id AND s.pid = a.pid AND s.pseq BETWEEN a.end_seq - 19 AND a.end_seq
  JOIN (VALUES (0, 'click'), (1, 'purchase'), (2, 'error'), (3, 'view')) v(idx, token) ON v.token = s.syscall_name GROUP BY ALL)
SELECT session_id, pid, end_seq, event_id, close_ts, string_agg(concat(token, '=', c, '.00'), ',' ORDER BY c DESC, idx) AS top_features
FROM weighed GROUP BY ALL"""


@query(NAMED_ALERTS)
def replay_process_alerts(spark, sf):
    fired = scoring.replay_processes(
        labeled(spark, sf), sg.VOCAB, critical_share(20), keys=sg.PID_KEYS, window=20, ngram=1, risky=RISKY,
        cooldown_ns=48 * HOUR, threshold=0.3,
    )
    return fired.select("session_id", "pid", "end_seq", "event_id", "close_ts", F.concat_ws(",", "top_features").alias("top_features"))


@query(NAMED_ALERTS)
def stream_process_alerts(spark, sf):
    """The same alerts, raised live."""
    run = run_folder(spark)
    writer = scoring.AlertWriter(
        critical_share(20), out=f"{run}/alerts", state=f"{run}/fired", cooldown_ns=48 * HOUR, keys=sg.PID_KEYS, threshold=0.3,
        clock="close_ts",
    )
    live = scoring.live_events(stream(spark, sf), sg.DENYLIST)
    scoring.start_process_alerts(
        live, sg.VOCAB, writer, f"{run}/checkpoint", keys=sg.PID_KEYS, window=20, ngram=1, risky=RISKY).awaitTermination()
    return spark.read.parquet(f"{run}/alerts/*").select(
        "session_id", "pid", "end_seq", "event_id", "close_ts", F.concat_ws(",", "top_features").alias("top_features"))
