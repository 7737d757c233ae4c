"""Live scoring: windows from a stream, probabilities, alerts with cooldown.

Two ways to keep the buffer of the last events:

* ``process_windows``: keyed state per process, scored on every event once the
  buffer is full, and early on risky calls. Keys run in parallel.
* ``StreamWindows``: for a whole machine's stream, where one key holds very many
  events. Each batch is joined with the last ``W - 1`` events kept from before
  and goes through the batch window plan, so the events of a single machine are
  still spread over all tasks.

Events keep the order of their batches; within a batch they are sorted by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from windrow.functions.scalars import decide, drop_comms
from windrow.functions.weights import raw_weights, vectorize
from windrow.models.forest import Detector, score_forest
from windrow.operators.cooldown import PROCESS_COOLDOWN_NS, fired_alerts
from windrow.operators.ordered import default_chunks, ordered_scan
from windrow.operators.windows import bag_of, bag_windows, close_times, early_windows, live_phase, number_events, top_features
from windrow.schema import EVENT_ORDER
from windrow.storage import materialize, scratch, ship_package
from windrow.streaming.buffers import SHARD, advance, in_shards, long_columns, pack, unpack, with_nulls
from windrow.streaming.versions import Versions
from windrow.vocabulary import HIGH_RISK, TRAINING_DENYLIST, Vocabulary

UNKNOWN_TOKEN = -1
ROWS_PER_YIELD = 5_000


# --- windows -----------------------------------------------------------------------

def process_windows(
    stream: DataFrame, vocab: Vocabulary, *, keys: list[str], window: int, risky: list[str] = HIGH_RISK, least: int = 3,
    order: list[str] = EVENT_ORDER, carry: list[str] = ("comm", "uid"),
) -> DataFrame:
    """Scored windows of each process: one row per trigger with the buffer's tokens.

    ``tokens`` holds vocabulary indexes, -1 for unknown tokens.
    """
    ship_package(stream.sparkSession)
    carried = [c for c in dict.fromkeys([*order, *carry]) if c not in keys]
    slim = vocab.with_index(stream, "syscall_name", "token").select(
        *keys, *carried, F.coalesce("token", F.lit(UNKNOWN_TOKEN)).alias("token")
    )
    high = np.array([vocab.tokens.index(t) for t in risky if t in vocab.tokens])

    def run(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place = unpack(state.get[0]) if state.exists else None
        rows, in_order = pd.concat(list(batches), ignore_index=True), [c for c in order if c in carried]
        at, end, tokens, after = advance(place, rows, list(keys), in_order, window, least, high)
        state.update((pack(after.drop(columns="touched")),))
        for start in range(0, len(end), ROWS_PER_YIELD):
            part = slice(start, start + ROWS_PER_YIELD)
            out = at.iloc[part][[*keys, *carried]].reset_index(drop=True)
            out["end_seq"], out["tokens"] = end[part], tokens[part]
            yield out

    schema = T.StructType(
        [slim.schema[c] for c in (*keys, *carried)]
        + [T.StructField("end_seq", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    )
    longs = long_columns(slim.schema, [*keys, *carried])
    found = in_shards(slim, keys, longs).groupBy(SHARD).applyInPandasWithState(
        run, schema, "rows binary", "append", GroupStateTimeout.NoTimeout
    )
    return with_nulls(found, longs)


def token_bags(windows: DataFrame, vocab: Vocabulary, ngram: int) -> DataFrame:
    """Add the ``bag`` of a window given by its tokens."""
    known = F.transform("tokens", lambda t: F.when(t >= 0, t))
    return windows.withColumn("_known", known).withColumn("bag", bag_of(F.col("_known"), vocab, ngram)).drop("_known")


class StreamWindows:
    """``foreachBatch`` function: windows of whole streams, handed to ``then``.

    Fires where a live scorer does: buffer full and the event count a multiple
    of the stride.
    """

    def __init__(
        self, vocab: Vocabulary, then: Callable[[DataFrame, int], None], *, state: str, window: int, stride: int,
        ngram: int = 1, keys: list[str] = ("session_id",), order: list[str] = EVENT_ORDER,
        carry: list[str] = ("pid", "comm", "uid"), chunks: int | None = None,
    ):
        self.vocab, self.then, self.state = vocab, then, Versions(state)
        self.window, self.stride, self.ngram, self.chunks = window, stride, ngram, chunks
        self.keys, self.order = list(keys), list(order)
        self.carry = [c for c in carry if c not in (*keys, *order)]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            self._advance(batch, batch_id)

    def _advance(self, batch: DataFrame, batch_id: int) -> None:
        keys, phase = self.keys, live_phase(self.window, self.stride)
        cols = [*keys, *self.order, *self.carry]
        new = self.vocab.with_index(batch, "syscall_name", "token").select(
            *cols, "token", F.lit(1).alias("_new"), F.lit(0).cast("long").alias("_base")
        )
        kept = self.state.before(batch, batch_id, new.schema)
        # The size of a batch is not known beforehand: it is written once, then cut by its bytes.
        rows = materialize(kept.unionByName(new), "batch")
        chunks = self.chunks or max(default_chunks(rows), 4 * batch.sparkSession.sparkContext.defaultParallelism)
        scanned = ordered_scan(
            rows, keys, ["_new", *self.order], seq="_place", total="_rows", lags={"prev_token": "token"},
            # The first kept event of a key carries its position in the stream.
            totals={"_from": F.col("_base"), "_held": 1 - F.col("_new")}, chunks=chunks, keep_chunk=True,
        )
        numbered = scanned.withColumns(
            {
                "seq": F.col("_from") + F.col("_place"),
                "n_total": F.col("_from") + F.col("_rows"),
                "fresh": F.col("_from") + F.col("_held"),
            }
        ).persist()  # read for the windows, their closing events and the kept tail
        shape = dict(keys=keys, window=self.window, stride=self.stride, phase=phase)
        windows = bag_windows(numbered, self.vocab, ngram=self.ngram, fresh="fresh", **shape)
        closing = close_times(numbered.where("seq >= fresh"), carry=["event_id", *self.carry], **shape)
        on = [*keys, "window_id"]
        self.then(windows.drop("label", "attack_events").join(closing.drop("close_ts"), on), batch_id)

        first_kept = F.greatest(F.col("n_total") - (self.window - 1), F.lit(0))
        tail = numbered.where(F.col("seq") >= first_kept)
        self.state.save(
            tail.select(
                *cols, "token", F.lit(0).alias("_new"),
                F.when(F.col("seq") == first_kept, F.col("seq")).otherwise(F.lit(0).cast("long")).alias("_base"),
            ),
            batch_id,
        )
        numbered.unpersist()


# --- probabilities and alerts ----------------------------------------------------------

def detector_scores(detector: Detector) -> Callable[[DataFrame], DataFrame]:
    """Bags -> fitted weights -> vectors -> probability of attack."""

    def score(windows: DataFrame) -> DataFrame:
        weighted = raw_weights(windows) if detector.idf is None else detector.idf.transform(windows)
        return score_forest(detector.model, vectorize(weighted, detector.n_features)).drop("features", "pred")

    return score


def name_top_features(alerts: DataFrame, vocab: Vocabulary, ngram: int, key: list[str], n: int = 5) -> DataFrame:
    """Add ``top_features``: names and weights of the heaviest features, as text."""
    names = F.broadcast(vocab.feature_table(alerts.sparkSession, ngram))
    ranked = top_features(alerts, key, "weights", n).join(names, "feature_idx")
    text = F.concat_ws("=", "feature", F.format_number("weight", 2))
    lists = ranked.groupBy(*key, "window_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("l"))
    top = lists.select(*key, "window_id", F.transform("l", lambda e: e["t"]).alias("top_features"))
    return alerts.join(top, [*key, "window_id"], "left")


class AlertWriter:
    """Scores windows of a batch and writes the alerts that the cooldown lets through.

    The time of the last alert of every key is kept between batches. Anomalies
    less than the cooldown after it, or before it, cannot fire and are left out;
    the others are folded by themselves. Time is event time, so a replay gives
    the same alerts at any speed. ``name`` completes the alerts of a score that gives ``weights``, as
    ``name_top_features`` does.
    """

    def __init__(
        self, score: Callable[[DataFrame], DataFrame], *, out: str, state: str, cooldown_ns: int, keys: list[str],
        threshold: float = 0.5, clock: str = "timestamp_ns", tie: str = "event_id", chunks: int | None = None,
        name: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.name = name
        self.score, self.out, self.state = score, out, Versions(state)
        self.cooldown, self.keys, self.threshold = cooldown_ns, list(keys), threshold
        self.clock, self.tie, self.chunks = clock, tie, chunks

    def __call__(self, windows: DataFrame, batch_id: int) -> None:
        scored = self.score(windows)
        anomalies = scored.where(decide(F.col("probability"), self.threshold, strict=True) == 1)
        kept = T.StructType([*[scored.schema[k] for k in self.keys], T.StructField(self.clock, T.LongType())])
        last = self.state.before(windows, batch_id, kept)
        known = last.withColumnRenamed(self.clock, "_last")
        free = anomalies.join(known, self.keys, "left").where(
            F.col("_last").isNull() | (F.col(self.clock) >= F.col("_last") + self.cooldown)
        ).drop("_last")
        fired = fired_alerts(free, self.cooldown, keys=self.keys, order=[self.clock, self.tie], chunks=self.chunks)
        if self.name and "weights" in fired.columns:
            fired = self.name(fired)
        path = f"{self.out}/batch={batch_id}"
        fired.write.mode("overwrite").parquet(path)
        done = windows.sparkSession.read.schema(fired.schema).parquet(path)
        times = done.select(*self.keys, self.clock).unionByName(last)
        self.state.save(times.groupBy(*self.keys).agg(F.max(self.clock).alias(self.clock)), batch_id)


def live_events(stream: DataFrame, exclude_comm=TRAINING_DENYLIST) -> DataFrame:
    """Noise is dropped before buffering, so it takes no slot."""
    return drop_comms(stream, exclude_comm)


# --- replay: the same windows and alerts from a stored capture ----------------------------

def replay(
    events: DataFrame, vocab: Vocabulary, score: Callable[[DataFrame], DataFrame], *, keys: list[str], window: int,
    stride: int, ngram: int, cooldown_ns: int, threshold: float = 0.5, chunks: int | None = None,
) -> DataFrame:
    """Alerts a live scorer of whole streams would have raised on these events."""
    numbered = number_events(events, vocab, keys=keys, carry=["pid", "comm", "uid"], chunks=chunks)
    shape = dict(keys=keys, window=window, stride=stride, phase=live_phase(window, stride))
    windows = bag_windows(numbered, vocab, ngram=ngram, **shape).drop("label", "attack_events")
    closing = close_times(numbered, carry=["event_id", "pid", "comm", "uid"], **shape).drop("close_ts")
    scored = score(windows.join(closing, [*keys, "window_id"]))
    anomalies = scored.where(decide(F.col("probability"), threshold, strict=True) == 1)
    return fired_alerts(anomalies, cooldown_ns, keys=keys, order=["close_ts", "event_id"], chunks=chunks)


def replay_processes(
    events: DataFrame, vocab: Vocabulary, score: Callable[[DataFrame], DataFrame], *, keys: list[str], window: int, ngram: int,
    risky: list[str] = HIGH_RISK, least: int = 3, cooldown_ns: int = PROCESS_COOLDOWN_NS, threshold: float = 0.5,
    chunks: int | None = None,
) -> DataFrame:
    """Alerts a live scorer of single processes would have raised: every full buffer, and risky calls before."""
    numbered = number_events(events, vocab, keys=keys, carry=["comm", "uid"], chunks=chunks)
    at = numbered.select(*keys, F.col("seq").alias("end_seq"), F.col("timestamp_ns").alias("close_ts"), "event_id", "comm", "uid")
    full = bag_windows(numbered, vocab, keys=keys, window=window, stride=1, ngram=ngram).select(*keys, "end_seq", "bag")
    high = [vocab.tokens.index(t) for t in risky if t in vocab.tokens]
    early = early_windows(numbered, keys=keys, window=window, risky=high, least=least)
    early = early.select(*keys, "end_seq", bag_of(F.col("tokens"), vocab, ngram).alias("bag"))
    windows = full.unionByName(early).join(at, [*keys, "end_seq"]).withColumn("window_id", F.col("end_seq") - (window - 1))
    anomalies = score(windows).where(decide(F.col("probability"), threshold, strict=True) == 1)
    fired = fired_alerts(anomalies, cooldown_ns, keys=keys, order=["close_ts", "event_id"], chunks=chunks)
    return name_top_features(fired, vocab, ngram, keys) if "weights" in fired.columns else fired


def start_process_alerts(
    stream: DataFrame, vocab: Vocabulary, writer: AlertWriter, checkpoint: str, *, keys: list[str], window: int, ngram: int,
    risky: list[str] = HIGH_RISK, least: int = 3,
):
    """Start scoring each process's buffer live; ``writer`` keeps the cooldown of every process.

    Alerts of a score with ``weights`` name their heaviest features.
    """
    writer.name = writer.name or (lambda fired: name_top_features(fired, vocab, ngram, keys))
    windows = process_windows(stream, vocab, keys=keys, window=window, risky=risky, least=least)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        ready = token_bags(batch, vocab, ngram).withColumn("window_id", F.col("end_seq") - (window - 1))
        writer(ready.withColumn("close_ts", F.col("timestamp_ns")), batch_id)

    return (
        windows.writeStream.foreachBatch(one_batch).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
