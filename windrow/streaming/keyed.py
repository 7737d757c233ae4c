"""Windows of single processes from a stream that arrives out of order.

Events of a key wait in buckets of event time. When the watermark passes a bucket's end, a timer
releases its events in order; they go through the key's buffer of the last ``window`` tokens, and
every event that fills it, or is a risky call before, gives a window. Events of a bucket that the
watermark had already passed when they arrived are late: they are put out as they are, marked, and
do not change a window. A key without events for longer than its time to live leaves the store.

State is kept per shard, the keys that hash alike: the waiting buckets (in pieces as they arrived) and
a table of the keys' buffers. A shard is read piece by piece and released bucket by bucket, never as
a whole, with all its keys at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from windrow.schema import EVENT_ORDER
from windrow.storage import ship_package
from windrow.streaming.buffers import SHARD, advance, in_shards, long_columns, pack, unpack, with_nulls
from windrow.streaming.scoring import UNKNOWN_TOKEN
from windrow.vocabulary import HIGH_RISK, Vocabulary

PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which timers and list or map state need.

    A setting of the session, read when a query starts; call it before starting ``released_windows``.
    """
    spark.conf.set(PROVIDER_SETTING, ROCKSDB)


class ReleaseByWatermark(StatefulProcessor):
    """Holds the events of a shard until the watermark passes, then builds the windows of its keys."""

    def __init__(self, keys, carried, order, risky, window, least, bucket_ms, idle_ms):
        self.keys, self.carried, self.order, self.risky = keys, carried, order, risky
        self.window, self.least, self.bucket_ms, self.idle_ms = window, least, bucket_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, piece int", "rows binary")
        self.pieces = handle.getMapState("pieces", "bucket long", "n int")
        self.place = handle.getValueState("place", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            if part.empty:
                continue
            bucket = part["at_ms"].to_numpy(np.int64) // self.bucket_ms
            late = (bucket + 1) * self.bucket_ms <= mark
            if late.any():
                yield self._out(part[late], np.full(int(late.sum()), -1), [None] * int(late.sum()), True)
            for b in np.unique(bucket[~late]).tolist():
                known = self.pieces.getValue((b,))
                n = known[0] if known else 0
                self.waiting.updateValue((b, n), (pack(part[bucket == b]),))
                self.pieces.updateValue((b,), (n + 1,))
                if n == 0:
                    self.handle.registerTimer((b + 1) * self.bucket_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        bucket = now // self.bucket_ms - 1
        known = self.pieces.getValue((bucket,)) if now % self.bucket_ms == 0 else None
        stored = self.place.get()
        place = unpack(stored[0]) if stored else None
        if known:
            place = yield from self._release(place, bucket, known[0], now)
        if self.idle_ms is not None and place is not None:
            mark = timerValues.getCurrentWatermarkInMs()
            if known and now + self.idle_ms > mark:
                self.handle.registerTimer(now + self.idle_ms)
            # What waits is later: it begins a new buffer. Buckets that are due are released before.
            due = any((b[0] + 1) * self.bucket_ms <= mark for b in self.pieces.keys())
            place = place[place["expires"] > (now if due else mark)]
        if place is not None and len(place):
            self.place.update((pack(place),))
        elif stored:
            self.place.clear()

    def _release(self, place, bucket: int, n: int, now: int):
        rows = pd.concat([unpack(self.waiting.getValue((bucket, i))[0]) for i in range(n)], ignore_index=True)
        for i in range(n):
            self.waiting.removeKey((bucket, i))
        self.pieces.removeKey((bucket,))
        if self.idle_ms is not None and place is not None:
            place = place[place["expires"] >= now].reset_index(drop=True)
        at, end, tokens, after = advance(place, rows, self.keys, self.order, self.window, self.least, self.risky)
        for start in range(0, len(end), 5_000):
            part = slice(start, start + 5_000)
            yield self._out(at.iloc[part], end[part], tokens[part], False)
        until = np.zeros(len(after), np.int64)
        if self.idle_ms is not None:
            until[:0 if place is None else len(place)] = [] if place is None else place["expires"]
            until[after["touched"].to_numpy()] = now + self.idle_ms
        after["expires"] = until
        return after.drop(columns="touched")

    def _out(self, rows: pd.DataFrame, end, tokens, late: bool) -> pd.DataFrame:
        out = rows[[*self.keys, *self.carried]].reset_index(drop=True)
        out["end_seq"], out["tokens"], out["late"] = end, tokens, late
        return out

    def close(self) -> None:
        pass


def released_windows(
    stream: DataFrame, vocab: Vocabulary, *, keys: list[str], window: int, delay_ms: int, bucket_ms: int = 1_000,
    idle_ms: int | None = None, risky: list[str] = HIGH_RISK, least: int = 3, order: list[str] = EVENT_ORDER,
    carry: list[str] = ("comm", "uid"), clock: str = "timestamp_ns",
) -> DataFrame:
    """Windows of each process in event order, and the events that came too late for them.

    One row per window (``end_seq``, ``tokens`` as vocabulary indexes, -1 for unknown ones, ``late``
    false) with the columns of the event that closed it, or per late event (``late`` true, no tokens).
    The watermark is ``delay_ms`` behind the largest ``clock`` (nanoseconds) of the batches before.
    An event waits until the watermark has passed its bucket of ``bucket_ms``; what still waits when a
    stream stops stays in the store. With ``idle_ms`` a key is forgotten when the watermark is that
    far past its last released bucket; events after that begin a new buffer. Clock and keys are not NULL.
    """
    ship_package(stream.sparkSession)
    carried = [c for c in dict.fromkeys([*order, *carry]) if c not in keys]
    timed = stream.withColumn("_at", F.timestamp_micros(F.expr(f"`{clock}` div 1000"))).withWatermark("_at", f"{delay_ms} milliseconds")
    # The watermark's own column is left behind, so that late events reach the processor.
    slim = vocab.with_index(timed, "syscall_name", "token").select(
        *keys, *carried, F.coalesce("token", F.lit(UNKNOWN_TOKEN)).alias("token"), F.expr(f"`{clock}` div 1000000").alias("at_ms"))
    schema = T.StructType(
        [slim.schema[c] for c in (*keys, *carried)]
        + [T.StructField("end_seq", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("late", T.BooleanType())]
    )
    high = [vocab.tokens.index(t) for t in risky if t in vocab.tokens]
    processor = ReleaseByWatermark(
        list(keys), carried, [c for c in order if c in carried], high, window, least, bucket_ms, idle_ms)
    longs = long_columns(slim.schema, [*keys, *carried])
    found = in_shards(slim, keys, longs).groupBy(SHARD).transformWithStateInPandas(processor, schema, "append", "EventTime")
    return with_nulls(found, longs)


def start_released(windows: DataFrame, out: str, late: str, checkpoint: str):
    """Write windows to ``out`` and late events to the side table ``late``; a repeated batch replaces its own output."""
    use_rocksdb(windows.sparkSession)

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.where("late").drop("late", "tokens", "end_seq").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.unpersist()

    return windows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
