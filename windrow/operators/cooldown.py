"""Alert cooldown: an anomaly fires when its key has not fired for ``cooldown`` ns.

The rule compares with the last *fired* alert, so it is a fold over time. To run
it in parallel even for one busy key, time is cut into chunks. An alert entering
a chunk can only be one of the chunk's first anomalies; for each of those the
last alert it leads to inside the chunk is worked out on its own. Linking
exits to entries gives a pointer per entry, and doubling the pointers marks the
true entries of all chunks in logarithmically many joins. Only heavy keys are
cut; the others are folded whole, thousands of keys at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.ordered import CHUNK, WHOLE, cut_into_chunks, heavy_keys, next_at_or_after
from windrow.schema import EVENT_ORDER
from windrow.storage import CHUNKS_SETTING, materialize, ship_package

# Seconds between alerts of one process, and of the whole stream.
PROCESS_COOLDOWN_NS = 2_000_000_000
STREAM_COOLDOWN_NS = 1_000_000_000

ROWS_PER_CHUNK = 200_000


def _following(times: np.ndarray, ends: np.ndarray, cooldown: int) -> np.ndarray:
    """For every row the first row of its group at least a cooldown later, the group's end if there is none.

    Groups lie one behind the other, each sorted; ``ends`` is the end of every row's own.
    """
    low, high, wanted = np.arange(len(times)), ends.copy(), times + cooldown
    while (searching := np.flatnonzero(low < high)).size:
        middle = (low[searching] + high[searching]) >> 1
        before = times[middle] < wanted[searching]
        low[searching[before]] = middle[before] + 1
        high[searching[~before]] = middle[~before]
    return low


def _exits(following: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index of the last alert inside the row's group when the row itself fires."""
    last = np.where(following < ends, following, np.arange(len(ends)))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times of all groups of a batch, the group of each and the groups' n+1 offsets."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    return np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])


def _entries_and_exits(cooldown: int, keys: list[str]):
    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            times, group, offsets = _flat(batch.column("times"))
            following = _following(times, offsets[1:][group], cooldown)
            exits = times[_exits(following, offsets[1:][group])]
            # Entered from before the chunk: nothing earlier lies a cooldown after its start.
            at = np.arange(len(times))
            heads = np.flatnonzero(at <= following[offsets[:-1]][group])
            of = pa.array(group[heads])
            yield pa.RecordBatch.from_arrays(
                [pa.array(times[heads]), pa.array(exits[heads]), *[batch.column(k).take(of) for k in (*keys, CHUNK)]],
                names=["t", "exit", *keys, CHUNK])

    return work


def _fold(cooldown: int, keys: list[str]):
    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            times, group, offsets = _flat(batch.column("times"))
            ends = offsets[1:]
            following = _following(times, ends[group], cooldown).tolist()
            # The entry is one of the group's own times.
            entered = np.flatnonzero(times == np.asarray(batch.column("entry"), np.int64)[group])
            fired = []
            for at, end in zip(entered.tolist(), ends[group[entered]].tolist()):
                while at < end:
                    fired.append(at)
                    at = following[at]
            of = pa.array(group[fired] if fired else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(of) for k in keys], pa.array(times[fired] if fired else np.zeros(0, np.int64))], names=[*keys, "t"])

    return work


def _true_entries(heads: DataFrame, keys: list[str], cooldown: int) -> DataFrame:
    """The entry of each chunk that the fold from the key's start really takes."""
    node = heads.withColumn("resume", F.col("exit") + cooldown)
    edges = next_at_or_after(node.select(*keys, "t", "resume"), heads.select(*keys, F.col("t").alias("entry_t")), keys, "resume", "entry_t", "to")
    pointers = materialize(edges.where("to IS NOT NULL").select(*keys, "t", "to"), "cooldown-links")
    first = heads.groupBy(*keys).agg(F.min("t").alias("t"))
    reached = materialize(first, "cooldown-reached")
    # Each round doubles the distance a pointer spans, until none is left.
    while not pointers.isEmpty():
        step = reached.join(pointers, [*keys, "t"]).select(*keys, F.col("to").alias("t"))
        reached = materialize(reached.unionByName(step).distinct(), "cooldown-reached")
        onward = pointers.select(*keys, F.col("t").alias("to"), F.col("to").alias("_then"))
        pointers = materialize(
            pointers.join(onward, [*keys, "to"]).select(*keys, "t", F.col("_then").alias("to")), "cooldown-links"
        )
    return heads.select(*keys, CHUNK, "t").join(reached, [*keys, "t"]).withColumnRenamed("t", "entry")


def fired_alerts(
    anomalies: DataFrame, cooldown_ns: int, *, keys: list[str] = ("session_id",), order: list[str] = EVENT_ORDER,
    chunks: int | None = None,
) -> DataFrame:
    """The anomalies that fire, with all their columns. ``order[0]`` is the clock.

    The input is evaluated once, into a table; the number of chunks follows from its rows.
    """
    ship_package(anomalies.sparkSession)
    keys, clock = list(keys), order[0]
    rest = [c for c in anomalies.columns if c not in (*keys, clock)]
    # Of anomalies at one instant only the first can fire.
    rows = anomalies.groupBy(*keys, F.col(clock).alias("t")).agg(
        F.min_by(F.struct(*rest), F.struct(*order[1:])).alias("row")
    ) if len(order) > 1 else anomalies.select(*keys, F.col(clock).alias("t"), F.struct(*rest).alias("row"))
    rows = materialize(rows, "cooldown-rows")
    if chunks is None:
        forced = anomalies.sparkSession.conf.get(CHUNKS_SETTING, None)
        chunks = int(forced) if forced else math.ceil(rows.count() / ROWS_PER_CHUNK)
    timed = rows.dropna(subset=[*keys, "t"]).select(*keys, "t")
    heavy = heavy_keys(timed, keys, chunks) if chunks > 1 and keys else None
    light = (timed if heavy is None else timed.where(~heavy)).withColumn(CHUNK, F.lit(WHOLE).cast("long"))
    if heavy is None and (keys or chunks <= 1):
        groups = _times(light, keys)
        groups = groups.withColumn("entry", F.get("times", F.lit(0)))
    else:
        cut = _times(cut_into_chunks(timed if heavy is None else timed.where(heavy), ["t"], chunks), keys)
        types = {f.name: f for f in cut.schema.fields}
        schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("exit", T.LongType()), *[types[k] for k in (*keys, CHUNK)]])
        heads = materialize(cut.mapInArrow(_entries_and_exits(cooldown_ns, keys), schema), "cooldown-heads")
        groups = cut.join(_true_entries(heads, keys, cooldown_ns), [*keys, CHUNK])
        if heavy is not None:
            groups = groups.unionByName(_times(light, keys).withColumn("entry", F.get("times", F.lit(0))))
    schema = T.StructType([*[groups.schema[k] for k in keys], T.StructField("t", T.LongType())])
    fired = groups.select(*keys, "times", "entry").mapInArrow(_fold(cooldown_ns, keys), schema)
    return rows.join(fired, [*keys, "t"]).select(*keys, F.col("t").alias(clock), "row.*").select(*anomalies.columns)


def _times(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sorted times of every key and chunk: at most a chunk's share of all rows in one."""
    return rows.groupBy(*keys, CHUNK).agg(F.sort_array(F.collect_list("t")).alias("times"))
