"""Overlapping intervals cut into disjoint segments, so that a time is looked up in one place.

A sweep over the ends of intervals keeps the open ones in a heap of their ordinals; between two ends
the smallest open ordinal wins. n intervals give at most 2 n + 1 segments. A large timeline is swept
in chunks of time: an interval takes part in the chunks its two ends fall into, and what it covers in
full between them reaches each chunk as one number, the smallest ordinal that covers it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_CHUNK = 20_000
MOST_CHUNKS = 4_096


def places_below(values: Column, t: Column, most: int) -> Column:
    """How many of the ascending ``values`` (an array of ``most`` longs at most) are not above ``t``, by bisection."""
    def step(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = (s["low"] < s["high"]) & (F.get(values, middle) <= t)
        return F.when(above, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), F.when(s["low"] < s["high"], middle).otherwise(s["high"]).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length()))), start, step, lambda s: s["low"])


def sweep(spans: Iterable[tuple], low: int | None = None, high: int | None = None) -> list[tuple]:
    """Disjoint (ordinal, start, end) of ``spans`` (ordinal, start, end), ends included, in time order.

    With ``low`` and ``high`` only that stretch is swept. Neighbours of one ordinal are one segment.
    """
    spans = [s for s in spans if s[1] <= s[2]]
    if low is not None:
        spans = [(o, max(a, low), min(b, high)) for o, a, b in spans if a <= high and b >= low]
    spans.sort(key=lambda s: s[1])
    cuts = sorted({x for _, a, b in spans for x in (a, b + 1)})
    out, heap, at = [], [], 0
    for here, then in zip(cuts, cuts[1:]):
        while at < len(spans) and spans[at][1] <= here:
            heapq.heappush(heap, (spans[at][0], spans[at][2]))
            at += 1
        while heap and heap[0][1] < here:
            heapq.heappop(heap)
        if heap:
            first = heap[0][0]
            if out and out[-1][0] == first and out[-1][2] == here - 1:
                out[-1] = (first, out[-1][1], then - 1)
            else:
                out.append((first, here, then - 1))
    return out


def disjoint_segments(timeline: DataFrame, keys: list[str] = (), chunks: int | None = None) -> DataFrame:
    """keys, start_ns, end_ns, technique: disjoint segments of a timeline of any size.

    Every instant belongs to the technique of the first interval (by ``ordinal``) that holds it.
    Intervals that end before they begin hold none.
    """
    keys = list(keys)
    spans = timeline.where("end_ns >= start_ns").groupBy(*keys, "start_ns", "end_ns").agg(F.min("ordinal").alias("ordinal"))
    ends = spans.select(F.explode(F.array("start_ns", "end_ns")).alias("t"))
    chunks = chunks or max(1, min(MOST_CHUNKS, -(-2 * spans.count() // ROWS_PER_CHUNK)))
    shares = [i / chunks for i in range(1, chunks)]
    found = ends.agg(F.percentile_approx("t", shares, 10_000)).first()[0] if shares else None
    # A chunk begins at each bound; they steer balance only.
    bounds = sorted(set(found or []))
    lows, highs = [-(1 << 63), *bounds], [*[b - 1 for b in bounds], (1 << 63) - 2]

    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else None
    placed = spans.withColumns({
        name: places_below(cuts, F.col(end), len(bounds)) if bounds else F.lit(0) for name, end in (("c0", "start_ns"), ("c1", "end_ns"))})
    # What covers chunks in full, as two overlapping stretches of 2^level chunks.
    covering = placed.where("c1 - c0 >= 2").withColumn("level", F.floor(F.log2(F.col("c1") - F.col("c0") - 1) + 1e-9).cast("int"))
    stretch = F.expr("explode(array(c0 + 1, c1 - shiftleft(1, level)))").alias("at")
    nodes = covering.select(*keys, "level", stretch, "ordinal").groupBy(*keys, "level", "at").agg(F.min("ordinal").alias("ordinal"))

    def push_down(table: pd.DataFrame) -> pd.DataFrame:
        """The smallest ordinal over every chunk of one key; at most chunks * log(chunks) rows come in."""
        none = np.iinfo(np.int64).max
        least = np.full(len(lows) + 1, none, np.int64)
        for level in range(int(table["level"].max()), -1, -1):
            mine = table[table["level"] == level]
            np.minimum.at(least, mine["at"].to_numpy(), mine["ordinal"].to_numpy())
            if level:
                half = 1 << (level - 1)
                least[half:] = np.minimum(least[half:], least[:-half].copy())
        at = np.flatnonzero(least < none)
        return pd.DataFrame({**{k: [table[k].iloc[0]] * len(at) for k in keys}, "chunk": at, "ordinal": least[at]})

    key_fields = [timeline.schema[k] for k in keys]
    cover_schema = T.StructType([*key_fields, T.StructField("chunk", T.LongType()), T.StructField("ordinal", T.LongType())])
    one_key = nodes.withColumn("_one", F.lit(0)) if not keys else nodes
    covers = one_key.groupBy(*(keys or ["_one"])).applyInPandas(push_down, cover_schema)
    parts = placed.select(*keys, F.explode(F.array_distinct(F.array(F.col("c0").cast("long"), F.col("c1").cast("long")))).alias("chunk"), "ordinal", "start_ns", "end_ns")
    whole = covers.select(*keys, "chunk", "ordinal", F.lit(None).cast("long").alias("start_ns"), F.lit(None).cast("long").alias("end_ns"))

    def sweep_chunk(table: pd.DataFrame) -> pd.DataFrame:
        chunk = int(table["chunk"].iloc[0])
        low, high = lows[chunk], highs[chunk]
        known = table["start_ns"].notna().to_numpy()
        ordinals = table["ordinal"].to_numpy()
        starts, stops = table["start"].to_numpy(), table["stop"].to_numpy()
        spans = [(int(o), int(a), int(b)) if k else (int(o), low, high) for o, a, b, k in zip(ordinals, starts, stops, known)]
        cut = sweep(spans, low, high)
        return pd.DataFrame({**{k: [table[k].iloc[0]] * len(cut) for k in keys}, "ordinal": [c[0] for c in cut],
                             "start_ns": [c[1] for c in cut], "end_ns": [c[2] for c in cut]})

    schema = T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in ("ordinal", "start_ns", "end_ns")]])
    # Numbers without NULLs beside the flagged ones, which pandas would turn into doubles.
    every = parts.unionByName(whole).withColumns(
        {"start": F.coalesce("start_ns", F.lit(0)), "stop": F.coalesce("end_ns", F.lit(0))})
    cut = every.groupBy(*keys, "chunk").applyInPandas(sweep_chunk, schema)
    named = timeline.groupBy(*keys, "ordinal").agg(F.min("technique").alias("technique"))
    return cut.join(named, [*keys, "ordinal"]).select(*keys, "start_ns", "end_ns", "technique")
