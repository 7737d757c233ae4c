"""Token buffers of many processes advanced together.

State is kept for a shard, all processes whose keys hash alike, as one packed table with a row per
process: events seen and the last tokens. A batch of a shard's events is one sort and a few whole
arrays, however many processes it has; one call for every process would cost more than its events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD, SHARDS = "_shard", 512
# Stands for NULL in whole numbers, which pandas would turn into inexact ones; sorts last, as NULL does there.
MISSING = 2 ** 63 - 1


def in_shards(rows: DataFrame, keys: list[str], longs: list[str]) -> DataFrame:
    """Add the shard of every row and put ``MISSING`` for NULL in ``longs``."""
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int").alias(SHARD)
    return rows.select(shard, *[F.coalesce(c, F.lit(MISSING)).alias(c) if c in longs else F.col(c) for c in rows.columns])


def long_columns(schema: T.StructType, among: list[str]) -> list[str]:
    return [c for c in among if schema[c].dataType == T.LongType()]


def with_nulls(rows: DataFrame, longs: list[str]) -> DataFrame:
    return rows.select(*[F.nullif(F.col(c), F.lit(MISSING)).alias(c) if c in longs else F.col(c) for c in rows.columns])


def pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


def advance(place: pd.DataFrame | None, rows: pd.DataFrame, keys: list[str], order: list[str], window: int, least: int, risky):
    """The events that give a window, its end and tokens, and the shard's table afterwards.

    ``place`` has the keys, ``seen`` and ``tail`` of every known process. The table returned has them
    for all, with ``touched`` for those of ``rows``.
    """
    rows = rows.sort_values(order, kind="stable")
    known = 0 if place is None else len(place)
    everyone = rows[keys] if not known else pd.concat([place[keys], rows[keys]], ignore_index=True)
    number = everyone.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()  # known ones keep their row's
    of = number[known:]
    n = int(number.max()) + 1
    seen, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
    new = rows["token"].to_numpy(np.int64)
    kept = []
    if known:
        kept = [np.asarray(t, np.int64) for t in place["tail"]]
        seen[:known], held[:known] = place["seen"], [len(t) for t in kept]
    # Every process's kept tokens, then its new ones.
    owner = np.concatenate([np.repeat(np.arange(n), held), of])
    sorted_by = np.argsort(owner, kind="stable")
    tokens = np.concatenate([*kept, new])[sorted_by]
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    at = np.empty(len(owner), np.int64)
    at[sorted_by] = np.arange(len(owner))
    at = at[len(owner) - len(new):]
    end = seen[of] + at - edges[of] - held[of]
    fires = np.flatnonzero((end >= window - 1) | (np.isin(new, risky) & (end >= least - 1)))
    first = np.maximum(edges[of], at + 1 - window)
    spans = [tokens[a:b].astype(np.int32) for a, b in zip(first[fires].tolist(), (at[fires] + 1).tolist())]
    after = everyone.loc[~pd.Series(number, index=everyone.index).duplicated()].reset_index(drop=True)
    arrived = np.bincount(of, minlength=n)
    after["seen"] = seen + arrived
    begin = np.maximum(edges[:-1], edges[1:] - window + 1)
    after["tail"] = [tokens[a:b] for a, b in zip(begin.tolist(), edges[1:].tolist())]
    after["touched"] = arrived > 0
    return rows.iloc[fires], end[fires], spans, after
