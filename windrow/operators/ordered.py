"""Total orders without a single task: numbering, running sums and look-behind.

``Window.orderBy`` over a whole session sends the session to one task. Here the rows go through
Spark's range exchange over the order columns and are written once with the number of their
partition, the chunk. Each chunk is sorted on its own, and a small table with one row per (key,
chunk) carries what a chunk needs to know about the ones before it. A key, session or single
timestamp that holds a large share of all rows is therefore spread over many chunks. Keys that are
not heavy stay whole: they go to one task by their key and take no part in that table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.storage import CHUNKS_SETTING, file_bytes, materialize

CHUNK = "_chunk"
# A chunk of few MB while there are at most this many, larger ones beyond it.
CHUNK_BYTES, LARGE_CHUNK_BYTES = 4 << 20, 512 << 20
FINE_CHUNKS = 4_096
# Of keys that are not cut.
WHOLE = -1


def default_chunks(df: DataFrame) -> int:
    """Chunks for ``df`` by the bytes of its files alone; four per shuffle partition where it has none."""
    conf = df.sparkSession.conf
    forced = conf.get(CHUNKS_SETTING, None)
    if forced:
        return int(forced)
    size = file_bytes(df)
    if size is None:
        return 4 * int(conf.get("spark.sql.shuffle.partitions"))
    fine = max(1, math.ceil(size / CHUNK_BYTES))
    return fine if fine <= FINE_CHUNKS else max(FINE_CHUNKS, math.ceil(size / LARGE_CHUNK_BYTES))


def cut_into_chunks(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: a long that never falls as rows advance in ``order``.

    More than one chunk are written to the shared folder, so that a row keeps its chunk. The exchange
    reads ``df`` twice, for its bounds and for its rows; write an expensive ``df`` before.
    """
    chunks = default_chunks(df) if chunks is None else chunks
    if chunks <= 1:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    ranged = df.repartitionByRange(chunks, *order).withColumn(CHUNK, F.spark_partition_id().cast("long"))
    return materialize(ranged, "chunks")


def _sized(df: DataFrame, chunks: int | None, once: bool) -> tuple[DataFrame, int]:
    """``df`` ready to be cut, and the number of its chunks."""
    wanted = default_chunks(df) if chunks is None else chunks
    if once and wanted > 1:
        df = materialize(df, "ordered")
        wanted = default_chunks(df) if chunks is None else chunks
    return df, wanted


def heavy_keys(df: DataFrame, keys: list[str], chunks: int) -> Column | None:
    """True for rows of keys that may hold more than a chunk's share of all rows; None if no key does.

    A sketch of frequent items counts hashes of keys in one pass. It never misses a heavy key; a light
    one that shares its hash is cut as well, which changes no result.
    """
    most = min(2 * chunks, 10_000)
    of = F.xxhash64(*keys)
    sketch = F.expr(f"approx_top_k(_key, {most}, {max(10_000, 8 * most)})")
    found = df.select(of.alias("_key")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    heavy = [item["item"] for item in found["top"] or [] if item["count"] * chunks >= found["n"]]
    return of.isin(heavy) if heavy else None


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    seq: str | None = None,
    total: str | None = None,
    lags: dict[str, str] | None = None,
    sums: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    chunks: int | None = None,
    keep_chunk: bool = False,
    once: bool = False,
) -> DataFrame:
    """Running values over ``order`` within each combination of ``keys``.

    ``seq``: 0-based position; ``total``: rows of the key; ``lags``: new column ->
    column whose previous value it takes; ``sums``: new column -> expression to
    add up, current row included; ``totals``: new column -> expression added up
    over the whole key. Keys must not be NULL. ``once`` says that ``df`` costs more than a scan: it is
    written before it is cut, as cutting reads it several times.

    Rows of light keys are shuffled once, by key. Rows of heavy keys are ranged and written, then
    shuffled by (keys, chunk); the table of chunks is joined on the same columns, so they do not move
    again.
    """
    lags, sums, totals = lags or {}, sums or {}, totals or {}
    df, chunks = _sized(df, chunks, once)
    part = [*keys, CHUNK]
    if chunks > 1 and keys:
        heavy = heavy_keys(df, keys, chunks)
        if heavy is None:
            chunks, df = 1, df.withColumn(CHUNK, F.lit(WHOLE).cast("long"))
        else:
            light = df.where(~heavy).withColumn(CHUNK, F.lit(WHOLE).cast("long"))
            df = cut_into_chunks(df.where(heavy), order, chunks).unionByName(light)
    else:
        df = cut_into_chunks(df, order, chunks)
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    added = {}
    if seq or lags:
        added["_at"] = F.row_number().over(inside).cast("long") - 1
    for name, source in lags.items():
        added[name] = F.lag(source).over(inside)
    for name, expr in sums.items():
        added[name] = F.sum(expr).over(upto)

    if chunks <= 1:
        whole = Window.partitionBy(*part)
        if total:
            added[total] = F.count(F.lit(1)).over(whole)
        for name, expr in totals.items():
            added[name] = F.sum(expr).over(whole)
        out = df.withColumns(added) if added else df
        if seq:
            out = out.withColumn(seq, F.col("_at"))
        return out.drop("_at") if keep_chunk else out.drop("_at", CHUNK)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()]
    aggs += [F.sum(e).alias(f"_tot_{n}") for n, e in totals.items()]
    aggs += [F.max_by(F.struct(s), F.struct(*order)).alias(f"_last_{n}") for n, s in lags.items()]
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = df.where(F.col(CHUNK) != WHOLE).groupBy(*part).agg(*aggs).select(
        *part,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(whole).alias(total)] if total else []),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums],
        *[F.sum(f"_tot_{n}").over(whole).alias(n) for n in totals],
        *[F.lag(f"_last_{n}").over(by_chunk).alias(f"_last_{n}") for n in lags],
    )
    # A light key is a chunk of its own.
    alone, whole_key = F.col(CHUNK) == WHOLE, Window.partitionBy(*part)
    if total:
        added["_here"] = F.count(F.lit(1)).over(whole_key)
    for name, expr in totals.items():
        added[f"_here_{name}"] = F.sum(expr).over(whole_key)
    out = (df.withColumns(added) if added else df).join(carried, part, "left")
    fixed = {}
    if seq:
        fixed[seq] = F.col("_at") + F.coalesce("_before", F.lit(0))
    if total:
        fixed[total] = F.when(alone, F.col("_here")).otherwise(F.col(total))
    for name in totals:
        fixed[name] = F.when(alone, F.col(f"_here_{name}")).otherwise(F.col(name))
    for name, source in lags.items():
        fixed[name] = F.when(F.col("_at") == 0, F.col(f"_last_{name}")[source]).otherwise(F.col(name))
    for name in sums:
        fixed[name] = F.col(name) + F.coalesce(F.col(f"_sum_{name}"), F.lit(0))
    if fixed:
        out = out.withColumns(fixed)
    gone = ["_at", "_before", "_here"] + [f"_here_{n}" for n in totals] + [f"_sum_{n}" for n in sums] + [f"_last_{n}" for n in lags]
    return out.drop(*gone, *([] if keep_chunk else [CHUNK]))


def next_at_or_after(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    out: str,
    chunks: int | None = None,
    once: bool = False,
) -> DataFrame:
    """Forward as-of join: the least ``right_time`` not before ``left_time``.

    Keeps every left row; ``out`` is NULL when nothing follows. Both sides are
    put in one order and read backwards inside each chunk; the least time of the
    later chunks comes from the table of chunks.
    """
    lcols = [c for c in left.columns if c not in keys]
    both = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*lcols).alias("_row")
    ).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side")),
        allowMissingColumns=True,
    )
    both, chunks = _sized(both, chunks, once)
    both = cut_into_chunks(both, ["_t", "_side"], chunks)
    part = [*keys, CHUNK]
    found = F.when(F.col("_side") == 1, F.col("_t"))
    # Backwards, so that the frames grow: one ending at the last row is recomputed per row.
    ahead = Window.partitionBy(*part).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("_here", F.min(found).over(ahead)).where("_side = 0")
    if chunks <= 1:
        return here.select(*keys, "_row.*", F.col("_here").alias(out))
    firsts = both.groupBy(*part).agg(F.min(found).alias("_first"))
    carried = firsts.select(*part, F.min("_first").over(later).alias("_later"))
    return here.join(carried, part, "left").select(*keys, "_row.*", F.coalesce("_here", "_later").alias(out))


def last_at_or_before(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: str, out: str, chunks: int | None = None,
    once: bool = False,
) -> DataFrame:
    """Backward as-of join: ``out`` is the whole right row with the largest ``right_time`` not after the left time.

    Keeps every left row; ``out`` is NULL when nothing comes before, or the left time is NULL. Times
    of the right side are different within a key. Rows without a time take no part in the order, where
    they would all be in one place; ``left`` is read once more for them.
    """
    lcols = [F.col(f"`{c}`") for c in left.columns if c not in keys]
    rcols = [c for c in right.columns if c not in keys]
    nothing = F.lit(None).cast(T.StructType([right.schema[c] for c in rcols]))
    timeless = left.where(left_time.isNull()).select(*keys, *lcols, nothing.alias(out))
    both = left.where(left_time.isNotNull()).select(*keys, left_time.alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_row")).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*rcols).alias("_found")),
        allowMissingColumns=True,
    )
    both, chunks = _sized(both, chunks, once)
    both = cut_into_chunks(both, ["_t", "_side"], chunks)
    part = [*keys, CHUNK]
    behind = Window.partitionBy(*part).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("_here", F.last("_found", ignorenulls=True).over(behind)).where("_side = 1")
    kept = F.col("_here")
    if chunks > 1:
        lasts = both.groupBy(*part).agg(F.max_by("_found", F.when(F.col("_found").isNotNull(), F.col("_t"))).alias("_last"))
        carried = lasts.select(*part, F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"))
        here, kept = here.join(carried, part, "left"), F.coalesce("_here", "_earlier")
    return here.select(*keys, "_row.*", kept.alias(out)).union(timeless)
