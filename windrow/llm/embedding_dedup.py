"""Near-duplicate vectors by random hyperplanes, exact cosines, and connected components.

A table of the index is a bucket number of some sign bits per vector. Vectors of one bucket are
compared exactly, in blocks; a pair that meets in several tables counts in the first one only,
which both sides' bucket numbers tell, so links are counted without listing pairs. What leaves a
block is one row per linked vector: how many links, and a vector of its component in the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import ship, written
from windrow.llm.components import connected_components
from windrow.llm.groups import runs_of, single_column

BLOCK = 1024
MISS = 0.004
PAIRS_AT_ONCE = 1 << 17


def index_size(n: int, cosine: float) -> tuple[int, int]:
    """Bits per table for buckets of about 16 random vectors, and tables for a miss below MISS."""
    bits = min(30, max(6, round(math.log2(max(n, 2))) - 4))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree ** bits)))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _vectors(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(len(column), -1)


def bucket_rows(unique: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """uid, w, dim, vector and its bucket number in every table (``sig``, 32-bit)."""

    def run(batches: Iterable[pa.RecordBatch]):
        by_dim: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = np.asarray(single_column(table, "dim"))
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim)).combine_chunks()
                x = _vectors(single_column(part, "vector"))
                if dim not in by_dim:
                    by_dim[dim] = planes(dim, bits, tables, seed)
                sides = (x @ by_dim[dim] > 0).reshape(len(x), tables, bits)
                sig = (sides @ powers).astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    *[single_column(part, c) for c in ("uid", "w", "dim", "vector")],
                    pa.array([row.tobytes() for row in sig], pa.binary()),
                    pa.array(sig.tolist(), pa.list_(pa.int32())),
                ], names=["uid", "w", "dim", "vector", "sig", "buckets"])

    return unique.mapInArrow(run, "uid long, w long, dim int, vector binary, sig binary, buckets array<int>")


def _linked(x: np.ndarray, norm: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows reach the cosine; the diagonal does not."""
    close = (x @ x.T) >= (cosine - 1e-9) * np.outer(norm, norm)
    np.fill_diagonal(close, False)
    a, b = np.nonzero(close)
    if len(a):
        low = np.zeros(len(a), bool)
        for at in range(0, len(a), PAIRS_AT_ONCE):
            i, j = a[at:at + PAIRS_AT_ONCE], b[at:at + PAIRS_AT_ONCE]
            low[at:at + len(i)] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) < cosine
        close[a[low], b[low]] = False
    return close & close.T


def _block_links(table: pa.Table, number: int, cell: tuple[int, int], cosine: float):
    """Links of one block: uid, links counted here, a vector of its component in the block."""
    uid, w = (np.asarray(single_column(table, c)) for c in ("uid", "w"))
    x = _vectors(single_column(table, "vector"))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    close = _linked(x, norm, cosine)
    if cell[0] != cell[1]:
        own = np.asarray(single_column(table, "own"))
        close &= own[:, None] != own[None, :]
    if not close.any():
        return None
    a, b = np.nonzero(close)
    sig = np.frombuffer(b"".join(single_column(table, "sig").to_pylist()), "<i4").reshape(len(uid), -1)
    links = np.zeros(len(uid), np.int64)
    for at in range(0, len(a), PAIRS_AT_ONCE):
        i, j = a[at:at + PAIRS_AT_ONCE], b[at:at + PAIRS_AT_ONCE]
        met = np.zeros(len(i), bool)
        for t in range(number):
            met |= sig[i, t] == sig[j, t]
        np.add.at(links, i[~met], w[j[~met]])
    label = np.arange(len(uid))
    while True:
        lower = np.minimum(label, np.where(close, label[None, :], len(uid)).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    keep = close.any(axis=1)
    return uid[keep], links[keep], uid[label[keep]]


def find_links(rows: DataFrame, cosine: float) -> DataFrame:
    """uid, links, other: from every block of every bucket of every table."""
    placed = rows.select("uid", "w", "dim", "vector", "sig", F.posexplode("buckets").alias("number", "bucket"))
    bucket = ["dim", "number", "bucket"]
    sizes = placed.groupBy(*bucket).count().where("count > 1").withColumn("cells", F.ceil(F.col("count") / BLOCK).cast("int"))
    # A bucket above the block size is cut into cells, and every pair of cells is a block.
    cut = placed.join(sizes.drop("count"), bucket).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("cells")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        *bucket, F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "uid", "w", "vector", "sig")
    keys = [*bucket, "low", "high"]
    ordered = cut.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]):
        for table in runs_of(batches, len(keys)):
            if table.num_rows < 2:
                continue
            number, low, high = (table.column(c)[0].as_py() for c in ("number", "low", "high"))
            found = _block_links(table, number, (low, high), cosine)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["uid", "links", "other"])

    return ordered.mapInArrow(run, "uid long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts other vectors of cosine ``cosine`` or more (double precision) that met in some
    bucket; component_id is the smallest vec_id reachable by links, kept says whether that is the
    vector itself. Vectors that are NULL, zero, or have NULL or non-finite components, link with
    nothing; vectors of different length never link. Equal vectors are compared once and counted
    by their number, and all link with each other. vec_id may repeat (each row is a vector) or be
    NULL (never a component's smallest while another is there). Only vec_id and embedding are
    read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.coalesce(
        (F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("e", lambda v: v != 0), F.lit(False))
    data = data.select(
        "vec_id", F.monotonically_increasing_id().alias("rid"), F.when(usable, F.col("e")).alias("e"),
        F.when(usable, F.xxhash64("e")).alias("k1"), F.when(usable, F.xxhash64(F.lit(7), "e", F.lit(11))).alias("k2"))
    data = written(data, "vectors")
    unique = data.where("e IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("rid").alias("uid"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("e").alias("e"))
    unique = written(unique, "unique")

    def as_bytes(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = [np.asarray(v, "<f8") for v in batch.column(2).to_pylist()]
            # Powers of two change no cosine and keep squares inside the range of doubles.
            rows = [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(v) for v in rows], pa.int32()),
                pa.array([v.tobytes() for v in rows], pa.binary())], names=["uid", "w", "dim", "vector"])

    bits, tables = index_size(unique.count(), cosine)
    packed = unique.select("uid", "w", "e").mapInArrow(as_bytes, "uid long, w long, dim int, vector binary")
    rows = written(bucket_rows(packed, bits, tables, seed), "buckets")
    found = written(find_links(rows, cosine), "links")
    linked = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    known = unique.select("k1", "k2", "uid", "w", "least").join(linked, "uid", "left").join(
        roots.withColumnRenamed("v", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    known = written(known, "known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select(
        "k1", "k2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    keyed = data.select("vec_id", F.coalesce("k1", "rid").alias("k1"), "k2")
    out = keyed.join(known, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
