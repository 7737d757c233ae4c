"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a number in 0..N-1 in a fixed total order. A keyed permutation of 0..N-1 moves it to
a position, and shard and slot are arithmetic on the position: ``position % shards`` and
``position // shards``. So shard sizes differ by one row at most, and where any row number went can
be computed without the table. Only DataFrame functions are used, in forms that plain SQL has too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from windrow.llm.common import partition_offsets

# 2**31 - 1: products of two residues stay below 2**62.
PRIME = 2_147_483_647
BLOCK = 4096
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 1 << 20
ROUNDS = 4


def round_keys(seed: int) -> list[int]:
    keys, x = [], (seed * 48_271 + 11) % PRIME
    for _ in range(ROUNDS):
        x = (x * 16_807 + 12_345) % PRIME
        keys.append(x)
    return keys


def mix(x: Column, key) -> Column:
    """A keyed scrambling of a whole number into 0..PRIME-1."""
    a = (F.pmod(x, F.lit(PRIME)) * F.lit(1_103_515_245) + key) % PRIME
    b = (a.bitwiseXOR(F.shiftright(a, 15)) * F.lit(1_597_334_677)) % PRIME
    return b.bitwiseXOR(F.shiftright(b, 13))


def sides(n: int) -> tuple[int, int]:
    """Sizes (a, b) of the two halves, a * b >= n and a * b - n < a: few positions lie outside."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute_once(x: Column, n: int, seed: int) -> Column:
    """One pass of the Feistel network over 0..a*b-1, itself a permutation of that range."""
    a, b = sides(n)
    rounds = F.array(*[
        F.struct(F.lit(key).cast("long").alias("key"), F.lit(a if i % 2 == 0 else b).cast("long").alias("size"))
        for i, key in enumerate(round_keys(seed))
    ])
    start = F.struct(((x - x % b) / b).cast("long").alias("x"), (x % F.lit(b)).cast("long").alias("y"))
    return F.aggregate(
        rounds, start,
        lambda s, r: F.struct(s["y"].alias("x"), ((s["x"] + mix(s["y"], r["key"])) % r["size"]).alias("y")),
        lambda s: s["x"] * F.lit(b) + s["y"],
    )


def walk_length(spark: SparkSession, n: int, seed: int) -> int:
    """Most passes any row needs until it lands inside 0..n-1.

    A walk that leaves the range goes through positions n..a*b-1 only, fewer than the square root
    of n, so these alone are followed until all have come back.
    """
    a, b = sides(n)
    outside = spark.range(n, a * b).select(F.col("id").alias("p"))
    steps = 1
    while a * b > n and outside.limit(1).count():
        outside = outside.select(permute_once(F.col("p"), n, seed).alias("p")).where(F.col("p") >= n)
        steps += 1
    return steps


def permute(x: Column, n: int, seed: int, steps: int) -> Column:
    """Position of row number ``x``: passes are repeated while the result is outside (cycle walking)."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), permute_once(x, n, seed),
        lambda p, _: F.when(p < n, p).otherwise(permute_once(p, n, seed)),
    )


def shard_rows(df: DataFrame, by: list[str], shards: int, seed: int = 1) -> DataFrame:
    """The ``by`` columns of every row with row_number, position, shard and slot.

    ``by`` names whole-number columns; rows equal in all of them are interchangeable, and every one
    gets a place of its own. NULL keys count as a value that comes first. Other columns are
    dropped, whatever their names; join them back by key. An empty table gives an empty result.

    Equal rows are counted before anything is ordered and come back as blocks of at most 4,096, so
    one key holding a third of all rows is spread like any other. Row numbers follow
    (bucket of the key, key), with buckets of about 4,096 blocks.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = df.select(*[F.col(c).cast("long").alias(c) for c in by])
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = rows.count()
    buckets = min(MAX_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, n / ROWS_PER_BUCKET)))))
    blocks = counted.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK))))
    blocks = blocks.withColumn("_size", F.least(F.lit(BLOCK), F.col("_n") - F.col("_blk") * BLOCK))
    scrambled = F.aggregate(
        F.array(*[F.coalesce(F.pmod(F.col(c), F.lit(PRIME)), F.lit(-1)) for c in by]), mix(F.col("_blk"), F.lit(seed)),
        lambda m, v: mix(m + v, F.lit(seed + 1)),
    )
    blocks = blocks.withColumn("_bucket", scrambled % buckets)
    order = Window.partitionBy("_bucket").orderBy(*by, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_in", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    sizes = blocks.groupBy("_bucket").agg(F.sum("_size").alias("_rows"))
    # At most MAX_BUCKETS rows of two longs.
    offsets = F.broadcast(partition_offsets(sizes, "_bucket", "_rows"))
    numbered = blocks.join(offsets, "_bucket").select(
        *by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)).alias("_k"),
        (F.col("before") + F.col("_in")).alias("_first"),
    ).select(*by, (F.col("_first") + F.col("_k")).alias("row_number"))
    if n == 0:
        steps = 1
    else:
        steps = walk_length(df.sparkSession, n, seed)
    placed = numbered.withColumn("position", permute(F.col("row_number"), max(n, 1), seed, steps))
    return placed.withColumns({
        "shard": (F.col("position") % shards).cast("int"), "slot": ((F.col("position") - F.col("position") % shards) / shards).cast("long"),
    })
