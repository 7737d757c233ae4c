"""Event streams: file source, stored copy, running counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.streaming.versions import Versions


BYTES_PER_BATCH = 4 << 30


def stream_events(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH, **options
) -> DataFrame:
    """Stream of the event files in a folder, in order of their arrival.

    A batch takes files up to ``bytes_per_batch``, so that a large backlog becomes many batches; or
    ``files_per_batch`` files where that is given.
    """
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    return reader.option(*limit).load(path)


def store_events(stream: DataFrame, out: str, checkpoint: str):
    """Append every event to a Parquet table partitioned by session."""
    return (
        stream.writeStream.format("parquet").partitionBy("session_id").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def store_and_score(
    stream: DataFrame, checkpoint: str, *, store: str | None = None, score: Callable[[DataFrame, int], None] | None = None
):
    """Save each batch, score it, or both. A repeated batch replaces its own output."""

    def tee(batch: DataFrame, batch_id: int) -> None:
        if store:
            batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        if score:
            score(batch, batch_id)

    return stream.writeStream.foreachBatch(tee).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counters(stream: DataFrame, keys: list[str] = ("session_id",)) -> DataFrame:
    """Events, distinct processes and users, updated with every batch (update mode)."""
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("pid").alias("unique_pids"),
        F.approx_count_distinct("uid").alias("unique_uids"),
    )


def running_names(stream: DataFrame, keys: list[str] = ("session_id",)) -> DataFrame:
    """Events per call name (update mode)."""
    return stream.groupBy(*keys, "syscall_name").agg(F.count(F.lit(1)).alias("n"))


class ExactCounters:
    """``foreachBatch`` function: events and exact numbers of processes and users of a session.

    Ids are kept as bitmaps, one of 4 KB per range of 32,768 ids that occur, so state is bounded by
    the ids in use and not by their pairs or events. A batch makes its own bitmaps, which are joined
    with those kept; a repeated batch starts from the same state.
    """

    IDS = ("pid", "uid")

    def __init__(self, out: str, state: str, keys: list[str] = ("session_id",)):
        self.out, self.state, self.keys = out, Versions(state), list(keys)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ids = F.explode(F.array(
            F.struct(F.lit("").alias("kind"), F.lit(0).cast("long").alias("id")),
            *[F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("id")) for c in self.IDS])).alias("e")
        known = (F.col("kind") != "") & F.col("id").isNotNull()
        new = batch.select(*self.keys, ids).select(*self.keys, "e.*").groupBy(
            *self.keys, "kind", F.when(known, F.bitmap_bucket_number("id")).alias("part")
        ).agg(
            F.count(F.lit(1)).alias("n"),
            F.bitmap_construct_agg(F.when(known, F.bitmap_bit_position("id"))).alias("bits"))
        both = new.unionByName(self.state.before(batch, batch_id, new.schema))
        merged = both.groupBy(*self.keys, "kind", "part").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
        self.state.save(merged, batch_id)
        kept = self.state.before(batch, batch_id + 1, new.schema)
        distinct = [
            F.coalesce(F.sum(F.when(F.col("kind") == c, F.bitmap_count("bits"))), F.lit(0)).alias(f"unique_{c}s") for c in self.IDS]
        kept.groupBy(*self.keys).agg(F.sum(F.when(F.col("kind") == "", F.col("n"))).alias("n_events"), *distinct).write.mode(
            "overwrite").parquet(f"{self.out}/{batch_id}")
