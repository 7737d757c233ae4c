"""Helpers shared by the operators: written intermediates, shipping code, running totals."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.tokens import release_encoders
from windrow.storage import delete_path, shared_dir
from windrow.storage import ship_package as ship  # noqa: F401


def write_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage at a table that outlives lost executors. ``discard`` removes it.
    """
    spark = df.sparkSession
    path = write_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            delete_path(df.sparkSession, path)


def key_columns(text) -> list:
    """A text's 128-bit content key as two longs (k1, k2); both NULL for a NULL text."""
    return [
        F.when(text.isNotNull(), F.xxhash64(text)).alias("k1"),
        F.when(text.isNotNull(), F.xxhash64(F.lit(7), text, F.lit(11))).alias("k2"),
    ]


def with_computed(docs: DataFrame, inputs: list, fn, fields: str, text: tuple[str, ...] = ("text",)) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) with the columns ``fn`` computes by batch.

    ``fn`` gets the text, which is read from its place in the struct, and the Arrow columns of
    ``inputs``, and returns Arrow arrays for ``fields``. The struct keeps the table's own columns
    apart, whatever their names.
    """
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = f"row {packed.schema['row'].dataType.simpleString()}, {fields}"
    names = ["row", *[f.strip().split(" ")[0] for f in fields.split(",")]]
    count = len(inputs)

    def run(batches):
        release_encoders()
        for batch in batches:
            found = batch.column(0)
            for name in text:
                found = found.field(name)
            made = fn(found, *[batch.column(i + 1) for i in range(count)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return packed.mapInArrow(run, schema)


def partition_offsets(sizes: DataFrame, part: str, size: str, block: int = 4096) -> DataFrame:
    """Running total of ``size`` before each ``part``, in two levels so no task sorts all parts.

    ``sizes`` has one row per part, a whole number from 0. Parts are cut into blocks; each block
    gets its own window, and only one row per block goes to one task.
    """
    from pyspark.sql import Window

    cut = sizes.withColumn("_block", F.floor(F.col(part) / block))
    blocks = cut.groupBy("_block").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(blocks, "_block")
        .select(part, (F.col("_base") + F.col("_in")).cast("long").alias("before"))
    )
