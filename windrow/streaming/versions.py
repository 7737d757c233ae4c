"""Small state of ``foreachBatch`` functions, one folder per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from windrow.storage import delete_path


class Versions:
    """Small state kept between batches: one folder per batch, written once.

    Batch ``n`` reads what ``n - 1`` wrote, so a repeated batch sees the same state;
    what is older is deleted.
    """

    def __init__(self, path: str):
        self.path = path

    def before(self, batch: DataFrame, batch_id: int, schema: str | T.StructType) -> DataFrame:
        spark = batch.sparkSession
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{batch_id - 1}")

    def save(self, state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        if batch_id >= 2:
            delete_path(state.sparkSession, f"{self.path}/{batch_id - 2}")
