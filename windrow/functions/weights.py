"""TF-IDF weights of window bags, and the vector MLlib wants."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.storage import small_table


def idf_table(windows: DataFrame) -> DataFrame:
    """``(feature_idx, df, n, idf)`` with idf = ln((1 + n) / (1 + df)) + 1.

    ``n`` counts all windows, those without any known token too. Its row travels
    as feature -1 through the same aggregate, so the windows are read once.
    """
    counts = (
        windows.select(F.explode(F.concat(F.array(F.lit(-1)), F.map_keys("bag"))).alias("feature_idx"))
        .groupBy("feature_idx")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    # One row per feature of a fixed vocabulary: a window over all of it is small.
    n = F.max(F.when(F.col("feature_idx") == -1, F.col("df"))).over(Window.partitionBy())
    return (
        counts.withColumn("n", n)
        .where("feature_idx >= 0")
        .withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    )


@dataclass(frozen=True)
class Idf:
    """Fitted document frequencies; one number per feature of the vocabulary."""

    n_windows: int
    df: tuple[int, ...]

    @classmethod
    def fit(cls, windows: DataFrame, n_features: int) -> "Idf":
        rows = idf_table(windows).collect()
        df = [0] * n_features
        for r in rows:
            df[r["feature_idx"]] = r["df"]
        return cls(rows[0]["n"] if rows else windows.count(), tuple(df))

    @property
    def values(self) -> list[float]:
        return [math.log((1 + self.n_windows) / (1 + d)) + 1 for d in self.df]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, d, w) for i, (d, w) in enumerate(zip(self.df, self.values))]
        return small_table(spark, rows, "feature_idx int, df bigint, idf double")

    def weigh(self, bag: Column) -> Column:
        """Bag of counts -> map of L2-normed (1 + ln tf) * idf; an empty bag stays empty."""
        idf = F.array(*[F.lit(v) for v in self.values])
        raw = F.transform_values(bag, lambda k, v: (1 + F.log(v.cast("double"))) * F.get(idf, k))
        return l2_normed(raw)

    def transform(self, windows: DataFrame, out: str = "weights") -> DataFrame:
        return windows.withColumn(out, self.weigh(F.col("bag")))


def l2_normed(weights: Column) -> Column:
    norm = F.sqrt(F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, v: s + v * v))
    return F.transform_values(weights, lambda k, v: v / norm)


def raw_weights(windows: DataFrame, out: str = "weights") -> DataFrame:
    """Counts as they are, for models without TF-IDF."""
    return windows.withColumn(out, F.transform_values("bag", lambda k, v: v.cast("double")))


def vectorize(windows: DataFrame, n_features: int, weights: str = "weights", out: str = "features") -> DataFrame:
    """Sparse MLlib vector of a weight map: as long as the map has entries other than 0.

    The vector's fields are built in SQL; whole batches then pass a typed boundary, where the struct
    becomes a vector without a value being touched.
    """
    entries = F.array_sort(F.filter(F.map_entries(weights), lambda e: e["value"] != 0))
    fields = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(n_features).alias("size"),
        F.transform(entries, lambda e: e["key"].cast("int")).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"),
    )
    packed = windows.withColumn(out, fields)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in packed.schema])
    return packed.mapInArrow(lambda batches: batches, schema)
