"""Technique timelines and alert feeds: text lines in, typed rows out.

Parsing takes a DataFrame with a ``value`` column, so a file, a stream or any
text column goes through the same rules.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.scalars import seconds_to_ns
from windrow.schema import TIMELINE_SCHEMA

_STRICT_JSON = {"allowSingleQuotes": "false"}
_RULE_FEED = "rule string, output_fields struct<`evt.time`: string>"
_SIGNATURE_FEED = (
    "timestamp string, cgroupId bigint, "
    "metadata struct<Properties: struct<signatureID: string, signatureName: string>>"
)


def parse_timeline(lines: DataFrame) -> DataFrame:
    """Rows with exactly three tab-separated fields; bounds in nanoseconds.

    ``lines`` needs ``value`` and ``ordinal`` (file order). A bound that is no
    number stops the job: an interval left out would misname its events.
    """
    parts = F.split("value", "\t")

    def bound(text: Column) -> Column:
        unreadable = F.raise_error(F.concat(F.lit("unreadable bound in timeline line: "), F.col("value")))
        return F.coalesce(seconds_to_ns(text), unreadable.cast("long"))

    return lines.where(F.size(parts) == 3).select(
        F.col("ordinal").cast("long"), parts[0].alias("technique"),
        bound(parts[1]).alias("start_ns"), bound(parts[2]).alias("end_ns"),
    )


def _whole_number(text: Column) -> Column:
    """A number as text, with fraction or exponent or without, cut to a whole one; NULL if unreadable."""
    exact = F.coalesce(text.try_cast("decimal(38,9)"), text.try_cast("double").try_cast("decimal(38,9)"))
    return F.coalesce(text.try_cast("long"), exact.try_cast("long"))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline file; a missing file gives an empty timeline and a warning."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        warnings.warn(f"timeline not found ({path}); no technique will be attributed")
        return spark.createDataFrame([], TIMELINE_SCHEMA)
    return parse_timeline(lines.withColumn("ordinal", F.monotonically_increasing_id()))


def parse_rule_alerts(lines: DataFrame, *carry: str) -> DataFrame:
    """Rule feed: keeps lines that are JSON objects with a rule and an event time."""
    doc = F.from_json("value", _RULE_FEED, _STRICT_JSON)
    time_ns = _whole_number(F.col("doc.output_fields")["evt.time"])
    return (
        lines.where(F.array_contains(F.json_object_keys("value"), "rule"))
        .withColumn("doc", doc)
        .select(*carry, F.col("doc.rule").alias("rule"), time_ns.alias("time_ns"))
        .where("time_ns <> 0")
    )


def parse_signature_alerts(lines: DataFrame, *carry: str) -> DataFrame:
    """Signature feed: keeps detections; the name falls back to the id."""
    doc = F.from_json("value", _SIGNATURE_FEED, _STRICT_JSON)
    props = F.col("doc.metadata.Properties")
    return (
        lines.withColumn("doc", doc)
        .select(
            *carry,
            props["signatureID"].alias("signature_id"),
            F.coalesce(props["signatureName"], props["signatureID"]).alias("signature_name"),
            _whole_number(F.col("doc.timestamp")).alias("time_ns"),
            F.col("doc.cgroupId").alias("cgroup_id"),
        )
        .where("signature_id <> '' AND time_ns IS NOT NULL")
    )


def read_rule_alerts(spark: SparkSession, path: str) -> DataFrame:
    return parse_rule_alerts(spark.read.text(path))


def read_signature_alerts(spark: SparkSession, path: str) -> DataFrame:
    return parse_signature_alerts(spark.read.text(path))
