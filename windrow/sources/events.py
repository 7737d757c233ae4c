"""Event captures: CSV scans, the labelled data set and split tables."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.scalars import drop_comms
from windrow.schema import EVENT_SCHEMA, LABELED_SCHEMA, TRAINING_COLUMNS
from windrow.vocabulary import TOOLCHAIN_COMMS


LOOKERS = 16


def _stem(path: str) -> str:
    return path.removesuffix(".csv")


def _with_ids(df: DataFrame, whole_path: list[str] = ()) -> DataFrame:
    """Session from the file's name, and an id that breaks ties in time.

    Names in ``whole_path`` occur in several folders; there the whole path is the session.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    if whole_path:
        name = F.when(name.isin(list(whole_path)), F.regexp_replace(F.col("_metadata.file_path"), r"\.csv$", "")).otherwise(name)
    return df.select("*", name.alias("session_id"), F.monotonically_increasing_id().alias("event_id"))


def _csv(spark: SparkSession, paths, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


def _headers(spark: SparkSession, patterns: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first line.

    The store's client reads the beginning of each file, several at a time; no Spark job runs for it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(path):
        stream, codec = path.getFileSystem(conf).open(path), codecs.getCodec(path)
        try:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            return lines.readLine()
        finally:
            stream.close()

    paths = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        paths += [s.getPath() for s in path.getFileSystem(conf).globStatus(path) or []]
    with ThreadPoolExecutor(LOOKERS) as pool:
        lines = list(pool.map(first_line, paths))
    found: dict[tuple[str, ...], list[str]] = {}
    for path, line in zip(paths, lines):
        columns = tuple(c.strip() for c in line.split(",")) if line else ()
        found.setdefault(columns, []).append(path.toString())
    return found


def _by_name(spark: SparkSession, patterns: list[str], needed: list[str]) -> DataFrame:
    """Captures read by the names in their headers; columns of later versions may be missing."""
    kinds = {f.name: f.dataType for f in EVENT_SCHEMA.fields}
    parts = []
    found = _headers(spark, patterns)
    if not found:
        return _csv(spark, patterns, EVENT_SCHEMA)  # Spark says that no path matches
    names = Counter(_stem(f.rpartition("/")[2]) for files in found.values() for f in files)
    shared = [name for name, times in names.items() if times > 1]
    for columns, files in found.items():
        missing = [c for c in needed if c not in columns]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns])
        df = _with_ids(_csv(spark, files, schema), shared)
        absent = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in columns}
        parts.append(df.withColumns(absent).select(*kinds, "session_id", "event_id"))
    return union_sessions(*parts)


def read_events(spark: SparkSession, data_dir: str, exclude_comm=None) -> DataFrame:
    """All captures ``syscalls_*.csv`` of a folder, pruned to what training needs.

    Files may have different headers; ``tid`` falls back to ``pid``. Fails when no
    file matches. ``exclude_comm`` drops process names.
    """
    df = _by_name(spark, [f"{data_dir}/syscalls_*.csv"], list(TRAINING_COLUMNS))
    df = df.withColumn("tid", F.coalesce("tid", "pid"))
    return drop_comms(df.select(*TRAINING_COLUMNS, "tid", "session_id", "event_id"), exclude_comm)


def read_raw_captures(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Full rows of the matching captures; every file must carry ``cgroup_id``.

    The header of each file is checked by reading one line of it. Files of one name in several folders
    are sessions of their own, named by their paths.
    """
    return _by_name(spark, list(patterns), ["cgroup_id"])


def read_labeled(spark: SparkSession, path, exclude_comm=TOOLCHAIN_COMMS) -> DataFrame:
    """Labelled CSV without toolchain rows; a normal row has technique ''."""
    return normalize_labeled(_with_ids(_csv(spark, path, LABELED_SCHEMA)), exclude_comm)


def normalize_labeled(df: DataFrame, exclude_comm) -> DataFrame:
    return drop_comms(df, exclude_comm).na.fill("", ["technique"])


def union_sessions(*sessions: DataFrame) -> DataFrame:
    first, *rest = sessions
    for df in rest:
        first = first.unionByName(df)
    return first


def attack_cgroup(spark: SparkSession, value: int | str) -> int:
    """The attack scope: a number, a string of digits, or a file holding one."""
    text = str(value)
    if not text.isdigit():
        text = spark.read.text(text).first()["value"].strip()
    return int(text)


def write_labeled(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("session_id").parquet(path)


def write_split(windows: DataFrame, path: str) -> None:
    """Windows with their ``split`` column, one folder per split."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
