"""Where intermediate tables go, and how plan sizes are checked."""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension of at most this many rows may be broadcast (a few MB at most).
BROADCAST_ROWS = 50_000
# Session settings that force the plans meant for large inputs onto small ones.
CHUNKS_SETTING = "windrow.chunks"
BROADCAST_SETTING = "windrow.broadcast_rows"

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def broadcast_rows(spark: SparkSession) -> int:
    """Most rows of a table that may be broadcast."""
    return int(spark.conf.get(BROADCAST_SETTING, str(BROADCAST_ROWS)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_windrow_shipped", False):
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="windrow-code-"), "windrow_code.zip")
    with open(path, "wb") as f:
        f.write(archive.getvalue())
    context.addPyFile(path)
    context._windrow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    A private folder is made only for a local master, where driver and executors
    share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="windrow-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class _Scopes(threading.local):
    """Open scopes of this thread; a stream's batches run in threads of their own."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end.

    Write or collect results inside: a DataFrame that is only returned may still read them.
    """
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            delete_path(spark, path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used when several plans start from one expensive intermediate result; the
    written table outlives lost executors, unlike cached blocks. Inside a
    ``scratch`` scope it is deleted when the scope ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Files whose size is looked up; the rest are taken to be like them.
FILES_LOOKED_UP = 256


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of the files ``df`` is read from, None where it reads none."""
    files = df.inputFiles()
    if not files:
        return None
    spark, looked_up = df.sparkSession, files[:: -(-len(files) // FILES_LOOKED_UP)]
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for name in looked_up:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return size * len(files) // len(looked_up)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension as a plan literal, so Catalyst knows how small it is."""
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
