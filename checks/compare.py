"""Run a registered query on Spark and its SQL on DuckDB, and compare values."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
                cells.append(None)
            elif hasattr(v, "item"):
                cells.append(v.item())
            else:
                cells.append(v)
        out.append(tuple(cells))
    return sorted(out, key=repr)


def kind(column: pd.Series) -> str:
    """Kind of a column's values, whatever width or unit pandas stores them in."""
    seen = {type(v).__name__ for v in column.dropna().head(100)}
    whole = {"int", "int32", "int64", "Int32", "Int64"}
    return "/".join(sorted({"whole" if t in whole else t for t in seen}))


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else the first difference found."""
    got, want = spark_df.toPandas(), con.sql(sql).df()
    for c, kind_of in spark_df.dtypes:
        # Whole numbers with NULLs come as doubles.
        if kind_of in ("int", "bigint") and got[c].dtype.kind == "f":
            got[c] = got[c].astype("Int64")
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    for c in got.columns:
        if kind(got[c]) != kind(want[c]):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    return None
