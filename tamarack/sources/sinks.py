"""Sinks: address lists, exports, serialised rows, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_urls(df: DataFrame, path: str, column: str = "url") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def serialised(df: DataFrame, drop: tuple[str, ...] = ("id", "created_at", "updated_at")) -> DataFrame:
    """One JSON text a row: decimals as numbers, times in ISO 8601, nulls kept, but empty collections
    for null ones; without generated columns."""
    columns = []
    for c, t in df.drop(*drop).dtypes:
        v = F.col(c)
        if t.startswith("decimal"):
            v = v.cast("double")
        elif t.startswith("timestamp"):
            v = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
        elif t.startswith(("array", "map")):
            v = F.coalesce(v, (F.array() if t.startswith("array") else F.create_map()).cast(t))
        columns.append(v.alias(c))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new snapshot folder; readers switch to it once it is whole."""
    df.write.mode("errorifexists").parquet(path)
