"""Sinks; Spark's commit protocol writes aside and then publishes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Arrays, maps and structs go as JSON text."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def only_new(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet: what a resumed run still has to do."""
    return df.join(stored.select(key).distinct(), key, "left_anti")


def marked(df: DataFrame, path: str, metadata: dict) -> bool:
    """A table and then its metadata file, which says that it is complete; False if both were there."""
    from .storage import Storage

    storage = Storage(df.sparkSession, path)
    if storage.exists("metadata.json") and storage.exists("data"):
        return False
    df.write.mode("overwrite").parquet(f"{path}/data")
    storage.put("metadata.json", json.dumps(metadata, sort_keys=True).encode())
    return True


def missing_documents(df: DataFrame, path: str, key: str, by: str) -> int:
    """Append the rows of keys that the sink lacks, partitioned by ``by``; how many rows."""
    from .storage import Storage

    if Storage(df.sparkSession, path).exists("_SUCCESS"):
        df = only_new(df, df.sparkSession.read.schema(df.schema).parquet(path), key)
    seen = Observation()
    # counted while they are written
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(by).parquet(path)
    return seen.get["rows"]


def report(df_or_rows: DataFrame | dict, path: str, spark: SparkSession) -> None:
    """A report as one JSON file; of a table, at most one row a group is expected."""
    from .storage import Storage

    data = [r.asDict(True) for r in df_or_rows.collect()] if isinstance(df_or_rows, DataFrame) else df_or_rows
    Storage(spark, path.rpartition("/")[0]).put(path.rpartition("/")[2], json.dumps(data, default=str, sort_keys=True, indent=1).encode())


def markdown(title: str, figures: dict[str, float], limits: dict[str, tuple[str, float]]) -> str:
    """A test report: each figure with its limit (at least, at most) and whether it holds."""
    lines = [f"# {title}", "", "| figure | value | limit | holds |", "|-|-|-|-|"]
    for name, value in figures.items():
        kind, limit = limits.get(name, ("", None))
        holds = "-" if limit is None else "yes" if (value >= limit if kind == "at least" else value <= limit) else "no"
        lines.append(f"| {name} | {value:g} | {f'{kind} {limit:g}' if limit is not None else '-'} | {holds} |")
    return "\n".join(lines) + "\n"
