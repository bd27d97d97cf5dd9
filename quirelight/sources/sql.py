"""Statements of a file, one statement with arguments, and what tables there are."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def statements(script: str) -> list[str]:
    """A script's statements; ``--`` comments and empty ones are left out, quoted semicolons stay."""
    parts = re.findall(r"'(?:[^']|'')*'|--[^\n]*|;|[^';-]+|-", script)
    out, held = [], ""
    for part in [*parts, ";"]:
        if part == ";":
            if held.strip():
                out.append(held.strip())
            held = ""
        elif not part.startswith("--"):
            held += part
    return out


def run_script(spark: SparkSession, script: str) -> int:
    """Run a script's statements in turn; how many."""
    found = statements(script)
    for statement in found:
        spark.sql(statement)
    return len(found)


def raw(spark: SparkSession, statement: str, **arguments: object) -> DataFrame:
    """One statement with named arguments (``:name``)."""
    return spark.sql(statement, args=arguments)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def columns(spark: SparkSession, table: str) -> dict[str, str]:
    return {c.name: c.dataType for c in spark.catalog.listColumns(table)}
