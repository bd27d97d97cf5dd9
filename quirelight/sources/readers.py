"""Readers, by path or scheme that Spark can open; nothing is opened locally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<chunk_id:string,source_document_id:string,chunk_index:int,text_content:string,page_numbers:array<int>,section_title:string,token_count:int>"


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of whole files, recursively; Spark leaves out files of no bytes, blank ones are rows."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.col("content").cast("string").alias("text"))


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files, partial downloads left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.where(~F.col("path").endswith(".part")).select("path", "length", "content")


def literal_list(x: Column) -> Column:
    """A list printed as ['a', 'b'] or JSON, as array<string>; another text is its one element."""
    parsed = F.from_json(F.when(x.startswith("['"), F.translate(x, "'", '"')).otherwise(x), "array<string>")
    return F.when(x.isNull() | (x == ""), F.expr("cast(array() as array<string>)")).when(x.startswith("["), F.coalesce(parsed, F.expr("cast(array() as array<string>)"))).otherwise(F.array(x))


def catalogue_csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ("authors", "file_urls")) -> DataFrame:
    """A catalogue with list columns; rows that do not fit the schema are dropped."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    return df.withColumns({c: literal_list(F.col(c)) for c in lists if c in df.columns})


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON files that hold an array, or an object with ``chunks``."""
    raw = texts(spark, path, "*.json")
    alone = F.regexp_extract("text", r"^\s*(.)", 1) == "["
    either = F.when(alone, F.from_json("text", f"array<{CHUNK}>")).otherwise(F.from_json("text", f"struct<chunks:array<{CHUNK}>>")["chunks"])
    return raw.select("path", F.explode(either).alias("c")).select("path", "c.*")


def complete_folders(listing: DataFrame, path: str, names: tuple[str, ...]) -> DataFrame:
    """Folders that hold all of the named files."""
    rows = listing.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.substring_index(path, "/", -1).alias("name"))
    return rows.where(F.col("name").isin(*names)).groupBy("folder").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(names)).select("folder")
