"""Paths of artifacts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: folders of the three kinds of artifacts and the file each has
FOLDERS = {"documents": "processed/documents", "chunks": "processed/chunks", "embeddings": "processed/embeddings"}
FILES = {"chunks": "chunks.json", "embeddings": "embeddings.parquet"}


def moved(path: Column, to: str) -> Column:
    """The path of a document's chunks or embeddings: the other folder, the artifact's file name."""
    stem = "|".join(f"{f}" for f in FOLDERS.values())
    folder = F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), f"(^|/)({stem})(?=/|$)", f"$1{FOLDERS[to]}")
    return F.concat_ws("/", folder, F.lit(FILES[to])) if to in FILES else folder


def folder_name(path: Column) -> Column:
    """The name of the folder a file is in."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def publication_of(path: Column, folder: str = "documents") -> Column:
    """The segment after ``folder`` in a path; else the file's own folder."""
    after = F.regexp_extract(path, rf"(?:^|/){folder}/([^/]+)/", 1)
    return F.when(after != "", after).otherwise(folder_name(path))


def nested(document_id: Column) -> Column:
    """``a__b`` as ``a/b``, split at the last mark."""
    return F.regexp_replace(document_id, r"^(.*)__", "$1/")


def candidates(document_id: Column, kind: str = "chunks") -> Column:
    """array<struct<priority, path>>: where a document's artifact may lie, the likeliest first."""
    at = lambda name: F.concat(F.lit(f"{FOLDERS[kind]}/"), name, F.lit(f"/{FILES[kind]}"))
    paths = F.array_distinct(F.array(at(document_id), at(nested(document_id))))
    return F.transform(paths, lambda p, i: F.struct(i.alias("priority"), p.alias("path")))


def first_match(wanted: DataFrame, listing: DataFrame, key: str, options: str, path: str) -> DataFrame:
    """key, path of each row's first candidate that the listing has; others are left out.

    ``options`` is an array of structs (priority, path); of equal priorities the first path.
    """
    rows = wanted.select(key, F.explode(options).alias("__o")).select(key, "__o.priority", F.col("__o.path").alias("__p"))
    there = listing.select(F.col(path).alias("__there")).distinct()
    found = rows.join(there, F.col("__p") == F.col("__there"))
    return found.groupBy(key).agg(F.min(F.struct("priority", F.col("__p").alias("path")))["path"].alias("path"))


def content_length(header: Column) -> Column:
    """The size a header states; null if it states none or nonsense."""
    n = F.trim(header).try_cast("long")
    return F.when(n >= 0, n)


def chunk_folders(listing: DataFrame, path: str) -> DataFrame:
    """document_id of every folder with a chunk file, in order."""
    rows = listing.where(F.substring_index(path, "/", -1) == FILES["chunks"])
    return rows.select(folder_name(F.col(path)).alias("document_id")).distinct().orderBy("document_id")
