"""One stage from a command line: ``python -m quirelight.plans.stages NAME SOURCE SINK``."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import chunking, downloads, retrieval, tracking
from ..sources import readers, writers
from ..sources.snapshots import Store
from .observed import observed
from .runner import Runner, merged, report


def chunk(docs: DataFrame) -> DataFrame:
    return chunking.chunks(docs)


def status(docs: DataFrame) -> DataFrame:
    return chunking.statuses(chunking.attempts(docs))


def weigh(docs: DataFrame) -> DataFrame:
    return retrieval.document_vectors(docs)


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {"chunk": chunk, "status": status, "weigh": weigh}


def configuration(path: str, over: dict | None = None) -> dict:
    """Settings of a YAML file (or JSON, which is YAML too), with ``over`` on them; no file, no settings."""
    if not os.path.exists(path):
        return merged({}, over or {})
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        import yaml
    except ImportError:  # without the package only JSON is read
        return merged(json.loads(raw or "{}"), over or {})
    return merged(yaml.safe_load(raw) or {}, over or {})


def chunk_folder(spark: SparkSession, source: str, sink: str, strategy: str = "hybrid", limits: chunking.Limits = chunking.Limits(), limit: int = 0) -> dict:
    """Chunk the text files below a folder that the sink does not have yet.

    Documents are named after their folders, as ``tracking.targets`` lays them
    out.  The sink is a store with the tables chunks and statuses (one status
    a document, failures included).  What a run makes of both is published at
    once, so a run that dies leaves nothing and one that is repeated goes on.
    """
    texts = readers.texts(spark, source)
    rows = texts.select("path", "text", paths.folder_name(F.col("path")).alias("folder"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"))
    named = tracking.targets(rows, "folder", "stem").join(rows, ["folder", "stem"]).select("document_id", "text")
    store = Store(spark, sink)
    if store.exists("statuses"):
        named = writers.only_new(named, store.read("statuses").select(F.col("doc").alias("document_id")), "document_id")
    if limit:
        named = named.orderBy("document_id").limit(limit)
    made, seen = chunking.attempts(named, strategy, limits, "document_id").persist(), Observation()
    try:
        with store.begin() as t:
            t.append("chunks", made.where("error is null").drop("error"), "doc")
            of = lambda name: F.count_if(F.col("status") == name)
            t.append("statuses", chunking.statuses(made).observe(seen, F.count(F.lit(1)).alias("attempted"), of("SUCCESS").alias("succeeded"), of("FAILED").alias("failed")), "doc")
    finally:
        made.unpersist()
    counts = seen.get
    return {**{k: counts[k] for k in ("attempted", "succeeded", "failed")}, "status": "FAILED" if counts["attempted"] and not counts["succeeded"] else "COMPLETED"}


def extract_folder(spark: SparkSession, source: str, first: Callable, second: Callable | None = None, least: int = 100, most_pages: int = 0) -> DataFrame:
    """document, path, text, status, error of every PDF below a folder, found by extension or mark.

    Texts are cut after ``most_pages`` pages, if any are named (0: all).
    """
    from .extensions import extracted

    found = readers.binaries(spark, source).where(downloads.is_pdf(F.col("path"), F.col("content")))
    out = extracted(found, first, second, least).withColumnRenamed("key", "path")
    if most_pages:
        spans = chunking.page_spans(F.col("text"))
        out = out.withColumn("text", F.when(F.size(spans) > most_pages, F.substring(F.col("text"), F.lit(1), F.get(spans, F.lit(most_pages - 1))["end"])).otherwise(F.col("text")))
    return out.select(paths.folder_name(F.col("path")).alias("document"), "path", "text", "status", "error")


def profiled(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows``, and what will be known once they are computed: their number and first and last moment."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(F.current_timestamp()).alias("begun")), seen


def run(spark: SparkSession, name: str, source: str, sink: str, limit: int = 0, dry: bool = False) -> dict:
    """Run one stage over Parquet documents; the report, whose exit_code is that of the process."""

    def stage() -> dict:
        docs = spark.read.parquet(source)
        STAGES[name](docs.orderBy(docs.columns[0]).limit(limit) if limit else docs).write.mode("overwrite").parquet(sink)
        return {"rows": spark.read.parquet(sink).agg(F.count(F.lit(1))).first()[0]}

    return report(Runner([(name, observed(spark, name, stage))], dry=dry).run())


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("name", choices=sorted(STAGES))
    parser.add_argument("source")
    parser.add_argument("sink")
    parser.add_argument("--limit", type=int, default=0)
    parser.add_argument("--dry", action="store_true")
    a = parser.parse_args(arguments)
    found = run(SparkSession.builder.getOrCreate(), a.name, a.source, a.sink, a.limit, a.dry)
    print(json.dumps(found, default=str))
    return found["exit_code"]


if __name__ == "__main__":
    raise SystemExit(main())
