"""The whole run over one store: catalogue, files, texts, chunks, vectors, collection.

Each component takes what the one before published and what it has not done
yet, and publishes its rows together with the stage's status of each
publication, so a run that dies goes on where it was and a component that runs
again does nothing.  ``dry`` runs tell how much each would do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..operators import chunking, downloads, fetching, ingest, tracking
from ..operators.ingest import Collection
from ..sources import readers
from ..sources.snapshots import Store, Transaction
from . import extensions
from .observed import observed
from .runner import Runner, report

KEY = "paper_id"
TRACKED = f"{KEY} string, content_hash string, file_urls array<string>, " + ", ".join(f"{s}_status string, {s}_attempts int, {s}_error string" for s in tracking.STAGES)
FAILED = "Failed"


@dataclass
class Corpus:
    """Tables below ``root``/tables, files below ``root``/raw, points below ``root``/points.

    ``publications`` given to ``register`` have paper_id, title, authors, year,
    abstract, pub_url and file_urls.
    """

    spark: SparkSession
    root: str
    transport: str = f"{fetching.__name__}:http"
    extractor: Callable[[], extensions.Extractor] = extensions.PlainText
    second: Callable[[], extensions.Extractor] | None = None
    embedder: Callable[[], extensions.Embedder] | None = None
    strategy: str = "hybrid"
    limits: chunking.Limits = chunking.Limits()
    least: int = 100
    tries: int = fetching.TRIES

    def __post_init__(self) -> None:
        self.store, self.collection = Store(self.spark, f"{self.root}/tables"), Collection(self.spark, f"{self.root}/points")

    # ---- the components

    def register(self, publications: DataFrame) -> dict:
        """New and changed publications go back to the stages that they need."""
        good, bad = tracking.validated(publications, KEY, "title")
        hashed = good.withColumn("content_hash", content_hash(*[F.col(c) for c in ("title", "authors", "year", "abstract", "pub_url", "file_urls")])).persist()
        try:
            with self.store.begin() as t:
                if not self.store.exists("tracked"):
                    t.replace("publications", hashed.limit(0), KEY)
                    t.replace("tracked", self.spark.createDataFrame([], TRACKED), KEY)
                t.upsert("publications", hashed, KEY)
                t.merge("tracked", hashed.select(KEY, "content_hash", "file_urls"), _registered)
            return {"registered": hashed.count(), "rejected": bad.count()}
        finally:
            hashed.unpersist()

    def download(self) -> dict:
        plan = downloads.planned(self.store.read("publications").join(self._waiting("download"), KEY, "left_semi"), KEY, "file_urls")
        made = fetching.fetch_all(plan, self.root, self.transport, KEY, tries=self.tries).persist()
        try:
            results = made.withColumnRenamed("key", KEY)
            rolled = downloads.rolled_up(results, KEY, "success", "error", "path")
            return self._publish("download", rolled.select(KEY, (F.col("status") == "Downloaded").alias("ok"), "error"), files=(results, ["path"]))
        finally:
            made.unpersist()

    def extract(self) -> dict:
        """Texts of downloaded files; what was made of a publication's earlier texts goes."""
        wanted = downloads.planned(self.store.read("publications").join(self._waiting("processing"), KEY, "left_semi"), KEY, "file_urls")
        files = self.store.read("files").where("success").select(KEY, "url", "path").join(wanted.select(KEY, "url"), [KEY, "url"], "left_semi").select(KEY, "path").distinct()
        inside = F.regexp_extract("path", r"(raw/documents/.*)$", 1)
        found = readers.binaries(self.spark, f"{self.root}/raw").withColumn("path", inside).join(files, "path")
        made = extensions.extracted(found, self.extractor, self.second, self.least).withColumnRenamed("key", "path").join(files, "path").persist()
        try:
            judged = made.groupBy(KEY).agg(F.bool_and(F.col("error").isNull()).alias("ok"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))
            return self._publish("processing", judged, gone=("texts", "chunks", "statuses", "vectors"), texts=(made, ["path"]))
        finally:
            made.unpersist()

    def chunk(self) -> dict:
        """Chunks of texts that have no status yet; what has neither changes no stage."""
        texts = self.store.read("texts").where("error is null").select(KEY, F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), "text")
        named = tracking.targets(texts, KEY, "stem").join(texts, [KEY, "stem"]).select("document_id", "text", KEY)
        if self.store.exists("statuses"):
            named = named.join(self.store.read("statuses").select(F.col("doc").alias("document_id")), "document_id", "left_anti")
        made = chunking.attempts(named, self.strategy, self.limits, "document_id").join(named.select(F.col("document_id").alias("doc"), KEY), "doc").persist()
        try:
            status = chunking.statuses(made).join(made.select("doc", KEY).distinct(), "doc")
            with self.store.begin() as t:
                t.append("chunks", made.where("error is null").drop("error"), KEY)
                t.append("statuses", status, KEY)
            counts = {r.status: r.n for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            return {"succeeded": counts.get("SUCCESS", 0), "failed": counts.get("FAILED", 0)}
        finally:
            made.unpersist()

    def embed(self) -> dict:
        if self.embedder is None:
            raise ValueError("no embedder is named")
        chunks = self.store.read("chunks").join(self._waiting("embedding"), KEY, "left_semi")
        if self.store.exists("vectors"):
            chunks = chunks.join(self.store.read("vectors").select(F.col("key").alias("chunk_id")), "chunk_id", "left_anti")
        made = extensions.embedded(chunks, self.embedder, "chunk_id", "text").join(chunks.select(F.col("chunk_id").alias("key"), KEY), "key").persist()
        try:
            judged = made.groupBy(KEY).agg(F.bool_and(F.col("dense").isNotNull()).alias("ok")).withColumn("error", F.when(~F.col("ok"), F.lit("chunks without a vector")))
            return self._publish("embedding", judged, vectors=(made.where("dense is not null"), ["key"]))
        finally:
            made.unpersist()

    def ingest(self) -> dict:
        """Points of the publications that wait for it, in one state of the collection, then their status."""
        waiting = self._waiting("ingestion").persist()
        try:
            vectors = self.store.read("vectors").join(waiting, KEY, "left_semi").select(F.col("key").alias("chunk_id"), "dense")
            chunks = self.store.read("chunks").select("chunk_id", KEY, "text", "chunk_index", "n_tokens", "pages").withColumnRenamed("n_tokens", "token_count")
            made = ingest.points(vectors, chunks, self.store.read("publications").select(KEY, "title", "year", "authors"), "chunk_id", KEY)
            self.collection.renew(waiting.withColumnRenamed(KEY, "document_id"), made)
            if self.collection.count():
                self.collection.index()
            return self._publish("ingestion", waiting.select(KEY, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))) | {"points": self.collection.count()}
        finally:
            waiting.unpersist()

    # ---- the run

    def waiting(self) -> dict[str, int]:
        """How many publications wait for each stage: what a dry run tells."""
        if not self.store.exists("tracked"):
            return dict.fromkeys(tracking.STAGES, 0)
        pending = [F.count_if(F.col(f"{s}_status") != done).alias(s) for s, done in tracking.STAGES.items()]
        return self.store.read("tracked").agg(*pending).first().asDict()

    def run(self, publications: DataFrame, dry: bool = False) -> dict:
        """The report of all components in order; none of them runs when dry, and ``waiting`` says what they would do."""
        steps = [("register", lambda: self.register(publications)), *((s, getattr(self, s)) for s in ("download", "extract", "chunk", "embed", "ingest"))]
        critical = frozenset(name for name, _ in steps)  # each needs what the one before publishes
        told = report(Runner([(name, observed(self.spark, name, step)) for name, step in steps], critical, dry).run())
        return told | {"waiting": self.waiting()}

    # ---- statuses

    def _waiting(self, stage: str) -> DataFrame:
        """Ids whose stage is not complete and whose earlier stage is."""
        names = list(tracking.STAGES)
        rows = self.store.read("tracked").where(F.col(f"{stage}_status") != tracking.STAGES[stage])
        if names.index(stage):
            before = names[names.index(stage) - 1]
            rows = rows.where(F.col(f"{before}_status") == tracking.STAGES[before])
        return rows.select(KEY)

    def _publish(self, stage: str, judged: DataFrame, gone: tuple[str, ...] = (), **tables: tuple[DataFrame, list[str]]) -> dict:
        """Rows of the tables in place of those with their keys, in buckets of publications, and the stage's status of each, at once.

        The publications' rows in the tables ``gone`` are dropped.
        """
        judged = judged.persist()
        try:
            with self.store.begin() as t:
                for name in filter(self.store.exists, gone):
                    t.delete(name, judged.select(KEY), KEY)
                for name, (rows, keys) in tables.items():
                    if not self.store.exists(name):
                        t.replace(name, rows, KEY)
                    else:
                        t.merge(name, rows, lambda stored, new, keys=keys: stored.join(new.select(KEY, *keys), [KEY, *keys], "left_anti").unionByName(new))
                _advance(t, stage, judged)
            counts = judged.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")).first().asDict()
            return counts | {"status": FAILED.upper() if counts["failed"] and not counts["succeeded"] else "COMPLETED"}
        finally:
            judged.unpersist()


def _registered(stored: DataFrame, publications: DataFrame) -> DataFrame:
    """Tracking rows after a registration, with errors of stages that go back cleared."""
    out = tracking.upsert(publications, stored, KEY)
    errors = stored.select(KEY, *[f"{s}_error" for s in tracking.STAGES])
    kept = out.join(errors, KEY, "left")
    return kept.select(*[F.when(F.col(c.replace("_error", "_status")) != tracking.PENDING, F.col(c)).alias(c) if c.endswith("_error") else F.col(c).cast(dict(stored.dtypes)[c]).alias(c) for c in stored.columns])


def _advance(t: Transaction, stage: str, judged: DataFrame) -> None:
    """One more attempt of the stage, its status and error, for each publication of ``judged`` (paper_id, ok, error)."""

    def moved(stored: DataFrame, changes: DataFrame) -> DataFrame:
        new = changes.select(F.col(KEY).alias("__k"), "ok", F.col("error").alias("__e"))
        rows, mine = stored.join(new, F.col(KEY) == F.col("__k"), "left"), F.col("__k").isNotNull()
        values = {
            f"{stage}_status": F.when(mine, F.when(F.col("ok"), tracking.STAGES[stage]).otherwise(FAILED)).otherwise(F.col(f"{stage}_status")),
            f"{stage}_attempts": F.coalesce(f"{stage}_attempts", F.lit(0)) + F.when(mine, 1).otherwise(0),
            f"{stage}_error": F.when(mine, F.when(~F.col("ok"), F.col("__e"))).otherwise(F.col(f"{stage}_error")),
        }
        return rows.select(*[values.get(c, F.col(c)).alias(c) for c in stored.columns])

    t.merge("tracked", judged.select(KEY, "ok", "error"), moved)
