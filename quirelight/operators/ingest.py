"""Search points and the collection that holds them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..sources.snapshots import Store
from . import dense, postings, retrieval

SPARSE = "array<struct<term:string,weight:double>>"
RANGES = 64  # into which a label's rows are cut to be numbered


def sparse_vectors(weights: DataFrame) -> DataFrame:
    """id, sparse: (term, weight) pairs by term, of rows id, term, weight."""
    return weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("sparse"))


def points(vectors: DataFrame, chunks: DataFrame, publications: DataFrame, key: str, document: str, sparse: DataFrame | None = None) -> DataFrame:
    """One point a vector; what a chunk or a publication lacks has its default.

    ``vectors``: key, dense. ``chunks``: key, document, text, chunk_index,
    token_count, maybe pages. ``publications``: document, title, year, maybe
    authors. ``sparse``: id, sparse, as of ``sparse_vectors``.
    """
    extra = lambda frame, name, kind: (F.col(name) if name in frame.columns else F.lit(None).cast(kind)).alias(name)
    c = chunks.select(F.col(key).alias("ck"), F.col(document).alias("doc"), "text", "chunk_index", "token_count", extra(chunks, "pages", "array<int>"))
    p = publications.select(F.col(document).alias("pd"), "title", "year", extra(publications, "authors", "array<string>"))
    rows = vectors.join(c, F.col(key) == F.col("ck"), "left").join(p, F.col("doc") == F.col("pd"), "left")
    s = sparse.select(F.col("id").alias("sk"), "sparse") if sparse is not None else None
    rows = rows.join(s, F.col(key) == F.col("sk"), "left") if s is not None else rows.withColumn("sparse", F.lit(None).cast(SPARSE))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    return rows.select(
        uuid5(F.col(key).cast("string")).alias("point_id"), key, F.col("doc").alias("document_id"), F.coalesce("text", F.lit("")).alias("text_content"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"), F.coalesce("pages", none("array<int>")).alias("page_numbers"), F.col("title").alias("document_title"), F.coalesce("authors", none("array<string>")).alias("document_authors"),
        F.col("year").alias("document_year"), "dense", F.coalesce(F.col("sparse").cast(SPARSE), none(SPARSE)).alias("sparse"),
    )


def upserted(stored: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """``stored`` with ``new`` over it; of a key that ``new`` repeats, the last row by ``order`` holds.

    Without an order the rows' own values, column by column, decide between them.
    """
    columns = [c for c in new.columns if c != key]
    place = F.struct(*(order or []), *[F.to_json(F.struct(c)) for c in columns])
    last = new.groupBy(key).agg(F.max_by(F.struct(*columns), place).alias("__row")).select(key, "__row.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def deleted(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``stored`` without the keys of ``gone``."""
    return stored.join(gone.select(key), key, "left_anti")


def updated(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the values that ``changes`` (one row a key) gives; null is no change."""
    named = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("__k"), *[F.col(x).alias(f"__{x}") for x in named])
    joined = stored.join(c, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(f"__{x}", x).alias(x) if x in named else x for x in stored.columns])


def batches(rows: DataFrame, partition: str, order: str, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size`` within their partition key, in the order of a number.

    A key's rows are cut at approximate quantiles into ranges that are numbered
    apart and moved on by the counts of the ranges before, so a hot key is many tasks.
    """
    cuts = rows.groupBy(F.col(partition).alias("__p")).agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
    ranged = rows.join(cuts, F.col(partition).eqNullSafe(F.col("__p")), "left")
    above = F.size(F.filter(F.coalesce("__cuts", F.expr("array()")), lambda c: c < F.col(order)))
    ranged = ranged.withColumn("__r", F.when(F.col(order).isNull(), -1).otherwise(above)).drop("__p", "__cuts")
    counts = ranged.groupBy(F.col(partition).alias("__p"), F.col("__r").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.partitionBy("__p").orderBy("__of")) - F.col("__n")).drop("__n")
    numbered = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy(partition, "__r").orderBy(order)) - 1)
    joined = numbered.join(starts, F.col(partition).eqNullSafe(F.col("__p")) & (F.col("__r") == F.col("__of")))
    return joined.select(*rows.columns, F.floor((F.col("__start") + F.col("__nth")) / size).cast("int").alias("batch"))


@dataclass
class Collection:
    """Points in a store, in buckets of their documents and sorted by year.

    Every change is one new state: a reader sees all of it or nothing, and a
    change that fails leaves the state before.  Indexes are of one state of
    the points, and searches use them only while it is the current one.
    """

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.path)

    def recreate(self, points_: DataFrame) -> int:
        """Replace all points; their number."""
        with self.store.begin() as t:
            t.replace("points", points_, "document_id", sort=("document_year", "document_id", "chunk_index"))
        return self.count()

    def upsert(self, points_: DataFrame, order: list[str] | None = None) -> None:
        """Points in place of those with their ids, in the same document; only the documents' buckets are rewritten."""
        with self.store.begin() as t:
            t.upsert("points", points_, "point_id", order)

    def delete(self, documents: DataFrame) -> None:
        """Drop the points of the documents in column document_id."""
        with self.store.begin() as t:
            t.delete("points", documents.select("document_id"), "document_id")

    def renew(self, documents: DataFrame, points_: DataFrame) -> None:
        """All points of the documents in column document_id replaced by ``points_``, at once."""
        if not self.exists():
            self.recreate(points_)
            return
        with self.store.begin() as t:
            t.delete("points", documents.select("document_id"), "document_id")
            t.upsert("points", points_, "point_id")

    def index(self) -> None:
        """Vectors and postings of the points as they are now."""
        version = self.store.version()
        state, points_ = self._state(version), self.store.read("points", version)
        dense.VectorIndex(self.store).build(points_, "point_id", "dense")
        postings.Index(self.store).build(points_, "point_id", "text_content")
        with self.store.begin() as t:
            t.set_mark("indexed", state)

    def _state(self, version: int | None = None) -> str:
        return json.dumps(self.store.manifest(version)["tables"]["points"]["parts"], sort_keys=True)

    def indexed(self) -> bool:
        return self.exists() and self.store.mark("indexed") == self._state()

    def search(self, queries: DataFrame, k: int, year: int | None = None, document: str | None = None) -> DataFrame:
        """query, id, score, rank of both channels fused; ``queries`` has query, text, vector.

        Without a filter the indexes are read, if they are there; a document's
        points are read from its bucket alone.
        """
        if year is None and document is None and self.indexed():
            near = dense.VectorIndex(self.store).search(queries.where("vector is not null"), retrieval.PREFETCH * k, exact=True)
            return retrieval.fused([near, postings.Index(self.store).search(queries, retrieval.PREFETCH * k)], k)
        found = retrieval.payload_filter(self.read() if document is None else self.store.read("points", values=[document]), {"document_year": year})
        docs = found.select(F.col("point_id").alias("doc_id"), F.col("text_content").alias("text"))
        return retrieval.hybrid_top_k(docs, found.select(F.col("point_id").alias("vec_id"), F.col("dense").alias("embedding")), queries, k)

    def read(self) -> DataFrame:
        return self.store.read("points")

    def exists(self) -> bool:
        return self.store.exists("points")

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def scroll(self, document: str, most: int = 1000) -> DataFrame:
        """A document's points without vectors, the first ``most`` by their chunk; reads the document's bucket."""
        return self.store.read("points", values=[document]).drop("dense", "sparse").orderBy("chunk_index", "point_id").limit(most)

    def health(self) -> dict:
        """Whether the collection can be read, and how many points it has."""
        try:
            n = self.count()
        except Exception as e:  # what cannot be read is the answer
            return {"status": "unhealthy", "points": 0, "error": str(e).splitlines()[0]}
        return {"status": "healthy" if self.exists() else "degraded", "points": n, "error": None}


def ingest(collection: Collection, vectors: DataFrame, chunks: DataFrame, publications: DataFrame, key: str, document: str, sparse: DataFrame | None = None) -> dict:
    """Rebuild the collection from its parts; how many points and vectors without a chunk."""
    made = points(vectors, chunks, publications, key, document, sparse)
    n = collection.recreate(made)
    return {"status": "COMPLETED" if n else "FAILED", "points": n, "without_chunk": collection.read().where("document_id is null").count()}
