"""The search service as a Python API: requests, typed results, health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.ingest import Collection

MOST_CHARACTERS = 2000


@dataclass(frozen=True)
class Request:
    """A search: the query's text, how many hits, equality filters (null: none)."""

    query: str
    top_k: int = retrieval.TOP_K
    year: int | None = None
    document_id: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.query) <= MOST_CHARACTERS:
            raise ValueError(f"a query has 1 to {MOST_CHARACTERS} characters")

    def body(self) -> dict:
        """As a client sends it: what is not asked for is left out."""
        out = {"query": self.query, "top_k": retrieval.clamp(self.top_k)}
        filters = {k: v for k, v in (("year", self.year), ("document_id", self.document_id)) if v is not None}
        return out | ({"filters": filters} if filters else {})


@dataclass(frozen=True)
class Hit:
    """One passage found."""

    chunk_id: str
    document_id: str
    score: float
    text: str
    pages: tuple[int, ...]
    title: str | None
    year: int | None


@dataclass(frozen=True)
class Answer:
    """A synthesised answer with the hits it names."""

    answer: str
    hits: tuple[Hit, ...]
    queries: tuple[str, ...]
    citations: tuple[dict, ...] = ()

    @property
    def count(self) -> int:
        return len(self.hits)


@dataclass
class Service:
    """Searches a collection; its queries are embedded by ``embed``."""

    collection: Collection
    embed: object

    def _ranked(self, queries: list[str], filters: dict, k: int) -> DataFrame:
        """id, score, query, rank: the queries' hybrid hits as one list."""
        rows = [(n, q, [float(x) for x in v]) for n, (q, v) in enumerate(zip(queries, self.embed(queries), strict=True))]
        asked = self.collection.spark.createDataFrame(rows, "query long, text string, vector array<double>")
        hits = self.collection.search(asked, k, filters.get("year"), filters.get("document_id"))
        return retrieval.best(retrieval.merged_queries(hits, k).withColumn("all", F.lit(1)), k, ["all"], "id").drop("all")

    def _hits(self, ranked: DataFrame) -> tuple[Hit, ...]:
        points = self.collection.read().drop("dense", "sparse")
        rows = ranked.select("id", "score", "rank").join(points, F.col("id") == F.col("point_id")).orderBy("rank").collect()  # MOST_K at most
        return tuple(Hit(r.point_id, r.document_id, r.score, r.text_content, tuple(r.page_numbers), r.document_title, r.document_year) for r in rows)

    def chunks(self, request: Request) -> tuple[Hit, ...]:
        """The passages of one query as it stands."""
        body = request.body()
        return self._hits(self._ranked([request.query], body.get("filters", {}), body["top_k"]))

    def search(self, request: Request, **steps: object) -> Answer:
        """The agent's answer; ``steps`` replace its analysis, grading, synthesis or citations."""
        body = request.body()
        found = retrieval.Agent(self._described, **{"fill": ("document_title", "document_year", "document_authors"), **steps}).ask(request.query, body.get("filters", {}), body["top_k"])
        cited = found["citations"].orderBy("source_number").collect() if found["citations"] is not None else []
        return Answer(found["answer"], self._hits(found["hits"]), tuple(found["queries"]), tuple(r.asDict() for r in cited))

    def _described(self, queries: list[str], filters: dict, k: int) -> DataFrame:
        """Ranked hits with what the answer and its citations tell of them."""
        points = self.collection.read().select("point_id", "text_content", "document_id", "document_title", "document_year", F.array_join("document_authors", ", ").alias("document_authors"))
        return self._ranked(queries, filters, k).join(points, F.col("id") == F.col("point_id")).drop("point_id")

    def health(self) -> dict:
        return self.collection.health()
