"""Dense, lexical and rank-fused retrieval.

Queries are a small table (their number is the caller's); the collection is
never collected.  Scores are rounded before ranking, ties go to the lesser id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.ids import uuid5
from . import dense, postings

TOP_K, MOST_K, PREFETCH, RRF_K = 10, 50, 3, 60

K1, B, AVERAGE_LENGTH, TERM = postings.K1, postings.B, postings.AVERAGE_LENGTH, postings.TERM


def clamp(top_k: int, most: int = MOST_K) -> int:
    return max(1, min(top_k, most))


def payload_filter(frame: DataFrame, filters: dict, drop_falsy: bool = False) -> DataFrame:
    """All of the given equalities; None (or, on request, any falsy value) is no condition."""
    for name, value in filters.items():
        if value is not None and not (drop_falsy and not value):
            frame = frame.where(F.col(name) == value)
    return frame


def merged_filters(extracted: dict, user: dict, retry: int = 0) -> dict:
    """The user's filters over the extracted ones; none on a retry."""
    return {} if retry else {**extracted, **{k: v for k, v in user.items() if v}}


def best(scored: DataFrame, k: int, by: list[str], id_col: str, score_col: str = "score") -> DataFrame:
    """The first k of each query with their rank (pruned before the shuffle by Spark)."""
    order = Window.partitionBy(*by).orderBy(F.desc(score_col), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_top_k(collection: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """query, id, score, rank; ``queries`` has query, vector: all vectors meet all queries, as blocks."""
    return best(dense.candidates(collection, queries, k, id_col, vector_col, digits), k, ["query"], "id")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def document_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """id, term, weight: saturated term frequencies; only of the terms of ``wanted``, if given."""
    rows = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("n", F.size("t"))
    found = rows.select("id", "n", F.explode("t").alias("term"))
    if wanted is not None:  # before anything is shuffled
        found = found.join(wanted.select("term").distinct(), "term", "left_semi")
    counts = found.groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n") / F.lit(AVERAGE_LENGTH))
    return counts.select("id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("weight"))


_COUNTS = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())]))
_HELD = 1 << 18  # terms of a batch of results


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, counts: each text's number of terms, and its distinct terms in order with their counts; counted within the row."""
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for batch in batches:
            row_of, n, ends, names, tf = [], [], [0], [], []

            def made(batch: pa.RecordBatch, row_of: list, n: list, ends: list, names: list, tf: list) -> pa.RecordBatch:
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(tf, pa.int64())], ["term", "tf"])
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row_of, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["id", "n", "counts"])

            for i, text in enumerate(batch.column(1)):
                if found := find(text.as_py()):
                    counts = Counter(found)
                    names += (own := sorted(counts))
                    tf += [counts[t] for t in own]
                    row_of.append(i)
                    n.append(len(found))
                    ends.append(len(names))
                if len(names) > _HELD:
                    yield made(batch, row_of, n, ends, names, tf)
                    row_of, n, ends, names, tf = [], [], [0], [], []
            yield made(batch, row_of, n, ends, names, tf)

    return rows.mapInArrow(count, StructType([StructField("id", rows.schema["id"].dataType), StructField("n", LongType()), StructField("counts", _COUNTS)]))


def _weight(tf: object, n: object) -> object:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * n / AVERAGE_LENGTH))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _merged(texts: Column) -> Column:
    """Weights of an id that several texts have: texts with as many terms count as one, as in ``document_vectors``."""
    every = F.array_sort(F.flatten(F.transform(texts, lambda x: F.transform(x["counts"], lambda c: F.struct(c["term"].alias("term"), x["n"].alias("n"), c["tf"].alias("tf"))))))

    def summed(a: Column, starts: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            run = F.slice(a, s + 1, F.coalesce(F.get(starts, k + 1), F.size(a)) - s)
            tf = F.aggregate(run, F.lit(0).cast("long"), lambda total, x: total + x["tf"])
            return F.struct(F.get(a, s)["term"].alias("term"), _weight(tf, F.get(a, s)["n"]).alias("weight"))

        return F.array_sort(F.transform(starts, one))

    def runs(a: Column) -> Column:
        other = lambda i: (F.get(a, i)["term"] != F.get(a, i - 1)["term"]) | (F.get(a, i)["n"] != F.get(a, i - 1)["n"])
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | other(i))
        return _bound(starts, lambda at: summed(a, at))

    return _bound(every, runs)


def sparse_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sparse: ``document_vectors`` as (term, weight) pairs by term, a row an id; a text's counts are shuffled once, as one row."""
    texts = term_counts(docs, id_col, text_col).repartition("id").groupBy("id").agg(F.collect_list(F.struct("n", "counts")).alias("texts"))
    first = F.get("texts", F.lit(0))
    alone = F.transform(first["counts"], lambda c: F.struct(c["term"].alias("term"), _weight(c["tf"], first["n"]).alias("weight")))
    return texts.select("id", F.when(F.size("texts") == 1, alone).otherwise(_merged(F.col("texts"))).alias("sparse"))


def inverse_frequency(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf over the collection."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    df = vectors.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n), how="cross").select("term", "df", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """query, id, score, rank; ``queries`` has query, text; each distinct term weighs 1."""
    return postings.sparse_top_k(docs, queries, k, id_col, text_col, digits)


def fused(channels: list[DataFrame], k: int, rrf_k: int = RRF_K, digits: int = 6) -> DataFrame:
    """query, id, score, rank by the sum of 1 / (rrf_k + rank) over channels."""
    both = channels[0].select("query", "id", "rank")
    for c in channels[1:]:
        both = both.unionByName(c.select("query", "id", "rank"))
    scored = both.groupBy("query", "id").agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), digits).alias("score"))
    return best(scored, k, ["query"], "id")


def hybrid_top_k(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, rrf_k: int = RRF_K, filters: dict | None = None, drop_falsy: bool = False) -> DataFrame:
    """Both channels' first 3k, fused; ``queries`` has query, text, vector.

    The filter holds inside each channel, before its first 3k are taken.
    """
    docs, vectors = (payload_filter(x, filters or {}, drop_falsy) for x in (docs, vectors))
    near = dense_top_k(vectors, queries.where("vector is not null").select("query", "vector"), PREFETCH * k)
    return fused([near, sparse_top_k(docs, queries.select("query", "text"), PREFETCH * k)], k, rrf_k)


def merged_queries(hits: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Several queries' hits as one list (of each ``by``): of each id the best row, whole, then the first k.

    Of equal scores the row of the least query stays.
    """
    rest = [c for c in hits.columns if c not in ("id", "score", "rank", *by)]
    place = [F.col("score"), *([-F.col("query")] if "query" in rest else [])]
    top = hits.groupBy(*by, "id").agg(F.max_by(F.struct("score", *rest), F.struct(*place)).alias("__best")).select(*by, "id", "__best.*")
    if by:
        return best(top, k, list(by), "id")
    return top.orderBy(F.desc("score"), "id").limit(k)


def with_citations(citations: DataFrame, hits: DataFrame, fill: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Citations with blank fields filled from the hit (of their ``by``) at ``source_number``.

    ``hits`` is a ranked top-k (column ``rank`` from 1); numbers beyond it are ignored.
    """
    named = hits.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("rank").alias("__rank"), *[F.col(c).cast("string").alias(f"__{c}") for c in fill])
    same = F.col("source_number") == F.col("__rank")
    for c in by:
        same = same & (F.col(c) == F.col(f"__by_{c}"))
    joined = citations.join(named, same, "left")
    kept = [c for c in citations.columns if c not in fill]
    return joined.select(*kept, *[F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.col(f"__{c}")).alias(c) for c in fill])


def projected(hits: DataFrame, payload: DataFrame, key: str, fields: dict) -> DataFrame:
    """Hits with payload fields or their defaults; a result is named by its point id.

    ``fields``: name -> default, as a Column or a value.
    """
    named = payload.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = hits.join(named, F.col("id") == F.col("__key"), "left")
    value = lambda c, d: F.coalesce(F.col(f"__{c}"), d if isinstance(d, Column) else F.lit(d)).alias(c)
    return joined.select(*hits.columns, uuid5(F.col("id").cast("string")).alias("chunk_id"), *[value(c, d) for c, d in fields.items()])


def keep_listed(hits: DataFrame, positions: list[int]) -> DataFrame:
    """The hits at the given positions (from 0, strange ones ignored), in that order."""
    at = {p: i for i, p in reversed(list(enumerate(positions)))}
    if not at:
        return hits.limit(0)
    place = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
    return hits.withColumn("place", F.get(F.array(place[F.col("rank") - 1]), F.lit(0))).where("place is not null").orderBy("place").drop("place")


def context(hits: DataFrame, text_col: str, most: int, first: int = 0) -> DataFrame:
    """One row: numbered passages, each of at most ``most`` characters."""
    line = F.concat(F.lit("["), (F.col("rank") - 1 + first).cast("string"), F.lit("] "), F.substring(F.col(text_col), 1, most))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


_JOINTS = re.compile(r"\s*[;?]\s*|\s+(?:and|or|versus|vs\.?|compared (?:to|with))\s+", re.IGNORECASE)


def analysed(query: str, most: int = 3) -> tuple[list[str], dict]:
    """The query itself, then the parts of a compound one (of two words at least); and the year it names, if it names one."""
    years = re.findall(r"\b(?:19|20)\d{2}\b", query)
    parts = [p for p in _JOINTS.split(query) if len(p.split()) > 1 and p != query.strip(" ?;")]
    return list(dict.fromkeys([query, *(parts if len(parts) > 1 else [])]))[:most], {"year": int(years[0])} if len(set(years)) == 1 else {}


@dataclass
class Agent:
    """Analyse, retrieve, grade, maybe once more, synthesise.

    The language-model steps are callables with deterministic defaults.
    """

    retrieve: Callable[[list[str], dict, int], DataFrame]
    analyse: Callable[[str], tuple[list[str], dict]] = lambda query: analysed(query)
    grade: Callable[[DataFrame], DataFrame] = lambda hits: hits
    synthesise: Callable[[str, DataFrame], str] = lambda query, hits: "\n".join(f"[{r['rank']}] {r['id']}" for r in hits.orderBy("rank").collect())
    cite: Callable[[str, DataFrame], DataFrame] | None = None  # source_number and what it names of each source
    fill: tuple[str, ...] = ()  # what a citation lacks and its hit has
    most_tries: int = 2
    nothing: str = "No relevant passages were found."
    failed: str = "No answer could be made."
    tried: list[dict] = field(default_factory=list)

    def ask(self, query: str, filters: dict | None = None, top_k: int = TOP_K) -> dict:
        """answer, hits, queries, citations; a query over 2000 characters or empty is refused.

        What a citation leaves blank comes from the hit that it numbers; a
        citation step that fails leaves none, a synthesis that fails says so.
        """
        if not 1 <= len(query) <= 2000:
            raise ValueError("a query has 1 to 2000 characters")
        try:
            queries, found = self.analyse(query)
        except Exception:  # a failed analysis falls back to the query itself
            queries, found = [query], {}
        for retry in range(self.most_tries):
            using = merged_filters(found, filters or {}, retry)
            self.tried.append(using)
            raw = self.retrieve(queries or [query], using, clamp(top_k))
            try:
                hits = self.grade(raw)
            except Exception:  # a failed grading keeps all
                hits = raw
            if not hits.isEmpty():
                return {"hits": hits, "queries": queries} | self._told(query, hits)
        return {"answer": self.nothing, "hits": hits, "queries": queries, "citations": None}

    def _told(self, query: str, hits: DataFrame) -> dict:
        try:
            answer = self.synthesise(query, hits)
        except Exception:  # as for the other steps, the failure is the answer
            return {"answer": self.failed, "citations": None}
        try:
            cited = self.cite(query, hits) if self.cite else None
        except Exception:
            cited = None
        if cited is None:
            return {"answer": answer, "citations": None}
        fill = [c for c in self.fill if c in hits.columns]
        missing = [c for c in fill if c not in cited.columns]
        return {"answer": answer, "citations": with_citations(cited.withColumns({c: F.lit("") for c in missing}), hits, fill)}
