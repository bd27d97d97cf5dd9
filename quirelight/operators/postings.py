"""A stored inverted index for lexical search.

Documents are inverted where they are read: a segment is a few thousand
documents, and gives a row a term with the places and counts of the term's
documents in the segment (small whole numbers) and the highest weight any of
them has; one more row holds the segment's ids and lengths.  Nothing is
shuffled to build a segment, and equal terms of many documents never meet.
``Index.build`` then stores the rows by buckets of the term, sorted by term.

A search reads the rows of the terms that are asked.  It first reads only their
highest weights: what a segment can add to a query at most is the sum over the
query's terms.  The segments that promise most are scored first; others are
scored only if their promise reaches the k-th score found (max score).  Scores
are sums of weight times inverse frequency, rounded before ranking.

Null texts have no terms; a document without any is in no posting but counts
in the number of documents.  Queries without a known term have no hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..sources.snapshots import BUCKETS, Store
from ..sources.storage import work_folder
from .dense import _orders, best_of

SEGMENT_DOCS, SEGMENT_TOKENS = 4096, 1 << 21
ASKED = 1024  # queries that one task scores at once
AT_ONCE = 32  # segments that are scored without ruling any out
FIRST = 2  # segments a query scores before others are ruled out
FEW = 100_000  # terms that are sent to all tasks
SLACK = 2e-6  # more than rounding can move a score
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0
TERM = "[a-z0-9]+"
LONG = 1 << 20  # characters of a text whose terms are counted one by one
_FIND, _EACH = re.compile(TERM).findall, re.compile(TERM).finditer


def weights_of(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Saturated term frequencies."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / AVERAGE_LENGTH))


def _head(id_kind: object) -> StructType:
    return StructType([
        StructField("segment", StringType()), StructField("term", StringType()), StructField("n", LongType()), StructField("top", DoubleType()),
        StructField("at", BinaryType()), StructField("tf", BinaryType()), StructField("ids", ArrayType(id_kind)), StructField("lengths", BinaryType()),
    ])


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[str] | None = None, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Posting rows and, with a null term, a row of ids and lengths for each segment."""
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    kind = rows.schema["id"].dataType

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return inverted(batches, TaskContext.get().partitionId(), only, segment_docs, SEGMENT_TOKENS)

    return rows.mapInArrow(invert, _head(kind))


def inverted(batches: Iterator[pa.RecordBatch], task: int, only: frozenset[str] | None = None, segment_docs: int = SEGMENT_DOCS, segment_tokens: int = SEGMENT_TOKENS) -> Iterator[pa.RecordBatch]:
    """``segments`` of one task's ids and texts.

    Terms are counted within a text; what is held of a segment is its terms
    once, and 8 bytes for each term of each text.
    """
    nth = 0
    known: dict[str, int] = {}
    codes, counts, sizes, lengths, ids, held = [], [], [], [], [], 0

    def made(id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        name, schema, length, n_docs = f"{task:06d}-{nth:06d}", batch_schema(id_kind), np.array(lengths, np.uint32), len(ids)
        yield _table([(name, None, n_docs, 0.0, None, None, ids, length.tobytes())], schema)
        # codes are narrow and documents come in order: a stable order by code is one by document, too
        code = np.concatenate([np.zeros(0, np.int32), *codes])
        order = np.argsort(code, kind="stable")
        begins = np.searchsorted(code, np.arange(len(known) + 1), sorter=order)
        at = np.repeat(np.arange(n_docs, dtype=np.uint16), sizes)[order]
        tf = np.concatenate([np.zeros(0, np.uint32), *counts])[order]
        del code, order
        codes.clear()
        counts.clear()
        weight = np.empty(len(tf))
        for a in range(0, len(tf), 1 << 16):
            some = slice(a, a + (1 << 16))
            weight[some] = weights_of(tf[some].astype(float), length[at[some]].astype(float))
        tops = np.maximum.reduceat(weight, begins[:-1]) if len(tf) else np.zeros(0)
        del weight
        words = sorted(known)
        for a in range(0, len(words), 8192):
            part = [(w, known[w]) for w in words[a : a + 8192]]
            yield _table([(name, w, int(begins[c + 1] - begins[c]), float(tops[c]), at[begins[c] : begins[c + 1]].tobytes(), tf[begins[c] : begins[c + 1]].tobytes(), None, None) for w, c in part], schema)

    for batch in batches:
        id_kind = batch.schema.field(0).type
        for one, text in zip(batch.column(0), batch.column(1), strict=True):
            found = _counted(text.as_py() or "")
            lengths.append(sum(found.values()))
            if only is not None:
                found = {t: n for t, n in found.items() if t in only}
            codes.append(np.fromiter((known.setdefault(t, len(known)) for t in found), np.int32, len(found)))
            counts.append(np.fromiter(found.values(), np.uint32, len(found)))
            sizes.append(len(found))
            ids.append(one.as_py())  # a slice would hold the whole batch
            held += sum(found.values())
            if len(ids) == segment_docs or held > segment_tokens:
                yield from made(id_kind)
                known, nth = {}, nth + 1
                codes, counts, sizes, lengths, ids, held = [], [], [], [], [], 0
    if ids:
        yield from made(id_kind)


def _counted(text: str) -> Counter:
    """A text's terms and how often each comes; the terms of a long one are never all held."""
    return Counter(_FIND(text) if len(text) < LONG else (m[0] for m in _EACH(text)))


def batch_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("segment", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("top", pa.float64()), ("at", pa.binary()), ("tf", pa.binary()), ("ids", pa.list_(kind)), ("lengths", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def asked_terms(queries: DataFrame) -> DataFrame:
    """query, term: the distinct terms of each query's text."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    return queries.select("query", F.explode(F.array_distinct(words)).alias("term"))


def ranked(rows: DataFrame, queries: DataFrame, k: int, n_docs: int, n_segments: int, digits: int = 6) -> DataFrame:
    """query, id, score, rank over stored ``segments`` rows, of so many documents in so many segments.

    Few segments are all scored at once; of more, only those that can hold a hit.
    """
    from .retrieval import best

    spark, many = rows.sparkSession, queries.count()
    folder = work_folder(spark)
    asked = asked_terms(queries)
    # the columns of a row but its places: what the search is planned by
    heads = rows.where("term is not null").select("segment", "term", "n", "top").join(asked.select("term").distinct(), "term", "left_semi")
    frequency = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = frequency.select("term", F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked.join(idf, "term").write.parquet(f"{folder}/weighed")
    weighed = spark.read.parquet(f"{folder}/weighed")
    if n_segments <= AT_ONCE:
        every = rows.where("term is null").select("segment").crossJoin(queries.select("query").distinct())  # AT_ONCE rows a query at most
        return best(_scores(rows, weighed, every, many, k, digits), k, ["query"], "id")
    heads.join(weighed, "term").groupBy("query", "segment").agg(F.sum(F.col("top") * F.col("idf")).alias("promise")).write.parquet(f"{folder}/promised")
    promised = spark.read.parquet(f"{folder}/promised")
    first = best(promised, FIRST, ["query"], "segment", "promise").select("query", "segment")
    _scores(rows, weighed, first, many, k, digits).write.parquet(f"{folder}/first")
    found = spark.read.parquet(f"{folder}/first")
    least = best(found, k, ["query"], "id").where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    others = promised.join(first, ["query", "segment"], "left_anti").join(least, "query", "left")
    left = others.where(F.col("least").isNull() | (F.col("promise") >= F.col("least") - SLACK)).select("query", "segment")
    return best(found.unionByName(_scores(rows, weighed, left, many, k, digits)), k, ["query"], "id")


def _scores(rows: DataFrame, weighed: DataFrame, wanted: DataFrame, many: int, k: int, digits: int) -> DataFrame:
    """query, id, score: the first k of each wanted query and segment.

    A task takes a segment and about ``ASKED`` of the ``many`` queries: the
    segment's rows of their terms, each once, and which queries ask them.
    """
    kinds = {f.name: f.dataType for f in weighed.schema}
    id_kind = next(f.dataType.elementType for f in rows.schema if f.name == "ids")
    counted = wanted.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(-(-many // ASKED) or 1)).cast("int"))
    asks = counted.join(weighed, "query").groupBy("segment", "part", "term").agg(F.collect_list(F.struct("query", "idf")).alias("asks"))  # one part's queries at most
    places = rows.where("term is not null").select("segment", "term", "at", "tf").join(asks, ["segment", "term"])
    heads = rows.where("term is null").select("segment", "ids", "lengths").join(counted.select("segment", "part").distinct(), "segment")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asks_kind = asks.schema["asks"].dataType
    every = heads.select("segment", "part", none("term", "string"), none("at", "binary"), none("tf", "binary"), none("asks", asks_kind), "ids", "lengths").unionByName(
        places.select("segment", "part", "term", "at", "tf", "asks", none("ids", ArrayType(id_kind)), none("lengths", "binary"))
    )
    dealt = every.repartition("segment", "part").sortWithinPartitions("segment", "part", F.asc_nulls_first("term"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, length, sums = None, None, None, {}

        def made() -> Iterator[pa.RecordBatch]:
            if not sums:
                return
            order = _orders(ids)
            for query, (total, touched) in sums.items():
                have = np.flatnonzero(touched)
                value = np.round(total[have], digits) + 0.0
                _, at = best_of(value[None, :], order[have], k)
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(at), query_type), ids.take(pa.array(have[at])), pa.array(value[at])], names=["query", "id", "score"])

        query_type = None
        for batch in batches:
            query_type = batch.schema.field("asks").type.value_type.field("query").type
            for row in range(batch.num_rows):
                value = {n: batch.column(j)[row] for j, n in enumerate(batch.schema.names)}
                here = value["segment"].as_py(), value["part"].as_py()
                if here != key:
                    yield from made()
                    key, sums = here, {}
                if value["ids"].is_valid:
                    ids = value["ids"].values
                    ids = ids.take(pa.array(np.arange(len(ids))))  # a copy: a view would hold the whole batch
                    length = np.frombuffer(value["lengths"].as_py(), np.uint32).astype(float)
                    continue
                at = np.frombuffer(value["at"].as_py(), np.uint16)
                weight = weights_of(np.frombuffer(value["tf"].as_py(), np.uint32).astype(float), length[at])
                for ask in value["asks"].as_py():
                    if ask["query"] not in sums:
                        sums[ask["query"]] = np.zeros(len(ids)), np.zeros(len(ids), bool)
                    total, touched = sums[ask["query"]]
                    total[at] += weight * ask["idf"]
                    touched[at] = True
        yield from made()

    return dealt.mapInArrow(score, StructType([StructField("query", kinds["query"]), StructField("id", id_kind), StructField("score", DoubleType())]))


@dataclass
class Index:
    """An inverted index in a store, as table ``name``."""

    store: Store
    name: str = "postings"

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
        """Index all documents; segments are made once, then laid out by term."""
        path = work_folder(self.store.spark)
        sizes = _stored(segments(docs, id_col, text_col), path)
        # the rows of ids are few; they go by segment, to all buckets alike
        rows = self.store.spark.read.parquet(path).withColumn("place", F.coalesce("term", "segment"))
        with self.store.begin() as t:
            t.replace(self.name, rows, "place", buckets, ("term",))
            t.set_mark(f"{self.name}_sizes", sizes)
        self.store.files.drop(path)

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """query, id, score, rank; ``queries`` has query, text."""
        version = self.store.version()  # one state for both reads
        return ranked(self.store.read(self.name, version).drop("place"), queries, k, *self.store.manifest(version)["marks"][f"{self.name}_sizes"], digits)

    def lookup(self, terms: list[str]) -> DataFrame:
        """The posting rows of a few terms: only their buckets' files are read."""
        return self.store.read(self.name, values=terms).where("term is not null").drop("place")


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """The same over documents without an index: segments are made for the search, of the asked terms if these are few."""
    path = work_folder(docs.sparkSession)
    terms = [r.term for r in asked_terms(queries).select("term").distinct().limit(FEW + 1).collect()]
    sizes = _stored(segments(docs, id_col, text_col, frozenset(terms) if len(terms) <= FEW else None), path)
    return ranked(docs.sparkSession.read.parquet(path), queries, k, *sizes, digits)


def _stored(rows: DataFrame, path: str) -> list[int]:
    """Write segments; how many documents and segments, counted on the way."""
    seen, own = Observation(), F.col("term").isNull()
    rows.observe(seen, F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("docs"), F.count_if(own).alias("segments")).write.parquet(path)
    return [int(seen.get["docs"]), int(seen.get["segments"])]
