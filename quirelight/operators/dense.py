"""Nearest vectors by cosine: block products, and a stored inverted-file index.

Vectors travel as blocks: one row holds the ids and the unit vectors (doubles)
of many, so a task scores a block of queries against a block of the collection
by one matrix product and hands on no more than k of each pair of blocks.

The index groups vectors by their nearest of a bounded number of centroids,
fitted on a bounded sample; a list's vectors lie in blocks sorted by their
cosine with the centroid.  A search reads the lists nearest to each query, and
scores what it reads exactly; ``exact`` then goes on to every list and block
that the triangle inequality on the sphere does not rule out.

Vectors that are null, empty, zero, or hold a null or non-finite component are
no candidates and get no hits; vectors of different sizes do not meet.  Scores
are rounded before ranking, ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.snapshots import Store

BLOCK, ASKED = 4096, 256  # vectors of the collection, and queries, in a block
CELLS = 1 << 23  # components of a block at most, so that long vectors make small blocks
SAMPLE, LISTS, ROUNDS = 20_000, 4096, 8  # of the index
RECALL, TRIED, NEAREST = 0.95, 256, 10  # what its usual number of lists is to reach, for so many vectors and neighbours of the sample
SLACK = 2e-6  # more than rounding can move a score


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a list column, one of each size; strange vectors are left out."""
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    lengths = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid()) & (lengths > 0)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    begins = column.offsets.to_numpy()[:-1]
    for size in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == size))
        matrix = flat[begins[rows][:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        rows, matrix = rows[fine], matrix[fine]
        # a power of two first, so that no square overflows or vanishes
        top = np.abs(matrix).max(axis=1, initial=0.0)
        rows, matrix, top = rows[top > 0], matrix[top > 0], top[top > 0]
        matrix = np.ldexp(matrix, -np.frexp(top)[1][:, None])
        yield rows, matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]


def _id_type(df: DataFrame, column: str) -> StructField:
    return StructField("ids", ArrayType(df.schema[column].dataType))


def _matrix(blob: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dims)


class _Packer:
    """Rows gathered into blocks of one key and one size of vector."""

    def __init__(self, size: int, kind: pa.DataType) -> None:
        self.most, self.kind = size, kind
        self.held: dict[tuple, tuple[list, list]] = {}

    def add(self, key: tuple, ids: pa.Array, matrix: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
        """Blocks that are full: (key, ids, matrix, more...)."""
        place = (key, matrix.shape[1])
        size = max(1, min(self.most, CELLS // matrix.shape[1]))
        at = 0
        while at < len(matrix):
            id_parts, parts = self.held.setdefault(place, ([], []))
            room = size - sum(len(p[0]) for p in parts)
            id_parts.append(ids.slice(at, room))
            parts.append([x[at : at + room] for x in (matrix, *more)])
            at += room
            if sum(len(p[0]) for p in parts) == size:
                yield self._made(place)

    def rest(self) -> Iterator[tuple]:
        for place in list(self.held):
            yield self._made(place)

    def _made(self, place: tuple) -> tuple:
        id_parts, parts = self.held.pop(place)
        return place[0], pa.concat_arrays(id_parts), *(np.concatenate(x) for x in zip(*parts, strict=True))


def packed(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """ids, dims, data: blocks of unit vectors, made where the rows are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            packer = packer or _Packer(size, batch.column(0).type)
            for rows, matrix in unit_rows(batch.column(1)):
                for block in packer.add((), batch.column(0).take(pa.array(rows)), matrix):
                    yield _block_row(*block[1:])
        for block in packer.rest() if packer else ():
            yield _block_row(*block[1:])

    schema = StructType([_id_type(df, id_col), StructField("dims", IntegerType()), StructField("data", BinaryType())])
    return df.select(id_col, vector_col).mapInArrow(pack, schema)


def _list_of(ids: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)


def _block_row(ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_list_of(ids), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "dims", "data"])


def _orders(ids: pa.Array) -> np.ndarray:
    """Each id's place in Spark's ascending order, nulls first."""
    import pyarrow.compute as pc

    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def best_of(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k by falling score, then by the columns' order."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        rows, columns = np.nonzero(score >= least[:, None])
    else:
        rows, columns = np.nonzero(np.ones(score.shape, bool))
    by = np.lexsort((order[columns], -score[rows, columns], rows))
    rows, columns = rows[by], columns[by]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (nth < k) & (score[rows, columns] > -np.inf)
    return rows[keep], columns[keep]


def _scored(k: int, digits: int) -> object:
    """Task function over pairs of blocks: q_ids, q_data, least, ids, data, dims, near, far, toward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                value = {n: batch.column(j)[i] for j, n in enumerate(names)}
                dims = value["dims"].as_py()
                asked, found = _matrix(value["q_data"].as_py(), dims), _matrix(value["data"].as_py(), dims)
                q_ids, ids = value["q_ids"].values, value["ids"].values
                rows = np.arange(len(asked))
                if "least" in names:  # queries that this block's shell cannot help are left out
                    least = np.frombuffer(value["least"].as_py(), np.float64)
                    toward = np.arccos(np.clip(np.frombuffer(value["toward"].as_py(), np.float64), -1, 1))
                    rows = np.flatnonzero(reachable(toward, value["near"].as_py(), value["far"].as_py()) >= least - SLACK)
                if not len(rows):
                    continue
                order = _orders(ids)
                step = max(1, (1 << 20) // max(1, len(found)))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    score = np.round(asked[part] @ found.T, digits) + 0.0
                    at, column = best_of(score, order, k)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(part[at])), ids.take(pa.array(column)), pa.array(score[at, column])], names=["query", "id", "score"])

    return run


def reachable(toward: np.ndarray, near: float, far: float) -> np.ndarray:
    """The highest cosine that vectors of a shell can have with queries.

    ``toward``: angles of queries to the centroid; the shell holds angles from
    ``near`` to ``far`` (near <= far).
    """
    return np.cos(np.maximum(0.0, np.maximum(toward - far, near - toward)))


def _hits(pairs: DataFrame, k: int, digits: int) -> DataFrame:
    kinds = {f.name: f.dataType.elementType for f in pairs.schema if f.name in ("q_ids", "ids")}
    schema = StructType([StructField("query", kinds["q_ids"]), StructField("id", kinds["ids"]), StructField("score", DoubleType())])
    return pairs.mapInArrow(_scored(k, digits), schema)


def candidates(collection: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, digits: int) -> DataFrame:
    """query, id, score: of each pair of blocks the first k of each query.

    A stated set of queries meets all vectors, block by block; Spark sends the
    query blocks to all tasks only below its size threshold, and else pairs
    partitions of both sides.
    """
    asked = packed(queries, "query", "vector", ASKED).select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"))
    # not an equality: all vectors have one size, and a join by it would be one task
    pairs = packed(collection, id_col, vector_col, BLOCK).join(asked, F.abs(F.col("dims") - F.col("q_dims")) < 1)
    return _hits(pairs.drop("q_dims"), k, digits)


# ---- the index


def centroids_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors (Lloyd's rounds by cosine, from a drawn start)."""
    lists = max(1, min(lists, len(sample)))
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 1024] @ centroids.T).argmax(axis=1) for a in range(0, len(sample), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        full = length > 0
        centroids[full] = sums[full] / length[full, None]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """How many lists hold this share of the nearest neighbours of sample vectors within the sample."""
    asked = sample[:: max(1, len(sample) // TRIED)][:TRIED]
    lists = (sample @ centroids.T).argmax(axis=1)
    ranks = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    _, near = best_of(asked @ sample.T, np.arange(len(sample)), NEAREST + 1)  # each finds itself, too
    rows = np.repeat(np.arange(len(asked)), min(NEAREST + 1, len(sample)))
    needed = np.sort(ranks[rows, lists[near]])
    own = len(asked) * (len(sample) > 1)  # which counts for nothing
    return int(needed[min(len(needed) - 1, own + int(np.ceil(recall * (len(needed) - own))) - 1)]) + 1


@dataclass
class VectorIndex:
    """An inverted file in a store: tables ``name`` (blocks) and ``name_centroids``."""

    store: Store
    name: str = "vectors"

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> int:
        """Index every vector of the most common size; the number of lists.

        Centroids are fitted on about ``sample`` vectors (2 * ``sample`` at
        most), drawn by a hash of their ids.  A list that holds very many is
        cut into partitions by Spark when the blocks are made.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        sizes = rows.where("size(v) > 0").groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
        if not sizes:
            raise ValueError("no vectors to index")
        dims, n = sizes[0]
        rows = rows.where(F.size("v") == dims)
        drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n // sample))) == 0).limit(2 * sample)
        blocks = packed(drawn, "id", "v", BLOCK).select("data").collect()  # 2 * sample vectors at most
        learned = np.concatenate([_matrix(b.data, dims) for b in blocks]) if blocks else np.zeros((0, dims))
        if not len(learned):
            raise ValueError("no vectors to index")
        centroids = centroids_of(learned, lists or min(LISTS, max(1, int(np.sqrt(n)))))
        probes = probes_for(learned, centroids)
        shared = spark.sparkContext.broadcast(centroids)  # LISTS vectors at most

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                for at, matrix in unit_rows(batch.column(1)):
                    product = matrix @ c.T
                    nearest = product.argmax(axis=1)
                    toward = product[np.arange(len(matrix)), nearest]
                    unit = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), c.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), batch.column(0).take(pa.array(at)), pa.array(toward), unit], names=["list", "id", "toward", "v"])

        kind = rows.schema["id"].dataType
        placed = rows.mapInArrow(assign, StructType([StructField("list", IntegerType()), StructField("id", kind), StructField("toward", DoubleType()), StructField("v", ArrayType(DoubleType()))]))
        dealt = placed.hint("rebalance", "list").sortWithinPartitions("list", F.desc("toward"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, last = None, None
            for batch in batches:
                packer = packer or _Packer(BLOCK, batch.column(1).type)
                lists_ = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(lists_)) + 1).tolist(), len(lists_)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if last is not None and last != lists_[a]:
                        for block in packer.rest():
                            yield shell(*block)
                    last = lists_[a]
                    part = batch.slice(a, b - a)
                    v = part.column(3)
                    matrix = v.flatten().to_numpy().reshape(len(part), -1)
                    for block in packer.add((int(last),), part.column(1), matrix, part.column(2).to_numpy()):
                        yield shell(*block)
            for block in packer.rest() if packer else ():
                yield shell(*block)

        def shell(key: tuple, ids: pa.Array, matrix: np.ndarray, toward: np.ndarray) -> pa.RecordBatch:
            angles = np.arccos(np.clip(toward, -1, 1))
            row = _block_row(ids, matrix)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([float(angles.min())]), pa.array([float(angles.max())]), *row.columns], names=["list", "n", "near", "far", *row.schema.names])

        head = [StructField("list", IntegerType()), StructField("n", LongType()), StructField("near", DoubleType()), StructField("far", DoubleType())]
        made = dealt.mapInArrow(pack, StructType([*head, StructField("ids", ArrayType(kind)), StructField("dims", IntegerType()), StructField("data", BinaryType())]))
        rows_of = spark.createDataFrame([(i, dims, c.tobytes()) for i, c in enumerate(centroids)], "list int, dims int, data binary")
        with self.store.begin() as t:
            t.replace(self.name, made, "list", sort=("list",))
            t.replace(f"{self.name}_centroids", rows_of)
            t.set_mark(f"{self.name}_probes", probes)
        return len(centroids)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, digits: int = 6) -> DataFrame:
        """query, id, score, rank; ``queries`` has query, vector.

        Each query reads its ``probes`` nearest lists (unless named, as many as
        held ``RECALL`` of the sample's neighbours when the index was built).  With ``exact`` the k-th score so found rules out lists and
        blocks, and the others are read too: the same rows as without an index.
        """
        from .retrieval import best

        version = self.store.version()  # one state for all reads
        rows = self.store.read(f"{self.name}_centroids", version).orderBy("list").collect()  # LISTS at most
        dims, centroids = rows[0].dims, np.stack([np.frombuffer(r.data, np.float64) for r in rows])
        probes = max(1, min(len(rows), self.store.manifest(version)["marks"][f"{self.name}_probes"] if probes is None else probes))
        blocks = self.store.read(self.name, version)
        asked = queries.where(F.size("vector") == dims).select("query", "vector")
        near = _hits(self._pairs(asked, blocks, _nearest(centroids, probes), ("q_ids", "q_data")), k, digits)
        if not exact or probes == len(rows):
            return best(near, k, ["query"], "id")
        from ..sources.storage import work_folder

        path = work_folder(self.store.spark)
        best(near, k, ["query"], "id").write.parquet(path)  # k rows a query, read twice
        first = self.store.spark.read.parquet(path)
        least = first.where(F.col("rank") == k).select(F.col("query").alias("of"), F.col("score").alias("least"))
        bounded = asked.join(least, F.col("query").eqNullSafe(F.col("of")), "left").select("query", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        spans = {r.list: (r.near, r.far) for r in blocks.groupBy("list").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect()}  # a row a list
        further = _hits(self._pairs(bounded, blocks, _others(centroids, probes, spans), ("q_ids", "q_data", "least", "toward")), k, digits)
        return best(first.drop("rank").unionByName(further), k, ["query"], "id")

    def _pairs(self, asked: DataFrame, blocks: DataFrame, choose: object, columns: tuple[str, ...]) -> DataFrame:
        """Query blocks of each list beside the list's blocks."""
        kind = asked.schema["query"].dataType
        fields = {"q_ids": ArrayType(kind), "q_data": BinaryType(), "least": BinaryType(), "toward": BinaryType()}
        chosen = asked.mapInArrow(choose, StructType([StructField("list", IntegerType()), StructField("query", kind), StructField("unit", ArrayType(DoubleType())), StructField("least", DoubleType()), StructField("toward", DoubleType())]))
        dealt = chosen.hint("rebalance", "list").sortWithinPartitions("list")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, last = None, None
            for batch in batches:
                packer = packer or _Packer(ASKED, batch.column(1).type)
                lists = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if last is not None and last != lists[a]:
                        for block in packer.rest():
                            yield row(*block)
                    last = lists[a]
                    part = batch.slice(a, b - a)
                    for block in packer.add((int(last),), part.column(1), part.column(2).flatten().to_numpy().reshape(len(part), -1), part.column(3).to_numpy(), part.column(4).to_numpy()):
                        yield row(*block)
            for block in packer.rest() if packer else ():
                yield row(*block)

        def row(key: tuple, ids: pa.Array, matrix: np.ndarray, least: np.ndarray, toward: np.ndarray) -> pa.RecordBatch:
            values = {"q_ids": _list_of(ids), "q_data": pa.array([matrix.tobytes()], pa.binary()), "least": pa.array([least.tobytes()], pa.binary()), "toward": pa.array([toward.tobytes()], pa.binary())}
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), *(values[c] for c in columns)], names=["of", *columns])

        asked_blocks = dealt.mapInArrow(pack, StructType([StructField("of", IntegerType()), *[StructField(c, fields[c]) for c in columns]]))
        return blocks.join(asked_blocks, F.col("list") == F.col("of")).drop("of", "list", "n")


def _chosen(picked: np.ndarray, at: np.ndarray, batch: pa.RecordBatch, unit: np.ndarray, least: np.ndarray, product: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each query and list that ``picked`` (queries x lists) names."""
    rows, lists = np.nonzero(picked)
    for a in range(0, len(rows), 8192):
        r, c = rows[a : a + 8192], lists[a : a + 8192]
        v = pa.FixedSizeListArray.from_arrays(pa.array(unit[r].ravel()), unit.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), batch.column(0).take(pa.array(at[r])), v, pa.array(least[r]), pa.array(product[r, c])], names=["list", "query", "unit", "least", "toward"])


def _probed(product: np.ndarray, probes: int) -> np.ndarray:
    picked = np.zeros(product.shape, bool)
    np.put_along_axis(picked, np.argsort(-product, axis=1, kind="stable")[:, :probes], True, axis=1)
    return picked


def _nearest(centroids: np.ndarray, probes: int) -> object:
    """Each query with its nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in unit_rows(batch.column(1)):
                product = unit @ centroids.T
                yield from _chosen(_probed(product, probes), at, batch, unit, np.full(len(at), -2.0), product)

    return run


def _others(centroids: np.ndarray, probes: int, spans: dict[int, tuple[float, float]]) -> object:
    """Each query with the lists beyond its nearest that can still hold a hit."""
    lists = sorted(spans)
    near, far = (np.array([spans[i][k] for i in lists]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least_of = batch.column(2).to_numpy()
            for at, unit in unit_rows(batch.column(1)):
                product = unit @ centroids.T
                toward = np.arccos(np.clip(product[:, lists], -1, 1))
                bound = np.cos(np.maximum(0.0, np.maximum(toward - far, near - toward)))
                open_ = np.zeros(product.shape, bool)
                open_[:, lists] = bound >= least_of[at][:, None] - SLACK
                yield from _chosen(open_ & ~_probed(product, probes), at, batch, unit, least_of[at], product)

    return run
