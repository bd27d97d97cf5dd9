"""Embedding near-dedup by p-stable hashing.

Vectors are normalised in double precision.  Each of L tables has k Gaussian
projections; a projection x.a + b is cut into steps of width ``STEP`` and the k
step numbers are the table's key.  Two unit vectors at cosine c lie at
distance sqrt(2 - 2c) and meet in a projection with a probability known in
closed form; k is chosen from the number of vectors so that unrelated
(orthogonal) ones rarely meet, and L so that a pair just at the threshold is
missed with probability ``MISS`` at most.  Vectors that meet get an exact
cosine check.  A pair that meets in several tables counts in the first.

Equal vectors of a label form a class first, so copies are never paired.  A
bucket of over ``BLOCK`` classes is split into blocks and each pair of blocks
is a task's work, so no bucket meets whole in one task and none is cut short.

Defined results: a row whose label is null, or whose vector is null, empty,
zero or holds a null or non-finite component, links with nothing: n_links 0
and its own vec_id as component_id.  Repeated rows are vectors of their own.
A null vec_id never names a component and is not kept.  Vectors of different
lengths are not compared.  An empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .storage import kept
from .text_hash import U, mix

COSINE = 0.98
STEP = 1.0
MISS = 1e-4
BLOCK = 1024
SMALL = 24  # groups of so few rows are compared together with others of their size
CHUNK_ROWS = 20_000


def meet_probability(distance: float, step: float = STEP) -> float:
    """Chance that one quantised projection of two points is equal."""
    r = step / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(k, L) for ``n`` vectors of one label."""
    far = meet_probability(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / 0.05) / -math.log(far)))
    near = meet_probability(math.sqrt(2 - 2 * cosine)) ** k
    return k, math.ceil(math.log(miss) / math.log(1 - near))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values, offsets, which rows are usable) of an array<double> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else np.zeros(len(flat), bool)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    wrong = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    return values, at, (lengths > 0) & (wrong[at[1:]] == wrong[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & (np.arange(n) >= 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, class (null: links with nothing) of each row."""
    for batch in batches:
        values, at, good = _vectors(batch.column(2))
        labels = batch.column(1)
        good &= labels.is_valid().to_numpy(zero_copy_only=False)
        label = labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = mix((values + 0.0).view(U))
        keys = np.zeros(len(good), np.int64)
        for i in np.flatnonzero(good):
            part = bits[at[i] : at[i + 1]]
            h = mix(part + np.arange(1, len(part) + 1, dtype=U) * U(0x9E3779B97F4A7C15)).sum(dtype=U, keepdims=True)
            keys[i] = mix(h ^ mix(label[i : i + 1].view(U)) ^ U(len(part)))[0].astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, mask=~good)], names=["vec_id", "cls"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their class beside the vector."""
    for batch in batches:
        for named in _classes(iter([batch])):
            yield pa.RecordBatch.from_arrays([*batch.columns, named.column(1)], names=["vec_id", "label", "embedding", "cls"])


def _hashed(k: int, tables: int):
    """cls, label, m, embedding and the packed 32-bit keys of all tables."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        factors = mix(np.arange(1, k + 1, dtype=U))
        for batch in batches:
            values, at, _ = _vectors(batch.column(3))
            sizes, keys = np.diff(at), np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(sizes).tolist():
                if d not in drawn:
                    rng = np.random.default_rng([20240611, d])
                    drawn[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, STEP, tables * k)
                a, b = drawn[d]
                rows = np.flatnonzero(sizes == d)
                x = unit(values[(at[rows][:, None] + np.arange(d))])
                steps = np.floor((x @ a + b) / STEP).astype(np.int64).astype(U).reshape(len(rows), tables, k)
                keys[rows] = (mix((steps * factors).sum(axis=2, dtype=U)) >> U(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))], names=["cls", "label", "m", "embedding", "keys", "by_table"])

    return hashed


def _compared(tables: int, cosine: float):
    """Of each group (rows sorted by it): kind 0 (class, links), kind 1 (a, b) of a forest."""

    def pairs_of(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            e = slice(s, s + (1 << 16))
            ok[e] = np.einsum("ij,ij->i", x[i[e]], x[j[e]]) >= cosine
        return i[ok], j[ok]

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        values, at, _ = _vectors(rows["embedding"])
        dims = np.diff(at)
        cls, m, table, side = (rows[c].to_numpy() for c in ("cls", "m", "table", "side"))
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int32).reshape(-1, tables)
        group = rows["grp"].to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        left, right = [], []
        for d in np.unique(dims[starts]).tolist():
            of = np.flatnonzero(dims[starts] == d)
            x = np.zeros((len(group), d))
            mine = np.flatnonzero(dims == d)
            x[mine] = unit(values[at[mine][:, None] + np.arange(d)])
            for size in np.unique(sizes[of]).tolist():
                at_size = starts[of[sizes[of] == size]]
                if size <= SMALL:
                    p, q = np.triu_indices(size, 1)
                    found = [pairs_of(x, (at_size[:, None] + p).ravel(), (at_size[:, None] + q).ravel())]
                else:
                    found = []
                    for s in at_size.tolist():
                        for c in range(s, s + size, BLOCK):
                            p, q = np.nonzero(x[c : min(c + BLOCK, s + size)] @ x[c : s + size].T >= cosine)
                            found.append((p[p < q] + c, q[p < q] + c))
                left += [f[0] for f in found]
                right += [f[1] for f in found]
        i, j = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        across = (side[i] < 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        before = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            e = slice(s, s + (1 << 16))
            before[e] = ((keys[i[e]] == keys[j[e]]) & (np.arange(tables) < table[i[e]][:, None])).any(axis=1)
        i, j = i[~before], j[~before]
        who, where = np.unique(np.concatenate([cls[i], cls[j]]), return_inverse=True)
        links = np.bincount(where, weights=np.concatenate([m[j], m[i]]), minlength=len(who)).astype(np.int64)
        forest = Forest()
        for a, b in zip(cls[i].tolist(), cls[j].tolist(), strict=True):
            forest.join(a, b)
        nodes = [n for n in forest.up if forest.root(n) != n]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(who) + [1] * len(nodes), pa.int32()), pa.array([*who.tolist(), *nodes], pa.int64()), pa.array([*links.tolist(), *(forest.root(n) for n in nodes)], pa.int64())], names=["kind", "a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                group = rows["grp"].to_numpy(zero_copy_only=False)
                last = int(np.argmax(group == group[-1]))  # the group that may go on
                if last:
                    yield from compare(rows.slice(0, last))
                held = rows.slice(last).to_batches()
                n = len(group) - last
        if n:
            yield from compare(pa.Table.from_batches(held))

    return compared


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("embedding"))
    table = kept(rows.mapInArrow(_classes, "vec_id long, cls long"))
    n = rows.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    k, tables = tables_for(n, cosine)
    # one copy of each class's vector, found through a row of the class: an id may have other vectors too
    owners = table.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id"))["vec_id"].alias("rep"), F.count(F.lit(1)).alias("m"))
    owners = kept(owners)
    keyed = rows.mapInArrow(_keyed, "vec_id long, label long, embedding array<double>, cls long").withColumnRenamed("cls", "own")
    found = keyed.join(owners, (F.col("own") == F.col("cls")) & F.col("vec_id").eqNullSafe(F.col("rep")))
    hashed = found.select("cls", "label", "m", "embedding").mapInArrow(_hashed(k, tables), "cls long, label long, m long, embedding array<double>, keys binary, by_table array<int>")
    hashed = kept(hashed.dropDuplicates(["cls"]))
    spots = hashed.select("cls", "label", F.size("embedding").alias("d"), F.posexplode("by_table").alias("table", "key"))
    spots = spots.select("cls", "table", F.xxhash64("label", "d", "table", "key").alias("bucket"))
    shared = kept(spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("bucket").alias("b"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    met = spots.join(shared, F.col("bucket") == F.col("b")).withColumn("block", F.pmod(F.xxhash64("cls", "table"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    groups = kept(met.select(F.col("cls").alias("c"), "table", F.xxhash64("bucket", low, high).alias("grp"), side.alias("side")))
    dealt = groups.join(hashed.select("cls", "m", "embedding", "keys"), F.col("c") == F.col("cls")).select("grp", "cls", "m", "table", "side", "embedding", "keys")
    linked = kept(dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_compared(tables, cosine), "kind int, a long, b long"))
    links = linked.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    roots = components(linked.where("kind = 1").select("a", "b"))
    classes = kept(owners.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", "m", F.coalesce("component", "cls").alias("root")))
    least = kept(classes.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id")))
    named = kept(classes.join(least, F.col("root") == F.col("r")).join(links, F.col("cls") == F.col("a"), "left").select(F.col("cls").alias("of"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id"))
    done = table.join(named, F.col("cls") == F.col("of"), "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
