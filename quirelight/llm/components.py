"""Connected components of a graph too large for one task.

Edges are first contracted inside each partition by union-find, then large-
and small-star steps alternate until nothing changes (Kiveris et al., 2014).
No step gathers the neighbours of a node: minima are aggregated with partial
sums, stored, and joined back, so Spark can split a hub's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, kept, written


class Forest:
    """Union-find whose roots are the least of their trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def out() -> pa.RecordBatch:
        nodes = [x for x in forest.up if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(u, v)
        if len(forest.up) > 2_000_000:  # bounded memory; what is left to do is done by the steps
            yield out()
            forest.up.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that is not the least of its component.

    ``edges`` has two long columns; loops and nulls are ignored.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    pairs = edges.where((a != b) & a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    state = kept(pairs.mapInArrow(_contract, "u long, v long").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
    seen = mark(state)
    spark, matched = edges.sparkSession, F.col("u") == F.col("k")
    while True:
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = kept(both.where("v > u").join(least, matched).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        dropped(spark, path)
        least, path = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        small = large.join(least, matched).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = kept(small.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        dropped(spark, path)
        now = mark(state)
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
