"""Tables whose states change together: data files, and one manifest a state.

A manifest names the folders of every table, by bucket of a hash of a column.
A transaction writes new folders beside the old ones, then publishes them all
by creating the next manifest, which only one writer can.  A reader opens one
manifest and so sees one state; a run that dies has published nothing, and its
folders are named nowhere.  Changes by key rewrite only the buckets that hold
one of the keys (copy on write); the manifest keeps the others' folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import Storage

BUCKETS = 64
_EMPTY = {"version": 0, "tables": {}, "marks": {}}


class Conflict(RuntimeError):
    """Another writer has published a change to the same buckets or marks."""


def bucket(by: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by)), F.lit(buckets)).cast("int")


@dataclass
class Store:
    """Tables and marks (small values that change with them) under a root."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.files = Storage(self.spark, self.root)

    def version(self) -> int:
        return max((int(name.removesuffix(".json")) for name in self.files.names("manifests") if name.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.text(f"manifests/{version:012d}.json")) if version else json.loads(json.dumps(_EMPTY))

    def exists(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def mark(self, name: str) -> object:
        return self.manifest()["marks"].get(name)

    def read(self, name: str, version: int | None = None, values: list | None = None) -> DataFrame:
        """A table's rows at one state; with ``values``, only the files that can hold these of the bucket column."""
        table = self.manifest(version)["tables"].get(name)
        if table is None:
            raise KeyError(name)
        if values is None:
            return self._rows(table, table["parts"])
        kind = next(f.dataType for f in StructType.fromJson(table["schema"]).fields if f.name == table["by"])
        asked = self.spark.createDataFrame([(v,) for v in values], StructType().add(table["by"], kind))
        wanted = {str(r[0]) for r in asked.select(bucket(table["by"], table["buckets"])).distinct().collect()}
        rows = self._rows(table, {b: table["parts"][b] for b in table["parts"] if b in wanted})
        return rows.where(F.col(table["by"]).isin(list(values)))

    def beside(self, name: str, changes: DataFrame) -> DataFrame:
        """A table's rows in the buckets that ``changes`` (which has the bucket column) touches."""
        table = self.manifest()["tables"][name]
        touched = {str(r[0]) for r in changes.select(bucket(table["by"], table["buckets"])).distinct().collect()}
        return self._rows(table, {b: f for b, f in table["parts"].items() if b in touched})

    def _rows(self, table: dict, parts: dict[str, list[str]]) -> DataFrame:
        folders = sorted(f"{self.root}/{f}" for some in parts.values() for f in some)
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last ``keep``, and folders that these do not name; how many folders.

        Not to be run beside a writer: what it has written but not published is named nowhere.
        """
        versions = sorted(int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json"))
        live = {f for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for some in t["parts"].values() for f in some}
        for v in versions[:-keep]:
            self.files.delete(f"manifests/{v:012d}.json")
        gone = []
        for top in (f"data/{n}" for n in self.files.names("data")):
            if top not in live:
                inner = [f"{top}/{n}" for n in self.files.names(top) if n.startswith("__bucket=")]
                gone += [f for f in inner if f not in live] if live & set(inner) else [top]
        return sum(self.files.delete(f) for f in gone)


@dataclass
class Transaction:
    """Changes to some tables, all published by ``commit`` or, as a context, at its end."""

    store: Store
    base: dict
    changed: dict[str, dict] = field(default_factory=dict)  # table -> what it is to be
    replaced: dict[str, set[str]] = field(default_factory=dict)  # table -> buckets read and rewritten
    added: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    marks: dict[str, object] = field(default_factory=dict)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.commit()

    def _table(self, name: str) -> dict | None:
        return self.changed.get(name) or self.base["tables"].get(name)

    def _staged(self, df: DataFrame, by: str | None, buckets: int, sort: tuple[str, ...] = ()) -> dict[str, list[str]]:
        """Folders of ``df`` by bucket; a large bucket is several tasks and files."""
        folder = f"data/{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(f"{self.store.root}/{folder}")
            return {"": [folder]}
        # AQE cuts large buckets and joins small ones
        dealt = df.withColumn("__bucket", bucket(by, buckets)).hint("rebalance", "__bucket")
        dealt.sortWithinPartitions("__bucket", *sort).write.partitionBy("__bucket").parquet(f"{self.store.root}/{folder}")
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in self.store.files.names(folder) if n.startswith("__bucket=")}

    def replace(self, name: str, df: DataFrame, by: str | None = None, buckets: int = BUCKETS, sort: tuple[str, ...] = ()) -> None:
        """All rows of a table, new or not, laid out by buckets of ``by``."""
        self.changed[name] = {"schema": df.schema.jsonValue(), "by": by, "buckets": buckets, "sort": list(sort), "parts": self._staged(df, by, buckets, sort)}
        self.replaced[name] = {"*"}

    def append(self, name: str, df: DataFrame, by: str | None = None, buckets: int = BUCKETS) -> None:
        """More rows of a table, which may be a new one; those that it has are not read."""
        table = self._table(name)
        if table is None:
            self.replace(name, df, by, buckets)
            self.replaced[name] = set()
            self.added[name] = self.changed[name]["parts"]
            return
        new = self._staged(df.select(*StructType.fromJson(table["schema"]).names), table["by"], table["buckets"], tuple(table["sort"]))
        parts = {b: table["parts"].get(b, []) + new.get(b, []) for b in {*table["parts"], *new}}
        mine = self.added.setdefault(name, {})
        self.added[name] = {b: mine.get(b, []) + new.get(b, []) for b in {*mine, *new}}
        self.changed[name] = table | {"parts": parts}

    def upsert(self, name: str, df: DataFrame, key: str, order: list[str] | None = None) -> None:
        """Rows of ``df`` in place of those with their keys; of a repeated key the last by ``order``."""
        from ..operators.ingest import upserted

        self._merged(name, df, lambda stored, new: upserted(stored, new, key, order).drop(*(c for c in order or [] if c not in stored.columns)))

    def delete(self, name: str, gone: DataFrame, key: str) -> None:
        from ..operators.ingest import deleted

        self._merged(name, gone, lambda stored, new: deleted(stored, new, key))

    def update(self, name: str, changes: DataFrame, key: str) -> None:
        """The values that ``changes`` (one row a key) gives; null is no change."""
        from ..operators.ingest import updated

        self._merged(name, changes, lambda stored, new: updated(stored, new, key))

    def merge(self, name: str, changes: DataFrame, how: object) -> None:
        """``how(stored, changes)`` of the buckets that ``changes`` touches, in their place; it must keep rows in their buckets."""
        self._merged(name, changes, how)

    def _merged(self, name: str, changes: DataFrame, how: object) -> None:
        table, store = self._table(name), self.store
        if table is None:
            raise KeyError(name)
        if table["by"] is None or table["by"] not in changes.columns:
            raise ValueError(f"{name} is changed through its bucket column, {table['by']}")
        aside = f"data/{uuid.uuid4().hex}"
        changes.write.parquet(f"{store.root}/{aside}")  # computed once, read twice
        new = store.spark.read.schema(changes.schema).parquet(f"{store.root}/{aside}")
        touched = {str(r[0]) for r in new.select(bucket(table["by"], table["buckets"])).distinct().collect()}  # ``buckets`` rows at most
        stored = store._rows(table, {b: f for b, f in table["parts"].items() if b in touched})
        rows = how(stored, new)
        written = self._staged(rows, table["by"], table["buckets"], tuple(table["sort"]))
        if strange := set(written) - touched:
            raise ValueError(f"a change of {name} moved rows to other buckets: {sorted(strange)}")
        kept = {b: f for b, f in table["parts"].items() if b not in touched}
        self.changed[name] = table | {"schema": rows.schema.jsonValue(), "parts": kept | written}
        self.replaced[name] = self.replaced.get(name, set()) | touched
        store.files.delete(aside)

    def set_mark(self, name: str, value: object) -> None:
        self.marks[name] = value

    def commit(self) -> int:
        """Publish; the new version.  Rows appended, and buckets rewritten that nobody else changed, go over another writer's state."""
        while True:
            latest = self.store.manifest()
            version = latest["version"] + 1
            tables = dict(latest["tables"])
            for name, table in self.changed.items():
                tables[name] = self._over(name, table, latest["tables"].get(name))
            for name in self.marks:
                if latest["marks"].get(name) != self.base["marks"].get(name):
                    raise Conflict(f"mark {name} has changed")
            body = {"version": version, "tables": tables, "marks": latest["marks"] | self.marks}
            if self.store.files.create(f"manifests/{version:012d}.json", json.dumps(body).encode()):
                self.base = body
                return version

    def _over(self, name: str, table: dict, now: dict | None) -> dict:
        was, touched = self.base["tables"].get(name), self.replaced.get(name, set())
        if now == was:
            return table
        if "*" in touched or now is None:
            raise Conflict(f"{name} has changed")
        before = (was or {"parts": {}})["parts"]
        if any(now["parts"].get(b) != before.get(b) for b in touched):
            raise Conflict(f"{name} has changed in the same buckets")
        own = self.added.get(name, {})
        parts = {b: table["parts"].get(b, []) if b in touched else now["parts"].get(b, []) + own.get(b, []) for b in {*now["parts"], *table["parts"]}}
        return now | {"schema": table["schema"], "parts": {b: f for b, f in parts.items() if f}}
