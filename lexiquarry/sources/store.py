"""A keyed table of documents in versions: append, upsert, delete and point-in-time readers.

A commit writes what it changes only, as a folder of new rows or of deleted keys, and then a file that lists the folders
of its version in order; that file's creation is the commit, so a version is whole or not there, and of two writers that
commit the same version one fails. Readers fold the folders of a version and are not disturbed by later commits.
`compact` writes a version as one folder; `merge_after` does so on its own once a version has that many. Old versions
stay until they are pruned; versions that a reader pinned stay until it lets go.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.sources.shared import file_system


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, merge_after: int = 20):
        self.spark, self.path, self.schema, self.key, self.merge_after = spark, path.rstrip("/"), schema, key, merge_after

    def _fs(self, sub: str):
        return file_system(self.spark, f"{self.path}/{sub}")

    def versions(self) -> list[int]:
        fs, p = self._fs("commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _steps(self, version: int) -> list[tuple[str, str]]:
        """(kind, folder) of a version in order; kinds: base, append, upsert, delete."""
        fs, p = self._fs(f"commits/{version}")
        f = fs.open(p)
        text = bytes(f.readAllBytes()).decode()
        f.close()
        return [tuple(x) for x in json.loads(text)]

    def _commit(self, changes: list[tuple[str, DataFrame]], base: bool = False) -> int:
        """Writes the changes as one version behind those there are, or in their place."""
        have = self.versions()
        steps = [] if base or not have else self._steps(have[-1])
        for kind, rows in changes:
            folder = f"data/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            steps.append((kind, folder))
        version = (have or [0])[-1] + 1
        fs, p = self._fs(f"commits/{version}")
        if fs.exists(p):
            raise Conflict(version)
        try:
            f = fs.create(p, False)
        except Exception as e:
            raise Conflict(version) from e
        f.write(bytearray(json.dumps(steps).encode()))
        f.close()
        return self.compact() if len(steps) > self.merge_after and not base else version

    def compact(self, *order: str) -> int:
        """The same rows as one folder, sorted by columns if any are given."""
        rows = self.read()
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        return self._commit([("base", rows)], True)

    def create(self) -> int:
        """An empty table, in place of what was there."""
        fs, p = self._fs("commits")
        fs.delete(p, True)
        return self._commit([("base", self.spark.createDataFrame([], self.schema))], True)

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise ValueError(f"no version {version}")
        rows = None
        for kind, folder in self._steps(version or have[-1]):
            if kind == "delete":
                gone = self.spark.read.schema(T.StructType([self.schema[self.key]])).parquet(f"{self.path}/{folder}")
                rows = rows.join(gone, self.key, "left_anti")
                continue
            new = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
            if kind == "upsert":
                rows = rows.join(new.select(self.key), self.key, "left_anti").select(*self.schema.names)
            rows = new if rows is None else rows.unionByName(new)
        return rows.select(*self.schema.names)

    def append(self, rows: DataFrame) -> int:
        return self._commit([("append", rows.select(*self.schema.names))])

    def last(self, rows: DataFrame, order: Column | None) -> DataFrame:
        """Of several rows of a key the last by order; without an order they are an error."""
        if order is None:
            if not rows.groupBy(self.key).count().where("count > 1").isEmpty():
                raise ValueError("several rows of a key need an order")
            return rows
        rank = F.row_number().over(Window.partitionBy(self.key).orderBy(order.desc()))
        return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")

    def upsert(self, rows: DataFrame, order: Column | None = None) -> int:
        """Rows replace those of the same key; of several new rows of a key the last by order stays."""
        return self.change(rows, None, order)

    def change(self, rows: DataFrame, deleted: Column | None, order: Column | None = None) -> int:
        """Upserts and deletes in one version: the last change of each key holds."""
        rows = self.last(rows, order)
        if deleted is None:
            return self._commit([("upsert", rows.select(*self.schema.names))])
        gone = F.coalesce(deleted, F.lit(False))
        return self._commit([("delete", rows.where(gone).select(self.key)), ("upsert", rows.where(~gone).select(*self.schema.names))])

    def delete(self, keys: DataFrame) -> int:
        """Keys that aren't there are no error."""
        return self._commit([("delete", keys.select(self.key).distinct())])

    def delete_where(self, test: Column) -> int:
        return self._commit([("delete", self.read().where(F.coalesce(test, F.lit(False))).select(self.key))])

    def update(self, test: Column, **values: Column) -> int:
        """New values for columns of the rows that pass a test."""
        rows = self.read().where(F.coalesce(test, F.lit(False))).withColumns(values)
        return self._commit([("upsert", rows.select(*self.schema.names))])

    def sort(self, *order: str) -> int:
        """The same rows in files sorted by these columns, whose ranges then prune reads."""
        return self.compact(*order)

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows for keys, and `found`."""
        rows = self.read().withColumn("found", F.lit(True))
        return keys.select(self.key).join(rows, self.key, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("rows"), F.countDistinct(self.key).alias("keys"), F.count(F.when(F.col(self.key).isNull(), 1)).alias("without_key"))

    def check(self) -> None:
        """Raises if a key is missing or stands twice."""
        r = self.stats().first()
        if r["without_key"] or r["rows"] != r["keys"]:
            raise ValueError(f"{r['without_key']} rows without a key, {r['rows'] - r['keys']} repeated")

    def pinned(self) -> set[int]:
        fs, p = self._fs("pins")
        return {int(x.getPath().getName().split("-")[0]) for x in fs.listStatus(p)} if fs.exists(p) else set()

    def prune(self, keep: int = 1) -> list[int]:
        """Removes all but the last versions and the pinned ones, and the folders that no version reads any more."""
        have, pins = self.versions(), self.pinned()
        gone = [v for v in have[:-keep] if v not in pins]
        stay = {folder for v in have if v not in gone for _, folder in self._steps(v)}
        lost = {folder for v in gone for _, folder in self._steps(v)} - stay
        for sub in [f"commits/{v}" for v in gone] + sorted(lost):
            fs, p = self._fs(sub)
            fs.delete(p, True)
        return gone


class Searcher:
    """A reader that is refreshed on request: searches go on with the version they began with."""

    def __init__(self, store: Store, warm=None):
        self.store, self.warm, self.listeners = store, warm, []
        self.version = store.versions()[-1]
        self.held: dict[int, tuple[float, str]] = {}

    def rows(self, token: int | None = None) -> DataFrame:
        return self.store.read(token or self.version)

    def record(self) -> int:
        """A token that keeps this version readable: pruning the store leaves it until `prune` of this reader lets it go."""
        if self.version not in self.held:
            name = f"pins/{self.version}-{uuid.uuid4().hex}"
            fs, p = self.store._fs(name)
            fs.create(p, False).close()
            self.held[self.version] = time.time(), name
        return self.version

    def prune(self, age: float) -> None:
        """Lets go of the versions recorded longer ago than age (seconds), but the current one."""
        for v, (t, name) in list(self.held.items()):
            if time.time() - t > age and v != self.version:
                fs, p = self.store._fs(name)
                fs.delete(p, False)
                del self.held[v]

    def maybe_refresh(self) -> bool:
        newest = self.store.versions()[-1]
        if newest == self.version:
            return False
        self.version = newest
        if self.warm:
            self.warm(self.rows())
        for listener in self.listeners:
            listener(newest)
        return True
