"""Stored tables that change together: hash-bucketed copy-on-write data, versioned manifests, a ledger of batches.

A store is a folder. Its tables' rows lie in buckets by a hash of their key; a change rewrites the buckets that it touches into files of
the next version and leaves the files of all others where they are. What makes a version is its manifest, which names
for each table the folder of each bucket and for each source of batches the last batch that it holds. A manifest appears by one
rename, so all tables change at once or not at all: a batch killed before leaves files that no manifest names, which its next run
overwrites, and a batch that is already in the ledger is not run again.

One writer at a time; readers may go on reading the version that they opened until `expire` drops it. The folder must be one whose rename is
atomic for a file, and shared by all executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StoredTable:
    """Schema of a table and the key that its buckets come from. Without a key, rows are only appended."""

    schema: str
    key: str | None = None


@dataclass
class Manifest:
    version: int = 0
    #: Last batch of each source.
    batches: dict[str, int] = field(default_factory=dict)
    #: For each table the folders of its buckets, or of what was appended.
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class SnapshotStore:
    """Tables under a folder; see the module."""

    def __init__(self, folder: str, tables: dict[str, StoredTable], buckets: int = 32) -> None:
        self.folder, self.tables, self.buckets = folder.rstrip("/"), tables, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession) -> list[int]:
        fs, at = _files(spark, f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, spark: SparkSession, version: int | None = None) -> Manifest:
        """That of a version, or the newest; an empty one before the first."""
        if version is None:
            version = max(self.versions(spark), default=0)
        if not version:
            return Manifest()
        fs, at = _files(spark, f"{self.folder}/manifests/{version}.json")
        stream = fs.open(at)
        try:
            return Manifest(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, spark: SparkSession, name: str, manifest: Manifest | None = None, some: set[int] | None = None) -> DataFrame:
        """A table of a version, the newest if none is given; only some of its buckets, if asked for."""
        held = (manifest or self.manifest(spark)).tables.get(name, {})
        paths = [path for k, path in held.items() if some is None or int(k) in some]
        schema = self.tables[name].schema
        return spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)

    def expire(self, spark: SparkSession, keep: int = 2) -> None:
        """Drop all versions but the last ones, and the files that only they name."""
        versions = self.versions(spark)
        named = {p.rsplit("/", 1)[0] for v in versions[-keep:] for held in self.manifest(spark, v).tables.values() for p in held.values()}
        for v in versions[:-keep]:
            fs, at = _files(spark, f"{self.folder}/manifests/{v}.json")
            fs.delete(at, False)
        for name in self.tables:
            fs, at = _files(spark, f"{self.folder}/data/{name}")
            for f in fs.listStatus(at) if fs.exists(at) else []:
                of = int(f.getPath().getName().removeprefix("v"))
                if of <= versions[-1] and f"data/{name}/v{of}" not in named:
                    fs.delete(f.getPath(), True)


class Batch:
    """Changes of a store that become visible together. Reads see the version that the batch began with."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, source: str, number: int) -> None:
        self.spark, self.store, self.source, self.number = spark, store, source, number
        self.base = store.manifest(spark)
        self.made = Manifest(self.base.version + 1, {**self.base.batches, source: number}, {n: dict(held) for n, held in self.base.tables.items()})

    @property
    def done(self) -> bool:
        """Whether an earlier run committed this batch."""
        return self.number <= self.base.batches.get(self.source, -1)

    def read(self, name: str) -> DataFrame:
        return self.store.read(self.spark, name, self.base)

    def merge(self, name: str, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], keys: DataFrame | None = None) -> None:
        """Put merged(old, rows) in the place of the touched buckets: those of the rows' keys, or of `keys`.

        old holds the rows of these buckets alone, and no other file is read or written. Buckets are numbers below a fixed one, so they reach the driver.
        """
        table = self.store.tables[name]
        own = (rows if keys is None else keys).select(self.store.bucket(F.col(table.key)).alias("b")).distinct()
        touched = {r.b for r in own.collect()}
        if not touched:
            return
        new = merged(self.store.read(self.spark, name, self.base, touched), rows)
        self._write(name, new.withColumn("bucket", self.store.bucket(F.col(table.key))), touched)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table without a key; what was there stays where it is, until there are too many folders, which become one."""
        held = self.made.tables.setdefault(name, {})
        whole = len(held) >= self.store.buckets
        kept = [self.read(name)] if whole else []
        if whole:
            held.clear()
        number = self.made.version
        self._write(name, reduce(DataFrame.unionByName, kept, rows).withColumn("bucket", F.lit(number)), {number})

    def _write(self, name: str, rows: DataFrame, touched: set[int]) -> None:
        """Buckets are dealt out whole, but Spark splits large ones. A bucket that is empty now is no longer named."""
        folder = f"data/{name}/v{self.made.version}"
        columns = self.spark.createDataFrame([], self.store.tables[name].schema).columns
        rows.select(*columns, "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.store.folder}/{folder}")
        fs, at = _files(self.spark, f"{self.store.folder}/{folder}")
        full = {int(f.getPath().getName().removeprefix("bucket=")) for f in fs.listStatus(at) if f.getPath().getName().startswith("bucket=")}
        held = self.made.tables.setdefault(name, {})
        for k in touched:
            held.pop(str(k), None)
        held.update({str(k): f"{folder}/bucket={k}" for k in sorted(full)})

    def commit(self) -> None:
        """Make the changes visible, by one rename."""
        folder = f"{self.store.folder}/manifests"
        fs, at = _files(self.spark, f"{folder}/{self.made.version}.json")
        _, hidden = _files(self.spark, f"{folder}/.{self.made.version}.json.new")
        stream = fs.create(hidden, True)
        stream.write(bytearray(json.dumps(self.made.__dict__).encode()))
        stream.close()
        if fs.exists(at) or not fs.rename(hidden, at):
            raise RuntimeError(f"version {self.made.version} of {self.store.folder} has another writer")


def latest(old: DataFrame, new: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """For a merge: the newest row of each key."""
    both = old.unionByName(new.select(*old.columns))
    order = F.struct(when, tie)
    return both.groupBy(key).agg(F.max_by(F.struct(*old.columns), order).alias("row")).select("row.*")


def replaced(old: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """For a merge: the rows of `keys` are those of new, all others stay."""
    return old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
