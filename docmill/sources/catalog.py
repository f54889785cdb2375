"""Collections by name: tables to read, and versions of tables to write."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import QueryError


def utc(df: DataFrame) -> DataFrame:
    """Dates as timestamps and decimals as doubles. Zoneless timestamps count as UTC; they stay, so that conditions reach the scan."""
    to = {T.DateType: "timestamp", T.DecimalType: "double"}
    casts = {f.name: F.col(f"`{f.name}`").cast(to[type(f.dataType)]) for f in df.schema.fields if type(f.dataType) in to}
    return df.withColumns(casts) if casts else df


class Catalog:
    """Named DataFrames. With a root folder, tables can be written: every change is a new version folder, which holds the
    files that changed and the list of those of older versions that still count.

    A version counts once Spark's commit marker is in it, so a write that dies leaves the table as it was, and a query may
    read a table that it replaces. A writer claims its version's number, and gives up if another one has committed since
    the version that it read. Old versions stay until vacuum().
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.loaders: dict[str, Callable[[], DataFrame]] = {}
        self.kinds: dict[str, str] = {}
        self.views: dict[str, str] = {}
        #: How sharded collections are dealt out, which exports say of each document.
        self.shards: dict[str, dict[str, int | str]] = {}
        #: Unique indexes by collection, as tuples of columns; writes that would break one fail.
        self.unique: dict[str, list[tuple[str, ...]]] = {}

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str], root: str | None = None) -> Catalog:
        out = cls(spark, root)
        for name in names:
            out.add_path(name, f"{folder}/{name}.parquet")
        return out

    # -- reading

    def add(self, name: str, df: DataFrame, kind: str = "document") -> DataFrame:
        self.loaders[name], self.kinds[name] = (lambda: df), kind
        return df

    def add_path(self, name: str, path: str, fmt: str = "parquet", kind: str = "document", **options) -> None:
        self.loaders[name] = lambda: utc(self.spark.read.format(fmt).options(**options).load(path))
        self.kinds[name] = kind

    def add_shards(self, name: str, paths: list[str], fmt: str = "parquet", kind: str = "document", replicas: int = 1) -> None:
        """A collection whose shards and replicas lie in several folders: one row per `_key`."""
        self.shards[name] = {"num_shards": len(paths), "shard_key": "_key", "replication_factor": replicas}
        self.loaders[name] = lambda: utc(self.spark.read.format(fmt).load(paths)).dropDuplicates(["_key"])
        self.kinds[name] = kind

    def has(self, name: str) -> bool:
        return name in self.loaders or (self.root is not None and self.version(name) is not None)

    def table(self, name: str) -> DataFrame:
        if name in self.loaders:
            return self.loaders[name]()
        if (v := self.version(name)) is None:
            raise QueryError(f"no collection {name}")
        own = self.spark.read.parquet(self.folder(name, v))
        kept = self._kept(name, v)
        return self.spark.read.schema(own.schema).parquet(self.folder(name, v), *(f"{self.root}/{name}/{p}" for p in kept)) if kept else own

    def names(self) -> Iterator[str]:
        yield from self.loaders

    # -- writing

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:06d}"

    def _begun(self, name: str) -> list[tuple[int, object]]:
        """Numbers and folders of all versions, committed or not."""
        fs, path = self._fs(f"{self.root}/{name}")
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [(int(m[1]), p) for p in found if (m := re.fullmatch(r"v(\d+)", p.getName()))]

    def versions(self, name: str) -> list[int]:
        """Committed versions, oldest first."""
        fs, names = self._fs(f"{self.root}/{name}")[0], self._begun(name)
        marker = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
        return sorted(n for n, p in names if fs.exists(marker(p)))

    def version(self, name: str) -> int | None:
        if self.root is None:
            return None
        return max(self.versions(name), default=None)

    def _kept(self, name: str, version: int) -> list[str]:
        """Files of older versions that belong to a version, as v000001/part-…"""
        fs, path = self._fs(f"{self.folder(name, version)}/_kept")
        if not fs.exists(path):
            return []
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text.split()

    def files(self, name: str) -> list[str]:
        """The data files of the newest version, as v000001/part-…"""
        if (version := self.version(name)) is None:
            return []
        fs, path = self._fs(self.folder(name, version))
        own = [s.getPath().getName() for s in fs.listStatus(path)]
        return [f"{path.getName()}/{x}" for x in own if not x.startswith(("_", "."))] + self._kept(name, version)

    def replace(self, name: str, df: DataFrame, kind: str | None = None, membership: tuple[str, ...] = (), after: int | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
        """Writes df as the table's next version; columns in `membership` get Bloom filters in the files. after: the
        version that df was made from, by default the newest; it fails if there is a newer one by then. kept: files of
        older versions that belong to the new one too."""
        if self.root is None:
            raise QueryError("this catalog has no folder to write to")
        after = (self.version(name) if after is None else after) or 0
        version = max((n for n, _ in self._begun(name)), default=0) + 1
        fs, claim = self._fs(f"{self.folder(name, version)}/_claim")
        if not fs.createNewFile(claim):
            raise QueryError(f"{name} is being written by another")
        if kept:
            out = fs.create(self._fs(f"{self.folder(name, version)}/_kept")[1])
            out.write(bytearray("\n".join(kept).encode()))
            out.close()
        writer = df.write.mode("append")
        for column in membership:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.folder(name, version))
        if any(v > after and v != version for v in self.versions(name)):
            fs.delete(claim.getParent(), True)
            raise QueryError(f"{name} was changed by another while this was written")
        self.loaders.pop(name, None)
        self.kinds[name] = kind or self.kinds.get(name, "document")
        return self.table(name)

    def exchange(self, name: str, keys: DataFrame, new: DataFrame, after: int | None = None) -> DataFrame:
        """The table's next version without the rows of these `_key`s and with new rows, which have the table's columns and
        types. Only files that hold one of the keys are read whole and written again; of the others, `_key` is read."""
        table = self.table(name)
        held = table.select("_key", F.col("_metadata.file_path").alias("__file")).join(keys.select("_key"), "_key", "left_semi").select("__file").distinct()
        touched = {"/".join(r[0].rsplit("/", 2)[1:]) for r in held.collect()}
        kept = tuple(p for p in self.files(name) if p not in touched)
        rows = new
        if touched:
            old = self.spark.read.schema(table.schema).parquet(*(f"{self.root}/{name}/{p}" for p in sorted(touched)))
            rows = old.join(keys.select("_key"), "_key", "left_anti").select(*table.columns).unionByName(new)
        return self.replace(name, rows, after=after, kept=kept)

    def compact(self, name: str) -> DataFrame:
        """The newest version's rows in files of its own."""
        return self.replace(name, self.table(name))

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows to the newest version; a table that only is registered is written whole first."""
        version = self.version(name)
        if name in self.loaders or version is None:
            old = self.loaders[name]() if name in self.loaders else None
            return self.replace(name, df if old is None else old.unionByName(df, allowMissingColumns=True))
        same = set(self.table(name).columns) == set(df.columns)
        if not same:
            return self.replace(name, self.table(name).unionByName(df, allowMissingColumns=True))
        df.write.mode("append").parquet(self.folder(name, version))
        return self.table(name)

    def truncate(self, name: str) -> DataFrame:
        return self.replace(name, self.table(name).limit(0))

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Deletes older versions, but for the files that the remaining ones keep."""
        fs, _ = self._fs(f"{self.root}/{name}")
        found = self.versions(name)
        used = {p for v in found[-keep:] for p in self._kept(name, v)}
        for _, path in self._begun(name):
            version = path.getName()
            if int(version[1:]) in found[-keep:] or int(version[1:]) > max(found, default=0):
                continue
            if not any(p.startswith(f"{version}/") for p in used):
                fs.delete(path, True)
                continue
            for status in fs.listStatus(path):
                if f"{version}/{status.getPath().getName()}" not in used:
                    fs.delete(status.getPath(), True)
