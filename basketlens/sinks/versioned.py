"""Keyed Parquet tables with versions: a commit rewrites the partitions it touches and appears at once or not at all.

A table is a folder::

    data/<commit>/part=<label>/*.parquet   rows of one partition as one commit wrote them
    versions/<number>.json                 which folder holds each partition, and the batches taken in

The largest number is the table.  A commit writes new folders beside the old ones
and then puts the next version file in place by a rename that fails where the file is already there, so that
readers see the old table or the new one, a writer that dies leaves the old one, and
of two writers one has to start again.  The file system must offer that rename
(HDFS and local disks do).

Partitions are labelled by a hash of their columns, so that any value may occur.  Only
the labels of the touched partitions and the version file, a line for each partition, reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.operators import upsert as up

LABEL = "part"


class ConcurrentCommit(RuntimeError):
    """Another writer made the next version first; nothing of this commit is visible."""


class VersionedTable:
    """A table keyed by ``keys`` and stored by ``partition`` (some of the keys' columns or columns that a key never leaves).

    ``buckets`` splits each partition by a hash of the keys, so that a hot one is many files of many tasks.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], partition: Sequence[str] = (), buckets: int = 1):
        self.spark, self.path, self.keys, self.partition, self.buckets = spark, path.rstrip("/"), list(keys), list(partition), buckets
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # files -------------------------------------------------------------

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._at().getFileSystem(self._conf)

    def _names(self, *parts: str) -> list[str]:
        at, fs = self._at(*parts), self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one if none is named) consists of."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "partitions": {}, "batches": {}}
        stream = self._files().open(self._at("versions", f"{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The switch: from here on readers see the new version."""
        made = self._at("versions", f"_{uuid.uuid4()}")
        stream = self._files().create(made, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        gateway, options = self.spark._sc._gateway, self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        try:
            context.rename(made, self._at("versions", f"{manifest['version']:012d}.json"), gateway.new_array(options, 0))
        except Py4JJavaError as failed:
            self._files().delete(made, False)
            if "FileAlreadyExists" in str(failed.java_exception.getClass()):
                raise ConcurrentCommit(f"version {manifest['version']} of {self.path}") from failed
            raise

    # rows --------------------------------------------------------------

    def _label(self) -> Column:
        values = [F.coalesce(F.to_json(F.struct(*self.partition)), F.lit(""))] if self.partition else [F.lit("")]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)) if self.buckets > 1 else F.lit(0)
        return F.sha2(F.concat_ws("/", *values, bucket.cast("string")), 256)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._rows(manifest, manifest["partitions"])

    def exists(self) -> bool:
        return bool(self.versions())

    def _rows(self, manifest: dict, labels) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{manifest['partitions'][x]}" for x in sorted(labels)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Replace the partitions that ``new`` touches by ``merge(old rows of these, new)``; the version made.

        ``new`` is computed once for its partitions and once for the rows, so that it should be a table or
        deterministic.  With a ``batch`` (source, number) a number that is not larger than the
        source's last one has been taken in before: nothing happens.
        """
        before = self.manifest()
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return before["version"]
        if before["schema"] is not None:
            names = T.StructType.fromJson(before["schema"]).names
            new = new.select(*names)
        touched = {r[0] for r in new.select(self._label().alias(LABEL)).distinct().collect()}
        old = self._rows(before, touched & before["partitions"].keys()) if before["schema"] is not None else new.limit(0)
        rows = merge(old, new).select(*new.columns)
        folder = f"data/{uuid.uuid4()}"
        rows.withColumn(LABEL, self._label()).hint("rebalance", LABEL).write.partitionBy(LABEL).parquet(f"{self.path}/{folder}")
        written = {n.removeprefix(f"{LABEL}="): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{LABEL}=")}
        kept = {k: v for k, v in before["partitions"].items() if k not in touched}
        schema = before["schema"] or json.loads(rows.schema.json())
        batches = before["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish({"version": before["version"] + 1, "schema": schema, "partitions": kept | written, "batches": batches})
        return before["version"] + 1

    def upsert(self, updates: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None) -> int:
        """Last writer wins; of several updates of a key the last by ``order`` (which is not stored)."""
        new = up.last_per_key(updates, self.keys, order).drop(*(c for c in order if c not in self.keys and not self._stores(c)))
        return self.commit(new, lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new), batch)

    def _stores(self, column: str) -> bool:
        schema = self.manifest()["schema"]
        return schema is not None and column in T.StructType.fromJson(schema).names

    def upsert_coalesce(self, updates: DataFrame, keep: Sequence[str], batch: tuple[str, int] | None = None) -> int:
        """One row for each key comes; values of ``keep`` replace old ones only where they are not null, the others always."""
        rest = [c for c in updates.columns if c not in self.keys and c not in keep]
        return self.commit(updates, lambda old, new: up.upsert_coalesce(old, new, self.keys, rest, list(keep)), batch)

    def insert_ignore(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows whose key is new are added once."""
        return self.commit(rows, lambda old, new: up.insert_ignore(old, new, self.keys), batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows with these keys go; ``keys`` has the key and the partition columns, partitions without rows vanish."""
        if not self.exists():
            return 0
        names = dict.fromkeys([*self.keys, *self.partition])
        empty = self.read().limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in self.read().dtypes if c not in names), *names).select(*self.read().columns)
        gone = empty.unionByName(keys.select(*names).distinct(), allowMissingColumns=True)
        return self.commit(gone, lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti"), batch)

    def vacuum(self, keep: int = 2) -> int:
        """Remove what none of the last ``keep`` versions uses; readers and writers of older ones must have ended.  How many folders went."""
        known = self.versions()
        used = {p.split("/")[1] for v in known[-keep:] for p in self.manifest(v)["partitions"].values()}
        parts = {"/".join(p.split("/")[1:]) for v in known[-keep:] for p in self.manifest(v)["partitions"].values()}
        fs, gone = self._files(), 0
        for folder in self._names("data"):
            if folder not in used:
                gone += fs.delete(self._at("data", folder), True)
                continue
            for n in self._names("data", folder):
                if n.startswith(f"{LABEL}=") and f"{folder}/{n}" not in parts:
                    gone += fs.delete(self._at("data", folder, n), True)
        for v in known[:-keep]:
            fs.delete(self._at("versions", f"{v:012d}.json"), False)
        return gone
