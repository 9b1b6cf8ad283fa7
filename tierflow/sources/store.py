"""Keyed tables that are kept between runs, in hash buckets with a manifest.

A version rewrites only the buckets that it touches; its manifest says where each bucket
of each table stands and is written last, so a run that breaks off leaves the version
before it. A manifest that cannot be read, or was written for another configuration or
another layout, counts as no state at all.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Layout of the files; another number makes older states invalid.
LAYOUT = 1


def fingerprint(*what: object) -> str:
    """A digest of configuration and options."""
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """Tables below ``root``, each with its key column, in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], config: str = "", buckets: int = 64):
        self.spark, self.root, self.keys, self.config, self.buckets = spark, root.rstrip("/"), keys, config, buckets

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, folder: str) -> list[int]:
        system, path = self._files(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict | None:
        """``tables`` (name to bucket to version) and ``schemas`` of a version, or none if it is broken or not for this configuration."""
        try:
            row = self.spark.read.schema("manifest string").parquet(f"{self.root}/manifest/{version}").first()
            found = json.loads(row.manifest)
        except Exception:  # any state that cannot be read is no state
            return None
        same = found.get("layout") == LAYOUT and found.get("config") == self.config and found.get("buckets") == self.buckets and set(found["tables"]) == set(self.keys)
        return found if same else None

    def current(self) -> tuple[int, dict] | None:
        """The newest complete version and its manifest."""
        for version in reversed(self._numbers("manifest")):
            system, done = self._files(f"{self.root}/manifest/{version}/_SUCCESS")
            if system.exists(done) and (manifest := self._manifest(version)):
                return version, manifest
        return None

    def bucket(self, column: str) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, column: str) -> list[int]:
        """Buckets of the keys in a column; at most ``buckets`` numbers."""
        return sorted(r.b for r in keys.select(self.bucket(column).alias("b")).distinct().collect())

    def read(self, name: str, schema: str, buckets: list[int] | None = None, of: tuple[int, dict] | None = None) -> DataFrame:
        """A table of the current version (or of the one given), or only some of its buckets; empty without a state."""
        now = of or self.current()
        wanted = [] if now is None else [(b, v) for b, v in now[1]["tables"][name].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType.fromDDL(schema)).parquet(*(f"{self.root}/data/{v}/{name}/bucket={b}" for b, v in wanted))

    def commit(self, tables: dict[str, tuple[DataFrame, list[int]]]) -> int:
        """Write a new version: for each table the whole rows of the touched buckets. Other buckets and tables stay as they are."""
        now = self.current()
        version = 1 + max([-1, *self._numbers("manifest"), *self._numbers("data")])
        places = {name: dict(now[1]["tables"][name]) if now else {} for name in self.keys}
        for name, (rows, touched) in tables.items():
            path = f"{self.root}/data/{version}/{name}"
            rows.withColumn("bucket", self.bucket(self.keys[name])).repartition(max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))), "bucket").write.partitionBy("bucket").parquet(path)
            system, folder = self._files(path)
            written = {f.getPath().getName().partition("=")[2] for f in system.listStatus(folder) if f.isDirectory()}
            for b in map(str, touched):
                places[name].pop(b, None)
                if b in written:
                    places[name][b] = version
        manifest = json.dumps({"layout": LAYOUT, "config": self.config, "buckets": self.buckets, "tables": places})
        self.spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.parquet(f"{self.root}/manifest/{version}")
        return version

    def vacuum(self) -> None:
        """Delete versions that the current one does not refer to."""
        now = self.current()
        if now is None:
            return
        used = {v for places in now[1]["tables"].values() for v in places.values()}
        for folder, keep in (("data", used), ("manifest", {now[0]})):
            for version in self._numbers(folder):
                if version not in keep and version <= now[0]:
                    system, path = self._files(f"{self.root}/{folder}/{version}")
                    system.delete(path, True)
