"""Keyed tables on shared storage: changes rewrite only the buckets that they touch.

A table is cut into buckets by a hash of its key, one Parquet folder per bucket.  A version is
a manifest, a small JSON file that names the folder of each bucket.  A change writes the new
folders of the touched buckets beside the old ones and then adds one manifest; readers take
the highest.  So a write that fails leaves the version before it as it was, older versions stay
readable until ``vacuum``, and of two writers that start from one version the later one fails.

A null key is a key like others.  Changes with repeated keys are reduced to one row per key by
a map-side aggregate before any bucket is read.  An empty change adds no version.  The driver
sees bucket numbers and folder names only, at most one per bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosspanel.sources.store import first_by_key

BUCKET = "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], order: str,
               buckets: int = 64) -> KeyedTable:
        """Version 1: the row of greatest ``order`` for each key."""
        table = cls(rows.sparkSession, path)
        if table.versions():
            raise ValueError(f"a keyed table is there already: {path}")
        head = {"keys": list(keys), "order": order, "buckets": buckets,
                "schema": json.loads(rows.schema.json())}
        table._commit(head | {"version": 1, "folders": table._write(first_by_key(rows, keys, order, last=True), head)})
        return table

    # -- reading ---------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = max(self.versions()) if version is None else version
        text = self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one that is still kept."""
        found = self.manifest(version)
        return self._folders(found, found["folders"].values())

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, from their buckets alone."""
        found = self.manifest()
        folders = [found["folders"][b] for b in self._touched(keys, found) if b in found["folders"]]
        # Null-safe, as a null key is a key.
        wanted = keys.select(*[F.col(k).alias(f"_on_{k}") for k in found["keys"]]).distinct()
        same = F.lit(True)
        for k in found["keys"]:
            same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
        return self._folders(found, folders).join(wanted, same, "left_semi")

    # -- changing --------------------------------------------------------------

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace: the row of greatest ``order`` stands for each key."""
        return self._change(rows, lambda old, new, m: first_by_key(
            old.unionByName(new), m["keys"], m["order"], last=True))

    def insert_missing(self, rows: DataFrame) -> int:
        """Fill gaps only: a key that is there keeps its row, whatever the order says."""
        def merge(old, new, m):
            both = old.withColumn("_rank", F.struct(F.lit(1).alias("old"), F.col(m["order"]).alias("at"))).unionByName(
                new.withColumn("_rank", F.struct(F.lit(0).alias("old"), F.col(m["order"]).alias("at"))))
            return first_by_key(both, m["keys"], "_rank", last=True).drop("_rank")

        return self._change(rows, merge)

    def delete(self, keys: DataFrame) -> int:
        """Remove the given keys."""
        def merge(old, gone, m):
            marked = old.withColumn("_gone", F.lit(False)).unionByName(
                gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            kept = marked.groupBy(*m["keys"]).agg(
                F.max("_gone").alias("_gone"),
                F.max_by(F.struct(*[c for c in old.columns if c not in m["keys"]]),
                         (~F.col("_gone")).cast("int")).alias("_r"))
            return kept.filter("not _gone").select(*m["keys"], "_r.*")

        return self._change(keys, merge, whole=False)

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the last ``keep`` versions and every folder that none of those names,
        what a failed write left included.  Not to be run while a write is under way."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {f for v in kept for f in self.manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop.Path(self._manifest_path(v)), False)
        removed = 0
        for write in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data")):
            for bucket in self._fs.listStatus(write.getPath()):
                name = f"{write.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in used:
                    removed += bool(self._fs.delete(bucket.getPath(), True))
        return removed

    # -- parts -----------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:08d}.json"

    def _bucket(self, head: dict) -> Column:
        return F.pmod(F.xxhash64(*head["keys"]), F.lit(head["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, head: dict) -> list[str]:
        return [str(r[0]) for r in rows.select(self._bucket(head)).distinct().collect()]

    def _folders(self, head: dict, folders) -> DataFrame:
        schema = StructType.fromJson(head["schema"])
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, head: dict) -> dict[str, str]:
        """Write rows into bucket folders of their own; the folder of each bucket that has rows."""
        write = uuid.uuid4().hex
        folder = f"{self.path}/data/{write}"
        names = StructType.fromJson(head["schema"]).fieldNames()
        rows.select(*names, self._bucket(head).alias(BUCKET)).hint("rebalance", BUCKET).write.partitionBy(
            BUCKET).parquet(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(folder)) if s.isDirectory()]
        return {name.split("=")[1]: f"{write}/{name}" for name in found if name.startswith(f"{BUCKET}=")}

    def _change(self, rows: DataFrame, merge: Callable, whole: bool = True) -> int:
        head = self.manifest()
        names = StructType.fromJson(head["schema"]).fieldNames()
        new = rows.select(*(names if whole else head["keys"]))
        touched = self._touched(new, head)
        if not touched:
            return head["version"]
        old = self._folders(head, [head["folders"][b] for b in touched if b in head["folders"]])
        written = self._write(merge(old, new, head), head)
        folders = {b: f for b, f in head["folders"].items() if b not in touched} | written
        self._commit(head | {"version": head["version"] + 1, "folders": folders})
        return head["version"] + 1

    def _commit(self, manifest: dict) -> None:
        """Write the manifest aside, then rename it; the rename fails where the name is taken."""
        aside = self._hadoop.Path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        named = self._hadoop.Path(self._manifest_path(manifest["version"]))
        no_options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        self._files.rename(aside, named, no_options)
