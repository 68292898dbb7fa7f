"""Tables parted into buckets of keys, with a manifest that is replaced in one step.

A change rewrites the buckets that it touches and then publishes a new manifest, which names the folder of each bucket; what
was written before the manifest came is never read, and readers keep the manifest that they began with. The manifest also holds
a digest of each bucket's keys and of its rows, so that two tables can be compared without reading them. There is one writer
at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegrid import storage

from .corpus import partial_update, snapshot_upsert
from .lookup import sync_plan

#: Manifests whose folders vacuum() keeps by default, for readers that began with them.
KEPT = 2


class KeyedTable:
    """A table at a path. marks: aggregates that the manifest holds for each bucket beside its digests."""

    def __init__(self, spark: SparkSession, path: str, key: str, marks: dict[str, Column] | None = None) -> None:
        self.spark, self.path, self.key, self.marks = spark, path.rstrip("/"), key, marks or {}

    def versions(self) -> list[int]:
        """Numbers of the published manifests, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        found = self.versions() if version is None else [version]
        return json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{found[-1]:012}.json")) if found else None

    def create(self, schema: StructType, buckets: int = 32) -> KeyedTable:
        """An empty table, unless there is one. buckets: for some hundred MB each when the table is full."""
        if self.manifest() is None:
            self._publish({"buckets": buckets, "schema": schema.jsonValue(), "tags": {}, "parts": {}}, 0)
        return self

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows, of some buckets only if they are named."""
        m = self._held(version)
        parts = [p["folder"] for b, p in m["parts"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(m["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def upsert(self, delta: DataFrame, tags: dict | None = None) -> dict:
        """Insert delta's rows, or put them in place of those with their key; the new manifest. A null key is an error."""
        if delta.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError("a null key")
        return self.merge(delta, lambda old, new: snapshot_upsert(old, new, self.key), tags)

    def update(self, delta: DataFrame, columns: list[str], tags: dict | None = None) -> dict:
        """Set the named columns where delta has a value; keys that the table lacks change nothing."""
        return self.merge(delta, lambda old, new: partial_update(old, new, self.key, columns)[0], tags)

    def merge(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], tags: dict | None = None) -> dict:
        """Replace the buckets of delta's keys by change(their rows, delta), which keeps rows in the bucket of their key. tags
        are kept in the manifest, beside those that are there. An empty delta publishes its tags only."""
        m = self._held()
        bucket = self._bucket(m["buckets"])
        touched = sorted(r[0] for r in delta.select(bucket.alias("b")).distinct().collect())  # one for each bucket at most
        new = {**m, "tags": {**m["tags"], **(tags or {})}, "parts": dict(m["parts"])}
        if touched:
            schema = StructType.fromJson(m["schema"])
            rows = change(self.read(touched), delta).select(*schema.names)
            new["parts"] = {b: p for b, p in m["parts"].items() if int(b) not in touched} | self._write(rows, m["buckets"])
        self._publish(new, self.versions()[-1] + 1)
        return new

    def vacuum(self, keep: int = KEPT) -> int:
        """Remove manifests but the last few, and folders that none of those names; how many folders went."""
        versions = self.versions()
        for v in versions[:-keep]:
            storage.remove(self.spark, f"{self.path}/manifest/{v:012}.json")
        named = {p["folder"] for v in versions[-keep:] for p in self.manifest(v)["parts"].values()}
        gone = 0
        for write in storage.names(self.spark, f"{self.path}/data"):
            whole = f"data/{write}"
            for part in storage.names(self.spark, f"{self.path}/{whole}"):
                if part.startswith("bucket_=") and f"{whole}/{part}" not in named:
                    storage.remove(self.spark, f"{self.path}/{whole}/{part}")
                    gone += 1
            if not any(n.startswith(f"{whole}/") for n in named):
                storage.remove(self.spark, f"{self.path}/{whole}")
        return gone

    def _held(self, version: int | None = None) -> dict:
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"no table at {self.path}")
        return m

    def _bucket(self, buckets: int) -> Column:
        # By the key's text, so that tables whose keys are of other types part them alike.
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> dict:
        """Write rows and give the manifest's entries of their buckets."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket_", self._bucket(buckets)).repartition(buckets, "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        if not any(n.startswith("bucket_=") for n in storage.names(self.spark, f"{self.path}/{folder}")):
            return {}
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        name = F.col(self.key).cast("string")
        # Sums and exclusive ors of hashes don't depend on the order of the rows.
        total = lambda x: F.sum(x.cast("decimal(38,0)")).cast("string")
        sums = {"rows": F.count("*"), "keys": F.concat_ws(":", total(F.xxhash64(name)), F.bit_xor(F.xxhash64(F.lit(1), name))), "digest": F.concat_ws(":", total(F.xxhash64(*rows.columns)), F.bit_xor(F.xxhash64(F.lit(1), *rows.columns)))}
        found = written.groupBy("bucket_").agg(*[c.alias(n) for n, c in (sums | self.marks).items()]).collect()  # one row for each bucket
        return {str(r["bucket_"]): {"folder": f"{folder}/bucket_={r['bucket_']}", **{n: r[n] for n in [*sums, *self.marks]}} for r in found}

    def _publish(self, manifest: dict, version: int) -> None:
        storage.write_whole(self.spark, f"{self.path}/manifest/{version:012}.json", json.dumps(manifest))


def differing(a: KeyedTable, b: KeyedTable, digest: str = "keys") -> list[int]:
    """Buckets whose digests differ between two tables; only the manifests are read."""
    left, right = a._held(), b._held()
    if left["buckets"] != right["buckets"]:
        raise ValueError("tables with different numbers of buckets")
    of = lambda m, k: m["parts"].get(str(k), {}).get(digest)
    return [k for k in range(left["buckets"]) if of(left, k) != of(right, k)]


def sync_changes(index: KeyedTable, wanted: KeyedTable, status: str, delete: bool, failed: str = "failed") -> DataFrame:
    """(key, status, action) of the rows that sync_plan() wouldn't skip, from two tables parted alike.

    Only buckets whose keys differ, or of which the index's mark named failed counts any, are read and joined; where nothing
    has changed the manifests alone are read. failed: a mark of index that counts the rows to be retried."""
    retried = [int(b) for b, p in index._held()["parts"].items() if p[failed]]
    some = sorted(set(differing(index, wanted)) | set(retried))
    plan = sync_plan(index.read(some), wanted.read(some).withColumnRenamed(wanted.key, index.key), index.key, status, delete)
    return plan.where("action <> 'skip'")
