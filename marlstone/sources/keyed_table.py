"""A keyed table with versions, as folders of Parquet: a merge writes the buckets that it touches, and a manifest names a version's folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators import keyed


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile: merge again."""


@dataclass(frozen=True)
class Merged:
    """What a merge did: the version, buckets and bytes that it wrote, bytes of the whole version; replayed: nothing, as the batch was there."""

    version: int
    buckets: int
    bytes_written: int
    bytes_total: int
    replayed: bool = False


@dataclass(frozen=True)
class KeyedTable:
    """Rows of schema, one for each of the keys, in buckets by their hash.

    A manifest (one small JSON of at most a line for each bucket) is written last and must not exist before: a version
    is there whole or not at all, a second writer of the same version fails, and earlier versions stay readable.
    A manifest keeps the batches merged so far, so that a batch that runs again changes nothing.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 32

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of what is in a folder."""
        fs, p = self._fs(path)
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The last version; 0 before the first merge."""
        return max((int(n[: -len(".json")]) for n, _ in self._names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "batches": []}
        fs, p = self._fs(f"{self.path}/manifests/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: dict[str, dict]) -> DataFrame:
        paths = [b["path"] for b in buckets.values()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last one by default."""
        return self._rows(self.manifest(version)["buckets"])

    def merge(self, new: DataFrame, batch: str, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, order: list | None = None) -> Merged:
        """Makes a version of the rows and the new ones.

        combine(old, new) gives the rows of the buckets that new has keys of, one for each key; by default the latest
        of a key by order (columns), at equal order the new one. Only those buckets are read and written again.
        """
        last = self.version()
        was = self.manifest(last)
        total = lambda m: sum(b["bytes"] for b in m["buckets"].values())
        if batch in was["batches"]:
            return Merged(last, 0, 0, total(was), True)
        columns = self.schema.fieldNames()
        new = new.select(columns)
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())  # at most one for each bucket
        old = self._rows({k: v for k, v in was["buckets"].items() if int(k) in touched})
        combine = combine or (lambda a, b: keyed.upsert(a, b, list(self.keys), order or [F.lit(0)]))
        folder = f"{self.path}/data/{last + 1}-{uuid.uuid4().hex[:8]}"  # a writer's own, also where another makes the same version
        rows = combine(old, new).select(columns).withColumn("_bucket", self._bucket())
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        now = {"version": last + 1, "batches": [*was["batches"], batch], "buckets": {k: v for k, v in was["buckets"].items() if int(k) not in touched}}
        written = 0
        for name, _ in self._names(folder):
            if name.startswith("_bucket="):
                size = sum(n for f, n in self._names(f"{folder}/{name}") if f.endswith(".parquet"))
                now["buckets"][name.split("=")[1]] = {"path": f"{folder}/{name}", "bytes": size}
                written += size
        fs, p = self._fs(f"{self.path}/manifests/{last + 1}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"version {last + 1} of {self.path}") from e
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()
        return Merged(last + 1, len(touched), written, total(now))

    def changes(self, before: int, after: int | None = None) -> DataFrame:
        """Rows of a version that the earlier one lacks or has otherwise, of the buckets that were written between."""
        a, b = self.manifest(before)["buckets"], self.manifest(after)["buckets"]
        fresh = {k: v for k, v in b.items() if a.get(k) != v}
        return self._rows(fresh).exceptAll(self._rows({k: v for k, v in a.items() if k in fresh}))
