"""A snapshot kept up to date by a stream of revisions: each batch merges into the buckets that it touches, once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Snapshot:
    """The newest row of every key, in buckets of keys under a shared folder.

    A batch writes the buckets that it touches to new folders, then a manifest that names each bucket's folder. Manifests are numbered by
    batch and put in place by a rename, so a batch counts from its manifest on: one that was cut off before is written anew, one that is
    sent again after is skipped. Readers take the newest manifest, and never see half a batch.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
        """order: columns that rise with revisions; of equal ones the row that compares largest stands."""
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """batch (-1 before the first) and buckets: the folder of each bucket."""
        made = self._manifests()
        if not made:
            return {"batch": -1, "buckets": {}}
        stream = self._files.open(self._path(f"{self.path}/manifests/{made[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        folder, name = f"{self.path}/manifests", f"{manifest['batch']:012d}.json"
        part = self._path(f"{folder}/.{name}.part")
        out = self._files.create(part, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._files.rename(part, self._path(f"{folder}/{name}")):
            raise OSError(f"could not put {name} in place")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def newest(self, rows: DataFrame) -> DataFrame:
        """The last row of each key; equal ones in order are told apart by all their values."""
        rest = [c for c in rows.columns if c not in self.keys]
        last = F.max(F.struct(*self.order, *[c for c in rest if c not in self.order])).alias("_v")
        return rows.groupBy(*self.keys).agg(last).select(*[F.col(c) if c in self.keys else F.col(f"_v.{c}") for c in rows.columns])

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch's rows; whether anything was done (a batch that counts already does nothing)."""
        now = self.manifest()
        if batch <= now["batch"]:
            return False
        new = self.newest(rows).withColumn("_bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # self.buckets at most
            if touched:
                old = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
                merged = new.drop("_bucket")
                if old:
                    merged = self.newest(self.spark.read.parquet(*old).unionByName(merged, allowMissingColumns=True))
                merged = merged.withColumn("_bucket", self._bucket())
                merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/batch={batch:012d}")
            folders = {str(b): f"{self.path}/data/batch={batch:012d}/_bucket={b}" for b in touched}
            self._commit({"batch": batch, "buckets": {**now["buckets"], **folders}})
        finally:
            new.unpersist()
        return True

    def read(self) -> DataFrame:
        """The snapshot as of the newest batch that counts."""
        folders = sorted(set(self.manifest()["buckets"].values()))
        if not folders:
            raise ValueError("no batch has been merged yet")
        return self.spark.read.parquet(*folders)

    def clean(self) -> int:
        """Delete folders of buckets, and manifests, that the newest manifest no longer needs; how many folders went. Not while others read."""
        now, gone = self.manifest(), 0
        kept, data = set(now["buckets"].values()), self._path(f"{self.path}/data")
        for batch in self._files.listStatus(data) if self._files.exists(data) else ():
            for bucket in self._files.listStatus(batch.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("_bucket=") and f"{self.path}/data/{batch.getPath().getName()}/{name}" not in kept:
                    gone += bool(self._files.delete(bucket.getPath(), True))
        for n in self._manifests()[:-1]:
            self._files.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        return gone

    def follow(self, revisions: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge every batch of a stream of revisions; runs through what is there and ends."""
        return revisions.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
