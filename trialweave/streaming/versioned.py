"""Tables that change by versions: a batch writes the rows of its keys, and one file that names what the new version consists of.

A version's rows lie in buckets by a hash of their keys, in parts that are never changed: a merge adds a part to the buckets that it touches, and a bucket of
many parts is written anew, with the merge that touches it. Readers take the newest manifest, or an older one, so they see whole versions only.
A merge that is run again, as a batch is after a failure, writes the same parts again and then the manifest, or finds it there and does nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table, and parts of a bucket beyond which it is written anew.
BUCKETS, MOST_PARTS = 64, 8


class Files:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """Written aside and renamed, so that a reader sees all of it or nothing; a file that is there stays."""
        if self._fs.exists(self._path(name)):
            return
        aside = self._path(f"{name}.tmp")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(aside, self._path(name)) and not self._fs.exists(self._path(name)):
            raise OSError(f"{name} can't be put in place")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class VersionedTable:
    """Rows in `folder` that merges replace by `keys`, which aren't null; a key may have many rows."""

    folder: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    most_parts: int = MOST_PARTS

    def versions(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in Files(spark, self.folder).names("manifest") if n.endswith(".json")]

    def _manifest(self, spark: SparkSession, version: int) -> dict:
        return json.loads(Files(spark, self.folder).text(f"manifest/{version:012d}.json"))

    def _rows(self, spark: SparkSession, schema: StructType, parts: dict[str, list[str]]) -> DataFrame:
        """The newest rows of each key in the parts."""
        paths = {b: [f"{self.folder}/data/{p}/bucket={b}" for p in own] for b, own in parts.items()}
        full = StructType([*schema.fields]).add("_version", "long")
        read = lambda p: spark.read.schema(full).parquet(*p) if p else spark.createDataFrame([], full)
        single, many = (read([p for own in paths.values() for p in own if (len(own) > 1) == more]) for more in (False, True))
        newest = F.max("_version").over(Window.partitionBy(*self.keys))
        return single.unionByName(many.withColumn("_newest", newest).where("_version = _newest").drop("_newest"))

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The rows of the newest version, or of the one given; None if nothing was merged."""
        found = [v for v in self.versions(spark) if version is None or v == version]
        if not found:
            return None
        m = self._manifest(spark, max(found))
        return self._rows(spark, StructType.fromJson(m["schema"]), m["parts"]).drop("_version")

    def merge(self, rows: DataFrame, version: int) -> None:
        """The rows replace all those of their keys; `version` is greater than those before, or that of a merge that is run again."""
        spark = rows.sparkSession
        files = Files(spark, self.folder)
        done = self.versions(spark)
        if version in done:
            return
        if done and version < max(done):
            raise ValueError(f"version {version} comes after {max(done)}")
        parts = self._manifest(spark, max(done))["parts"] if done else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        placed = rows.withColumn("_version", F.lit(version).cast("long")).withColumn("bucket", bucket)
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{version}")
        touched = [n.removeprefix("bucket=") for n in files.names(f"data/{version}") if n.startswith("bucket=")]
        for b in touched:
            parts[b] = [*parts.get(b, []), str(version)]
        long = {b: parts[b] for b in touched if len(parts[b]) > self.most_parts}
        if long:
            whole = self._rows(spark, rows.schema, long).withColumn("bucket", bucket)
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{version}-whole")
            parts |= {b: [f"{version}-whole"] for b in long}
        files.write_once(f"manifest/{version:012d}.json", json.dumps({"schema": rows.schema.jsonValue(), "parts": parts}))

    def expire(self, spark: SparkSession, keep: int = 2) -> None:
        """Removes all versions but the `keep` newest, and the parts that only they name."""
        files, versions = Files(spark, self.folder), self.versions(spark)
        used = {p for v in versions[-keep:] for own in self._manifest(spark, v)["parts"].values() for p in own}
        newest = max(versions, default=-1)
        for v in versions[:-keep]:
            files.remove(f"manifest/{v:012d}.json")
        for name in files.names("data"):
            if name not in used and int(name.split("-")[0]) <= newest:
                files.remove(f"data/{name}")
