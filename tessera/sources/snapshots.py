"""Saved state: tables of one row a key, kept as versions under a path and changed by merges.

A version is a small manifest that names a folder of Parquet for each bucket of the key. A merge writes the buckets that its
changes touch and then publishes the next manifest by a rename that fails if that version exists, so a reader sees the old
version or the new one, a failed writer leaves the old one, and of two writers from one version the later is refused. Hence a
table may be read, changed and written under one path.

Keys that are null can't be found again: rows without a key are left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version in between."""


class _Files:
    """The path's file system as Hadoop knows it: the same calls for a local folder, HDFS or an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root, self.gateway = spark.sparkContext._jvm, path.rstrip("/"), spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), conf) if self.path("").toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file, whole, under a name that nothing has yet."""
        started = f"_tmp/{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(started), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self.context.rename(self.path(started), self.path(name), none)
        except Exception as error:
            self.fs.delete(self.path(started), False)
            if self.fs.exists(self.path(name)):
                raise Conflict(name) from error
            raise


def versions(spark: SparkSession, path: str) -> list[int]:
    """Ascending; none where nothing has been saved."""
    return [int(n) for n in _Files(spark, path).names("_versions") if n.isdigit()]


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(_Files(spark, path).read(f"_versions/{version:020d}"))


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The table as of a version (default: the latest), read by the schema; a column that was not saved is null. Empty where
    nothing has been saved; a version that isn't there is an error."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    folders = _manifest(spark, path, version or known[-1])["buckets"] if known else {}
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/{f}/bucket={b}" for b, f in sorted(folders.items())))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(buckets)).cast("int")


def merge(changes: DataFrame, path: str, schema: str, key: list[str], order: str, gone: str | None = None, based_on: int | None = None, buckets: int = BUCKETS) -> int:
    """Publishes the next version and returns its number: rows of `changes` take the place of saved rows with their key.

    Of changes to one key the one with the highest `order` (a column of changes; null is lowest) counts, of ties the row that
    sorts last. Where the boolean column `gone` is true the key goes. The first version fixes the number of buckets, and a
    merge reads and writes only buckets that changes touch: rows are shuffled once, by key. based_on: the version that the
    changes were made from (default: the latest); if it isn't the latest when the merge ends, Conflict is raised and nothing
    is changed. Columns of changes beyond schema, key, order and gone are left out."""
    spark, files = changes.sparkSession, _Files(changes.sparkSession, path)
    known = versions(spark, path)
    last = known[-1] if known else 0
    based_on = last if based_on is None else based_on
    if based_on != last:
        raise Conflict(f"{path} is at version {last}, not {based_on}")
    manifest = _manifest(spark, path, last) if last else {"n": buckets, "buckets": {}}
    n, empty = manifest["n"], spark.createDataFrame([], schema)
    if any(f.name.lower() == "bucket" for f in empty.schema):
        raise ValueError("`bucket` names the folders and can't be a column")

    row = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema))
    drop = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    new = changes.dropna(subset=key).select(_bucket(key, n).alias("bucket"), row.alias("row"), F.struct(F.lit(1).alias("newer"), F.col(order).alias("at"), drop.alias("gone")).alias("rank"))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most n numbers
    at_type = new.schema["rank"].dataType["at"].dataType
    stored = {str(b): manifest["buckets"][str(b)] for b in touched if str(b) in manifest["buckets"]}
    if stored:
        old = spark.read.schema(schema).parquet(*(f"{files.root}/{f}/bucket={b}" for b, f in stored.items()))
        new = new.unionByName(old.select(_bucket(key, n).alias("bucket"), row.alias("row"), F.struct(F.lit(0).alias("newer"), F.lit(None).cast(at_type).alias("at"), F.lit(False).alias("gone")).alias("rank")))
    # A map may be saved but can't be compared, so ties are told by the row's text.
    best = F.max_by(F.struct("row", "rank"), F.struct("rank.newer", "rank.at", "rank.gone", F.to_json("row", {"ignoreNullFields": "false"})))
    kept = new.groupBy("bucket", *(F.col(f"row.{k}").alias(f"key_{i}") for i, k in enumerate(key))).agg(best.alias("best")).filter("NOT best.rank.gone")

    folder = f"data-{last + 1:020d}-{uuid.uuid4().hex}"
    kept.select("bucket", "best.row.*").repartition("bucket").write.partitionBy("bucket").parquet(f"{files.root}/{folder}")
    written = {n_.split("=", 1)[1] for n_ in files.names(folder) if n_.startswith("bucket=")}
    now = {b: f for b, f in manifest["buckets"].items() if int(b) not in touched} | dict.fromkeys(written, folder)
    files.publish(f"_versions/{last + 1:020d}", json.dumps({"n": n, "buckets": now, "key": key}))
    return last + 1


def prune(spark: SparkSession, path: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Forgets all but the last `keep` versions, and deletes the folders that no version names and that are older than `hours`
    (a younger one may be of a merge that is still running). Returns the deleted folders."""
    files = _Files(spark, path)
    known = versions(spark, path)
    for version in known[: max(len(known) - max(keep, 1), 0)]:
        files.fs.delete(files.path(f"_versions/{version:020d}"), False)
    named = {f for v in versions(spark, path) for f in _manifest(spark, path, v)["buckets"].values()}
    limit = files.jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000
    old = [n for n in files.names("") if n.startswith("data-") and n not in named and files.fs.getFileStatus(files.path(n)).getModificationTime() <= limit]
    for name in old:
        files.fs.delete(files.path(name), True)
    return old
