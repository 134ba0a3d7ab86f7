"""Storage of a repository: small JSON metadata and immutable Parquet snapshots, on any Hadoop file system."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.identity import bucket_digests, hash_bucket, object_id


def work_folder(spark: SparkSession) -> str:
    """The folder of repositories that queries build: in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, on one machine, a temporary folder is made and set; on any other master that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/repositories"


class StateChanged(ValueError):
    """Another writer has saved a state meanwhile."""


class Store:
    """A folder with numbered states, ``state/<number>.json``, and ``layers/<snapshot id>/``; neither is ever changed.

    The state with the largest number holds. A writer creates the next number after the one that it has read, and only
    if it isn't there: of two writers one gets a ``StateChanged``, and a writer that dies leaves the old state. This rests on
    the file system's rename being atomic and not overwriting, as it is in HDFS.
    """

    KEPT = 20

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def states(self) -> list[int]:
        """Numbers of the states that are there, rising."""
        if not self.exists("state"):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._p("state"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read_meta(self) -> dict:
        stream = self._fs.open(self._p(f"state/{self.states()[-1]}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_meta(self, meta: dict) -> None:
        """Saves the state that follows the one that ``meta`` was read from, or raises ``StateChanged``."""
        number = meta.get("version", 0) + 1
        beside = self._p(f"state/{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps({**meta, "version": number}).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(beside, self._p(f"state/{number}.json"), options)
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if self.exists(f"state/{number}.json"):
                raise StateChanged(f"state {number} was saved by another writer") from e
            raise
        meta["version"] = number
        for old in self.states()[: -self.KEPT]:
            self._fs.delete(self._p(f"state/{old}.json"), False)

    def write(self, df: DataFrame, key: str) -> str:
        """A new snapshot: rows by hash bucket, and a row per bucket with its count and digest."""
        name = uuid.uuid4().hex
        df = df.drop("hash_bucket")
        attrs = [c for c in df.columns if c != key]
        rows = df.withColumn("hash_bucket", hash_bucket(key, self.buckets))
        rows.repartition("hash_bucket").sortWithinPartitions(key).write.partitionBy("hash_bucket").parquet(f"{self.path}/layers/{name}/rows")
        if not self.exists(f"layers/{name}/rows/_SUCCESS") or not df.limit(1).count():
            df.withColumn("hash_bucket", F.lit(0)).limit(0).drop("hash_bucket").write.mode("overwrite").parquet(f"{self.path}/layers/{name}/rows")
        bucket_digests(df.withColumn("object_id", object_id(df, attrs)), key, self.buckets).coalesce(1).write.parquet(f"{self.path}/layers/{name}/digests")
        return name

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        df = reader.parquet(f"{self.path}/layers/{name}/rows")
        return df.drop("hash_bucket")

    def with_buckets(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/layers/{name}/rows")
        return df if "hash_bucket" in df.columns else df.withColumn("hash_bucket", F.lit(0))

    def digests(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/layers/{name}/digests")

    def same(self, a: str | None, b: str | None) -> bool:
        """Whether two snapshots hold the same rows, from their digests alone."""
        if a == b:
            return True
        if a is None or b is None:
            return False
        read = lambda n: {(r["hash_bucket"], r["n"], r["digest"]) for r in self.digests(n).collect()}
        return read(a) == read(b)

    def count(self, name: str) -> int:
        """From the digests, not the rows."""
        return self.digests(name).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def copy_from(self, other: Store, name: str) -> None:
        """A snapshot from another store, if it isn't here."""
        if not self.exists(f"layers/{name}"):
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(other._fs, other._p(f"layers/{name}"), self._fs, self._p(f"layers/{name}"), False, self.spark._jsc.hadoopConfiguration())
