"""A stored table in buckets of keys that takes batches of changes.

A batch rewrites the buckets that hold its keys and no others. A manifest, one small table a version, names the folders that count, so
readers see the old version or the new one; a batch that is sent again finds its name in the manifests and changes nothing, and one that
was lost half way writes over its own folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Buckets of a new table; a table of more data than some hundred MB a bucket should be made with more.
BUCKETS = 64


class StoredTable:
    """Rows of ``schema`` with ``keys``, below ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list:
        """(version, batch, bucket, folder): the newest version's buckets, and one row without a bucket for every version's batch."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return []
        rows = self.spark.read.schema("batch string, bucket int, folder string, version int").parquet(f"{self.path}/manifest")
        return rows.where(F.col("bucket").isNull() | (F.col("version") == rows.agg(F.max("version")).scalar())).collect()

    def folders(self) -> tuple[int, dict[int, str]]:
        """The newest version (0: none yet) and its folder for each bucket that has rows."""
        rows = self._manifests()
        version = max((r["version"] for r in rows), default=0)
        return version, {r["bucket"]: r["folder"] for r in rows if r["version"] == version and r["bucket"] is not None}

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The table as of its newest version."""
        return self._rows(sorted(self.folders()[1].values()))

    def merge(self, changes: DataFrame, batch: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Apply ``how(stored rows, changes)`` where the changes' keys are; False if ``batch`` (a name fit for a folder) was applied before.

        ``how`` must keep rows in the bucket of their keys, as joins on the keys do. ``changes`` is read twice. Writers of one version
        at the same time: the second one fails and may send its batch again.
        """
        manifests = self._manifests()
        if any(r["batch"] == batch for r in manifests):
            return False
        version, held = self.folders()
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}  # one number a bucket
        out = f"v{version + 1}-{batch}"
        old = self._rows(sorted(f for b, f in held.items() if b in touched))
        new = how(old, changes).select(*self.schema.names).withColumn("_bucket", self._bucket())
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{out}")
        written = {r[0] for r in self.spark.read.schema("_bucket int").parquet(f"{self.path}/data/{out}").select("_bucket").distinct().collect()} if touched else set()
        named = {b: f for b, f in held.items() if b not in touched} | {b: f"{out}/_bucket={b}" for b in written}
        rows = [(batch, None, None), *((batch, b, f) for b, f in sorted(named.items()))]
        (self.spark.createDataFrame(rows, "batch string, bucket int, folder string").coalesce(1)
         .write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version + 1}"))
        return True
