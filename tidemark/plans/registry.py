"""Registry of named queries: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SURVEY: dict[str, list[str]] = {}


class Tables:
    """Lazily opened parquet tables of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """Texts as the reader splits them, unless the session asks for ``spark.tidemark.documentPartitions``.

        A table of one small row group is one split; ask for more partitions there, never for a large table.
        """
        df, asked = self.spark.read.parquet(f"{self.path}/documents.parquet"), self.spark.conf.get("spark.tidemark.documentPartitions", None)
        return df.repartition(int(asked), "doc_id") if asked else df


def query(name: str, survey: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``; ``survey`` lists inventory ids."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        SURVEY[name] = survey.split()
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
