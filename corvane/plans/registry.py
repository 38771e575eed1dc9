"""Registration of queries over the driver tables beside the SQL that they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._written = spark, sf_dir, {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query uses more than once: written in the shared folder the first time, read from there on."""
        if name not in self._written:
            path = f"{shared_dir(self.spark)}/corvane/{name}-{uuid.uuid4().hex}"
            df = build()
            df.write.option("compression", "zstd").parquet(path)
            self._written[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._written[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
