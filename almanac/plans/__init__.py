"""Registered queries: each module maps an inventory id to a Spark query and, where SQL can say it, its DuckDB text."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Book:
    """Queries and oracle texts of one module."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return keep


TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A text table that arrives in fewer splits than there are cores is spread over the cores, since work
    per row is high; one with more splits, as on a cluster, is read as it lies, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
