"""Shared folder, cut of lineage and written intermediate tables."""

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None
#: Spark then removes the shuffle files of a query when it ends, not when the driver's memory is next cleaned up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of this machine; a cluster without the setting is an error.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="almanac-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/almanac/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Writes in here leave no shuffle files behind: what they made lies in the shared folder."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    The result has no lineage, survives lost executors, keeps file statistics for join planning and prunes columns. The shuffle
    files of the write go when it ends.
    """
    return written_in_turn([df], label)


def written_in_turn(frames: Iterable[DataFrame], label: str) -> DataFrame:
    """Write frames of one schema, at least one, one after the other into one folder and read them back as one. Only one of them has its
    shuffle files on disk at a time."""
    path = None
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        path = path or fresh_path(spark, label)
        with _shuffles_removed(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@dataclass
class Lookup:
    """A written table with what was measured while it was written."""

    table: DataFrame
    rows: int
    size: int

    def select(self, *columns) -> "Lookup":
        """Some of the columns, or columns no wider than those they are made of."""
        return Lookup(self.table.select(*columns), self.rows, self.size)


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: bytes of texts, sixteen per array element, eight for anything else."""
    total = F.lit(0).cast("long")
    for field in df.schema:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        size = F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind in ("array", "map") else F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def measured(df: DataFrame, label: str) -> Lookup:
    """Write ``df`` once and count its rows and bytes in that one pass. A stage that runs again may be counted twice, so the
    figures are never too small."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("size")), label)
    return Lookup(table, seen.get["rows"], seen.get["size"])
