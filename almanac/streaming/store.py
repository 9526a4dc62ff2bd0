"""A table in hash buckets, with a manifest of live folders per version: a batch rewrites only the buckets it changes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from almanac.operators.enrich import backfill

BUCKETS = 64
MANIFEST = "bucket int, folder string, since int"


@dataclass
class BucketStore:
    """Rows unique on ``key`` below ``path``, dealt over ``buckets`` by a hash of the key.

    ``data/<version>-<id>/bucket=<b>`` holds the rows of bucket b as one version left them; ``manifest/version=<v>`` says which
    folder is live for each bucket in version v, and since which version. A folder is never changed once a manifest names it, so
    a reader of a version is not disturbed, and an attempt that fails leaves folders that no manifest names. The manifest has a
    row per bucket, however large the table is.
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = BUCKETS

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketStore:
        """Store of the rows as version 0."""
        store = BucketStore(rows.sparkSession, path, key, rows.schema, buckets)
        store._publish(0, {}, store._write(rows, 0, None))
        return store

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, among: Sequence[int] | None) -> dict[int, str]:
        """Write rows by bucket, each bucket in one task; the folder of each bucket that may hold some."""
        folder = f"data/{version}-{uuid.uuid4().hex}"
        count = self.buckets if among is None else max(1, len(among))
        rows.withColumn("bucket", self._bucket()).repartition(count, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/{folder}")
        # Only the partition column is asked for; at most one row per bucket comes back.
        return {r["bucket"]: folder for r in found.select("bucket").distinct().collect()}

    def _publish(self, version: int, before: dict[int, tuple[str, int]], new: dict[int, str]) -> None:
        live = {**before, **{b: (folder, version) for b, folder in new.items()}}
        # The row without a bucket marks the version, also of a store without rows.
        rows = [(None, None, version), *((b, folder, since) for b, (folder, since) in sorted(live.items()))]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def live(self, version: int) -> dict[int, tuple[str, int]]:
        """Folder of each bucket in a version, and the version that wrote it."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").filter("bucket is not null").collect()
        return {r["bucket"]: (r["folder"], r["since"]) for r in rows}

    def versions(self) -> list[int]:
        found = self.spark.read.schema(MANIFEST + ", version int").parquet(f"{self.path}/manifest")
        return sorted(r["version"] for r in found.select("version").distinct().collect())

    def rewritten(self, version: int) -> list[int]:
        """Buckets that a version wrote anew."""
        return sorted(b for b, (_, since) in self.live(version).items() if since == version)

    def read(self, version: int | None = None, among: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named, of all buckets or some."""
        live = self.live(self.versions()[-1] if version is None else version)
        folders = [f"{self.path}/{folder}/bucket={b}" for b, (folder, _) in live.items() if among is None or b in among]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def backfill(self, texts: DataFrame, fields: Sequence[str], version: int) -> int:
        """The next version after ``version``: stored rows with a NULL among ``fields`` take what ``texts`` (one row per key) has for them.
        Returns how many buckets were written.

        Only buckets that a key of ``texts`` falls into are read, and of these only those that hold a row which changes are
        written; the others stay as they lie. The same texts again change nothing. A batch that is run again starts from the
        same version and ends in the same rows.
        """
        live = self.live(version)
        touched = [r["bucket"] for r in texts.select(self._bucket().alias("bucket")).distinct().collect()]  # one row per bucket at most
        held = self.read(version, touched)
        before = [F.col(f).alias(f"_before_{f}") for f in fields]
        after = backfill(held.select(self.key, *fields, *before), texts, self.key, fields)
        change = F.lit(False)
        for f in fields:
            change = change | ~F.col(f).eqNullSafe(F.col(f"_before_{f}"))
        changed = [r["bucket"] for r in after.filter(change).select(self._bucket().alias("bucket")).distinct().collect()]
        new = self._write(backfill(self.read(version, changed), texts, self.key, fields), version + 1, changed) if changed else {}
        self._publish(version + 1, live, new)
        return len(new)
