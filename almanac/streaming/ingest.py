"""The scheduled re-runs of the collection as streams: ingest, late texts, day completeness."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.enrich import backfill, latest_per_key
from almanac.storage import written
from almanac.streaming.store import BucketStore

HOURS = 24


def read_stream(spark: SparkSession, table: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The files of a table, a folder or a single file, as a stream; the checkpoint of the query remembers which were read."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A path that is a pattern (here one that matches itself only) may be a single file as well as a folder.
    return reader.parquet(f"{table[:-1]}[{table[-1]}]")


def unseen(stream: DataFrame, key: list[str], stamp: str, delay: str) -> DataFrame:
    """First row per key. State for a key is kept only as long as the watermark allows a repeat."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything that is there, in as many batches as it takes, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", target).trigger(availableNow=True).start())
    query.awaitTermination()


def latest_texts(batch: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the latest text that is not NULL."""
    latest = None
    for field in fields:
        one = latest_per_key(batch.filter(F.col(field).isNotNull()), [key], [F.col(order)]).select(key, field)
        latest = one if latest is None else latest.join(one, key, "full")
    return latest


def merge_late_texts(
    stream: DataFrame, stored: Callable[[int], DataFrame], save: Callable[[DataFrame, int], None], key: str, order: str,
    fields: list[str], checkpoint: str,
) -> None:
    """Backfill texts published later: each batch is merged into the stored rows and saved as the next version.

    ``stored(batch_id)`` reads the version the batch starts from and ``save(rows, batch_id)`` writes the one it ends
    with, so a batch that is run again after a failure starts from the same rows and gives the same result. A store
    that is large against its batches is better kept in buckets, see ``merge_into_store``.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        save(backfill(stored(batch_id), latest_texts(batch, key, order, fields), key, fields), batch_id)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_into_store(stream: DataFrame, store: BucketStore, order: str, fields: list[str], checkpoint: str, base: int = 0) -> None:
    """Backfill texts published later into a bucket store: batch i leads from version ``base`` + i to the next one, and rewrites only
    the buckets in which a row changes. ``base`` is the version the stream's first batch starts from.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        # Three steps read the texts of a batch; it is cut to one row per key and written once.
        texts = written(latest_texts(batch, store.key, order, fields), "late-texts")
        store.backfill(texts, fields, base + batch_id)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def complete_days(stream: DataFrame, entity: str, stamp: str, delay: str) -> DataFrame:
    """(entity, day, slots, complete): complete when all 24 UTC hours of the day have a row, the first hour included.

    Two chained windows under one watermark: hours first, so that the state holds one entry per entity and hour however
    many rows an hour has, then days. A day is emitted once the watermark has passed its end; later rows are dropped.
    """
    hours = stream.withWatermark(stamp, delay).groupBy(entity, F.window(stamp, "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("_n"))
    # Windows lie on UTC hours and days; hour and day are read off the instant itself, not in the session's zone.
    starts = hours.withColumn("_at", F.window_time("hour")).withColumn("_h", F.pmod(F.floor(F.unix_seconds("hour.start") / 3600), F.lit(24)))
    days = starts.groupBy(entity, F.window("_at", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("slots"), F.min("_h").alias("_first"))
    return days.select(
        entity, F.date_from_unix_date(F.floor(F.unix_seconds("day.start") / 86400).cast("int")).cast("string").alias("day"), "slots",
        ((F.col("slots") == HOURS) & (F.col("_first") == 0)).alias("complete"))
