"""Streams (L rows) over the given tables as files."""

from pyspark.sql import functions as F

from almanac.functions.series import utc_instant
from almanac.plans import Book, table
from almanac.storage import fresh_path
from almanac.streaming import ingest as S
from almanac.streaming.store import BucketStore

BOOK = Book()


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    # Event times become instants: watermarks need a timestamp with zone.
    return S.read_stream(spark, f"{sf}/events.parquet", schema).withColumn("ts", utc_instant("ts"))


@BOOK.add("L1_incremental_ingest", "SELECT event_id, user_id, event_type FROM events")
def l1(spark, sf):
    base = fresh_path(spark, "ingest")
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    S.ingest(S.unseen(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type"), f"{base}/rows", f"{base}/checkpoint")
    # A second run with the same checkpoint finds nothing new.
    S.ingest(S.unseen(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type"), f"{base}/rows", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/rows")


@BOOK.add("L2_late_texts", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'neu ' || d.source END AS report, CASE WHEN l.doc_id IS NULL OR l.quality = 0 THEN d.source END AS details
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def l2(spark, sf):
    base = fresh_path(spark, "late")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    labelled = F.col("quality").isNotNull()
    # Labelled documents lack their report; those of low quality keep their details.
    rows = docs.select("doc_id", F.when(~labelled, F.col("lang")).alias("report"), F.when(~labelled | (F.col("quality") == 0), F.col("source")).alias("details"))
    store = BucketStore.create(rows, f"{base}/store", "doc_id", buckets=16)
    schema = table(spark, sf, "documents").schema
    late = S.read_stream(spark, f"{sf}/documents.parquet", schema).select(
        "doc_id", F.concat(F.lit("neu "), "source").alias("report"), F.lit(None).cast("string").alias("details"), F.col("n_chars").alias("order"))
    S.merge_into_store(late, store, "order", ["report", "details"], f"{base}/checkpoint")
    return store.read()


@BOOK.add("L3_complete_days", """
WITH s AS (SELECT event_type, date_trunc('day', ts) AS d, count(DISTINCT hour(ts)) AS slots, min(hour(ts)) AS first FROM events GROUP BY ALL)
SELECT event_type, strftime(d, '%Y-%m-%d') AS day, slots, slots = 24 AND first = 0 AS complete FROM s
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def l3(spark, sf):
    base = fresh_path(spark, "days")
    S.ingest(S.complete_days(_events(spark, sf), "event_type", "ts", "10 minutes"), f"{base}/rows", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/rows")
