"""Ranking, top-k, sampling and splits (H rows)."""

from pyspark.sql import functions as F

from almanac.operators import enrich, profile, sampling as S
from almanac.plans import Book, table
from almanac.plans.joins import _SPLIT
from almanac.plans.profile import ZONED_SQL, zoned
from almanac.plans.rendered import SQL_RECORDS, records

BOOK = Book()
PLACED = """
WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
"""


@BOOK.add("H1_random_split", _SPLIT.replace("SELECT doc_id, CASE", "SELECT doc_id, idx, CASE"))
def h1(spark, sf):
    return S.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@BOOK.add("H2_holdout_split", PLACED + "SELECT doc_id, CASE WHEN idx < ceil(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM placed")
def h2(spark, sf):
    return S.holdout_split(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


# Sizes of the nested training subsets.
SIZES = [100, 200, 400, 800, 1600, 3200, 6400]


@BOOK.add("H3_nested_subsets", PLACED + f"SELECT size, doc_id, idx FROM placed, (SELECT CAST(unnest({SIZES}) AS BIGINT) AS size) WHERE idx < size")
def h3(spark, sf):
    return S.nested_subsets(table(spark, sf, "documents"), "doc_id", SIZES)


@BOOK.add("H4_sample_per_city", SQL_RECORDS + """
SELECT city, path, rank FROM (SELECT city, path, row_number() OVER (PARTITION BY city ORDER BY md5('42|' || path), path) AS rank FROM rec) WHERE rank <= 3""")
def h4(spark, sf):
    sample = S.sample_per_group(records(spark, sf).select("city", "path"), "city", "path", 3)
    return sample.withColumn("rank", F.col("rank").cast("bigint"))


@BOOK.add("H5_pick_cities", SQL_RECORDS + """
SELECT city, n FROM (SELECT city, count(*) AS n FROM rec GROUP BY city HAVING count(*) >= 3) ORDER BY md5('42|' || city), city LIMIT 5""")
def h5(spark, sf):
    return S.pick_cities(records(spark, sf), "city")


@BOOK.add("H5_check_cities", SQL_RECORDS + """
SELECT 'Ort-' || CAST(c_custkey AS VARCHAR) AS city, coalesce(n, 0) AS n, n IS NOT NULL AS found
FROM customer LEFT JOIN (SELECT city, count(*) AS n FROM rec GROUP BY city) r ON r.city = 'Ort-' || CAST(c_custkey AS VARCHAR)""")
def h5_check(spark, sf):
    requested = table(spark, sf, "customer").select(F.concat(F.lit("Ort-"), F.col("c_custkey").cast("string")).alias("city"))
    return S.check_cities(requested, records(spark, sf), "city")


@BOOK.add("H6_last_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def h6(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return enrich.latest_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


HISTORY_SQL = """
WITH history AS (SELECT l_suppkey AS run, CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS BIGINT) AS epoch, sum(l_quantity) AS value
                 FROM lineitem GROUP BY 1, 2)
"""


def history(spark, sf):
    """Months of a supplier as the epochs of a run; whole quantities, so equal values occur and sums are exact."""
    epoch = ((F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate")).cast("bigint")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), epoch.alias("epoch")).agg(F.sum("l_quantity").alias("value"))


@BOOK.add("H7_best_epoch", HISTORY_SQL + """
SELECT run, epoch AS best_epoch, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, epoch) AS r FROM history) WHERE r = 1""")
def h7(spark, sf):
    return S.best_epoch(history(spark, sf), "run", "epoch", "value")


@BOOK.add("H7_best_epoch_max", HISTORY_SQL + """
SELECT run, epoch AS best_epoch, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) AS r FROM history) WHERE r = 1""")
def h7_max(spark, sf):
    return S.best_epoch(history(spark, sf), "run", "epoch", "value", maximize=True)


@BOOK.add("H8_early_stop", HISTORY_SQL + """,
seen AS (SELECT a.run, a.epoch, (SELECT b.epoch FROM history b WHERE b.run = a.run AND b.epoch <= a.epoch ORDER BY b.value, b.epoch LIMIT 1) AS best FROM history a),
hit AS (SELECT run, min(epoch) AS stop FROM seen WHERE epoch - best >= 10 GROUP BY run)
SELECT r.run, stop AS stop_epoch, best AS best_epoch FROM (SELECT DISTINCT run FROM history) r LEFT JOIN hit USING (run) LEFT JOIN seen ON seen.run = r.run AND epoch = stop""")
def h8(spark, sf):
    return S.early_stop(history(spark, sf), "run", "epoch", "value")


@BOOK.add("H9_latest_ingest", """
SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events
WHERE strftime(ts, '%Y-%m-%d') NOT IN ('2024-01-30', 'build') ORDER BY ts DESC LIMIT 1""")
def h9(spark, sf):
    days = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return S.latest_ingest(days, "day", "stamp", ["2024-01-30", "build"])


@BOOK.add("H10_sort_names", "SELECT c_name FROM customer ORDER BY c_name")
def h10(spark, sf):
    return table(spark, sf, "customer").select("c_name").orderBy("c_name")


@BOOK.add("H10_sort_offsets", ZONED_SQL + "SELECT bucket || '.csv' AS filename, count(*) AS cities FROM named GROUP BY bucket ORDER BY cities DESC")
def h10_offsets(spark, sf):
    return profile.offset_summary(zoned(spark, sf), "off", "zone").select("filename", "cities")
