"""Scans, sources and sinks (A rows). Files are written below the shared folder and read back."""

from pyspark.sql import functions as F

from almanac.functions import text as X
from almanac.operators.requests import response_text
from almanac.operators.sampling import random_split
from almanac.plans import Book, table
from almanac.plans.profile import ZONED_SQL, zoned
from almanac.plans.rendered import SQL_RECORDS, SQL_REPORTS, records, reports
from almanac.schema import CORRUPT, RECORD_SCHEMA
from almanac.sources import records as R
from almanac.sources import tables as C
from almanac.sources.planned import write_planned, write_record_files
from almanac.storage import fresh_path

BOOK = Book()
_FIELDS = [f.name for f in RECORD_SCHEMA if f.name != CORRUPT]


def _shaped(df):
    """Record columns of the fixed schema the rendered records have."""
    df = df.withColumn("report_short_wout_boeen", X.drop_gust_sentences("report_short"))
    return df.select("path", *[c for c in _FIELDS if c in df.columns])


def archive(spark, sf):
    """(path, content): every record as JSON text, its raw sibling, and a broken text for days without a report."""
    df = _shaped(records(spark, sf))
    broken = F.when(F.col("report_short").isNull(), F.concat(F.lit("{"), _content(df))).otherwise(_content(df))
    both = F.array(
        F.struct("path", broken.alias("content")), F.struct(_sibling().alias("path"), F.lit("{}").alias("content")))
    return df.select(F.inline(both))


def _content(df):
    return F.to_json(F.struct(*[c for c in df.columns if c != "path"]))


def _sibling():
    """Path of the raw record beside a standardised one."""
    return F.replace("path", F.lit("_standardised"), F.lit(""))


@BOOK.add("A1_scan_records", SQL_REPORTS + """
SELECT path, city, report_short, array_to_string(times, ',') AS times, array_to_string(menge, ',') AS rain FROM rep""")
def a1(spark, sf):
    """One record per file: the standardised ones are told from their raw siblings by name, and carry day and file as path."""
    path = fresh_path(spark, "records")
    rows = reports(spark, sf)
    shaped = _shaped(rows)
    both = F.array(F.struct("path", _content(shaped).alias("content")), F.struct(_sibling().alias("path"), F.lit("{}").alias("content")))
    write_record_files(shaped.select(F.inline(both)), path, "path", "content")
    return R.scan_records(spark, path).select(
        "path", "city", "report_short", F.array_join("times", ",").alias("times"), F.array_join("niederschlagsmenge_in_l_per_sqm", ",").alias("rain"))


LINES_PER_FILE = 50


def _planned(spark, sf):
    """The records by day in planned files, a record a line; path and plan."""
    path = fresh_path(spark, "days")
    rows = _shaped(records(spark, sf)).withColumn("day", F.col("created_day")).drop("path")
    return path, write_planned(rows, path, "day", LINES_PER_FILE)


def _scan_days(spark, path):
    scanned = R.scan_records(spark, path, "*.json", multi_line=False)
    return scanned.withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+/file=[^/]+/[^/]+)$", 1))


@BOOK.add("A1_scan_lines", SQL_RECORDS + """
SELECT created_day AS day, city, report_short, array_to_string(times, ',') AS times, array_to_string(menge, ',') AS rain FROM rec""")
def a1_lines(spark, sf):
    path, _ = _planned(spark, sf)
    return _scan_days(spark, path).select(
        F.substring_index("path", "/", 1).alias("day"), "city", "report_short", F.array_join("times", ",").alias("times"),
        F.array_join("niederschlagsmenge_in_l_per_sqm", ",").alias("rain"))


@BOOK.add("A2_day_counts", SQL_RECORDS + """
SELECT created_day AS day, count(*) AS found, count(*) FILTER (report_short IS NOT NULL AND len(times) = 24) AS with_data FROM rec GROUP BY created_day""")
def a2(spark, sf):
    path, _ = _planned(spark, sf)
    return R.day_counts(_scan_days(spark, path))


@BOOK.add("A2_planned_files", SQL_RECORDS + f"""
SELECT created_day AS day, count(*) AS records, CAST(ceil(count(*) / {LINES_PER_FILE}.0) AS BIGINT) AS planned, true AS within FROM rec GROUP BY created_day""")
def a2_files(spark, sf):
    """Per day the planned number of files, and whether no more were written, between them with all its records."""
    path, plan = _planned(spark, sf)
    scanned = _scan_days(spark, path)
    found = scanned.groupBy(F.substring_index("path", "/", 1).alias("day")).agg(
        F.count(F.lit(1)).alias("found"), F.count_distinct("path").alias("made"))
    return plan.join(found, "day").select(
        "day", "records", F.col("files").cast("bigint").alias("planned"), (F.expr("made <= files and found = records")).alias("within"))


_MANIFEST = """,
placed AS (SELECT path, city, row_number() OVER (ORDER BY md5('42|' || path), path) - 1 AS idx, count(*) OVER () AS n FROM rep),
manifest AS (SELECT path, city, CASE WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'eval' ELSE 'test' END AS split FROM placed)
"""


@BOOK.add("A3_scan_split", SQL_REPORTS + _MANIFEST + "SELECT path, city FROM manifest WHERE split = 'eval'")
def a3(spark, sf):
    df = reports(spark, sf)
    manifest = random_split(df.select("path"), "path").select("path", "split")
    return R.scan_split(df.select("path", "city"), manifest, "eval")


@BOOK.add("A4_records_with_text", SQL_REPORTS + "SELECT path, report_long FROM rep WHERE report_long IS NOT NULL")
def a4(spark, sf):
    df = reports(spark, sf).select("path", "report_long")
    manifest = random_split(df.select("path"), "path").select("path", "split")
    return R.with_text(R.scan_split(df, manifest, ["train", "eval", "test"]), "report_long")


@BOOK.add("A5_tolerant_scan", SQL_RECORDS + "SELECT path, city FROM rec WHERE report_short IS NOT NULL")
def a5(spark, sf):
    return R.readable(R.parse_archive(R.named_records(archive(spark, sf)), "content")).select("path", "city")


@BOOK.add("A6_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'a \"' || c_mktsegment || '\", b' END AS note FROM customer")
def a6(spark, sf):
    path = fresh_path(spark, "csv")
    quoted = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit('a "'), "c_mktsegment", F.lit('", b')))
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", quoted.alias("note"))
    C.write_csv(df, path)
    return C.read_csv(spark, path, df.schema)


@BOOK.add("A7_response_scan", "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS custom_id, CASE WHEN turn > 3 THEN NULL ELSE text END AS content FROM conversations WHERE role = 'assistant'")
def a7(spark, sf):
    path = fresh_path(spark, "responses")
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    choices = F.when(F.col("turn") <= 3, F.array(choice)).otherwise(F.array().cast("array<struct<message:struct<content:string>>>"))
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("custom_id"),
        F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"))
    C.write_json_lines(rows, path)
    return C.read_json_lines(spark, path).select("custom_id", response_text().alias("content"))


@BOOK.add("A8_json_lines_sink", SQL_REPORTS + """
SELECT to_json({'custom_id': path, 'city': city, 'n': n})::VARCHAR AS value FROM rep""")
def a8(spark, sf):
    path = fresh_path(spark, "lines")
    C.write_json_lines(reports(spark, sf).select(F.col("path").alias("custom_id"), "city", "n"), path)
    return spark.read.text(path)


@BOOK.add("A9_numbered_splits", """
SELECT CAST(split_k AS BIGINT) AS split_k, count(*) AS lines, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS members FROM
  (SELECT o_orderkey, (row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) // 5000 AS split_k FROM orders) GROUP BY split_k""")
def a9(spark, sf):
    path = fresh_path(spark, "splits")
    lines = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("line"))
    C.write_numbered_splits(lines, path, ["o_orderkey"], "line")
    # A file has at most 5000 lines, so gathering it here is bounded.
    files = spark.read.text(path).groupBy(F.col("split_k").cast("bigint").alias("split_k"))
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.col("value").cast("bigint"))), lambda v: v.cast("string")), ",")
    return files.agg(F.count(F.lit(1)).alias("lines"), F.md5(members).alias("members"))


@BOOK.add("A10_record_sink", SQL_RECORDS + "SELECT path, array_to_string(wolken, ',') AS clouds, report_short AS report FROM rec")
def a10(spark, sf):
    path = fresh_path(spark, "sink")
    df = records(spark, sf).select("path", "bewölkungsgrad", "report_short")
    R.write_records(df, path)
    return spark.read.schema(df.schema).json(path).select(
        "path", F.array_join("bewölkungsgrad", ",").alias("clouds"), F.col("report_short").alias("report"))


@BOOK.add("A11_sink_by_offset", ZONED_SQL + "SELECT bucket, c_custkey, zone FROM named")
def a11(spark, sf):
    path = fresh_path(spark, "offsets")
    C.write_by_offset(zoned(spark, sf), path, "off")
    return spark.read.schema("c_custkey bigint, zone string, bucket string").options(**C.CSV).csv(path).select("bucket", "c_custkey", "zone")


_OVERVIEW = ["Time", "Clearness", "Wind Direction", "Extras"]


@BOOK.add("A12_embedded_csv", SQL_RECORDS + '''
SELECT path, 'Time,Clearness,Wind Direction,Extras' || chr(10) || array_to_string(list_transform(range(1, len(times) + 1), lambda i:
  times[i] || ',' || clearness[i] || ',"' || richtung[i] || ', ""frisch""",'), chr(10)) || chr(10) AS overview FROM rec''')
def a12(spark, sf):
    return _overview(records(spark, sf))


def _overview(df):
    wind = F.transform("windrichtung", lambda w: F.concat(w, F.lit(', "frisch"')))
    columns = {"Time": F.col("times"), "Clearness": F.col("clearness"), "Wind Direction": wind, "Extras": F.transform("times", lambda t: F.lit(""))}
    return df.select("path", C.to_csv_text(columns).alias("overview"))


@BOOK.add("A12_embedded_csv_back", SQL_RECORDS + """
SELECT path, unnest(times) AS "Time", unnest(clearness) AS "Clearness", unnest(richtung) || ', "frisch"' AS "Wind Direction" FROM rec""")
def a12_back(spark, sf):
    rows = _overview(records(spark, sf)).select("path", F.inline(C.from_csv_text("overview", _OVERVIEW)))
    return rows.select("path", "Time", "Clearness", "Wind Direction")


@BOOK.add("A13_write_splits", SQL_REPORTS + _MANIFEST + """
SELECT split, 'data/' || path AS path, rep.city, report_short, array_to_string(times, ',') AS times FROM manifest JOIN rep USING (path)""")
def a13(spark, sf):
    """The manifest, and beside it what the copies hold."""
    df = _shaped(reports(spark, sf))
    split = df.join(random_split(df.select("path"), "path").select("path", "split"), "path")
    path = fresh_path(spark, "dataset")
    manifest = R.write_splits(split, path)
    copies = spark.read.schema(split.schema).parquet(f"{path}/data").withColumn("path", F.concat(F.lit("data/"), "path"))
    return manifest.join(copies, ["split", "path"]).select("split", "path", "city", "report_short", F.array_join("times", ",").alias("times"))


@BOOK.add("A14_merge_city_files", """
WITH f AS (SELECT DISTINCT replace(c_mktsegment, 'I', '_') || '.csv' AS file, 'C' || c_nationkey AS city, CAST(NULL AS VARCHAR) AS country FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT DISTINCT 'South_America.csv', 'C' || c_nationkey, 'N' || c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT file, city AS "City", CASE WHEN file = 'South_America.csv' THEN country ELSE replace(replace(file, '.csv', ''), '_', ' ') END AS "Country" FROM f""")
def a14(spark, sf):
    path = fresh_path(spark, "cities")
    own = F.col("c_mktsegment") == "BUILDING"
    key = F.col("c_nationkey").cast("string")
    df = table(spark, sf, "customer").select(
        F.when(own, "South_America.csv").otherwise(F.concat(F.replace("c_mktsegment", F.lit("I"), F.lit("_")), F.lit(".csv"))).alias("file"),
        F.concat(F.lit("C"), key).alias("City"), F.when(own, F.concat(F.lit("N"), key)).alias("Country"))
    df.write.partitionBy("file").options(**C.CSV).csv(path)
    scanned = spark.read.schema("City string, Country string, file string").options(**C.CSV).csv(path)
    return C.merge_city_files(scanned, "file", "South_America.csv").select("file", "City", "Country")


