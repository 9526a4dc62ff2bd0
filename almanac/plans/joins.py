"""Joins and enrichment (D rows) and the plug-in rows M1, M2."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from almanac.functions import text as T
from almanac.operators import enrich as E
from almanac.operators.sampling import random_split
from almanac.plans import Book, table
from almanac.plans.rendered import SQL_RECORDS, SQL_REPORTS, records, reports

BOOK = Book()


@BOOK.add("D1_true_names", SQL_RECORDS + """
SELECT path, c_name AS city FROM rec JOIN customer ON string_split(city, '-')[-1] = CAST(c_custkey AS VARCHAR)""")
def d1(spark, sf):
    cities = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Identifier"), F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("True Name"))
    return E.with_true_names(records(spark, sf).select("path", "city"), cities)


@BOOK.add("D2_left_join_columns", """
SELECT c_custkey AS url, c_name, s_name, s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def d2(spark, sf):
    cities = table(spark, sf, "customer").select(F.col("c_custkey").alias("url"), "c_name")
    zones = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "url")
    return E.with_columns_of(cities, zones, "url", ["s_name", "s_acctbal"])


@BOOK.add("D3_remove_listed", "SELECT c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def d3(spark, sf):
    regions = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("url"))
    return E.without(table(spark, sf, "customer").select(F.col("c_custkey").alias("url")), regions, ["url"])


@BOOK.add("D3_removed_count", """
SELECT count(*) AS n_before, count(*) FILTER (s_suppkey IS NULL) AS n_after, count(*) FILTER (s_suppkey IS NOT NULL) AS n_removed
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def d3_count(spark, sf):
    regions = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("url"))
    return E.removal_counts(table(spark, sf, "customer").select(F.col("c_custkey").alias("url")), regions, ["url"])


@BOOK.add("D4_skip_existing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def d4(spark, sf):
    done = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return E.without(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@BOOK.add("D5_backfill_texts", SQL_RECORDS + """
SELECT path,
  CASE WHEN report_short IS NULL OR report_long IS NULL THEN coalesce('Nachtrag ' || created_time, report_short) ELSE report_short END AS report_short,
  CASE WHEN report_short IS NULL OR report_long IS NULL THEN coalesce(CASE WHEN k0 > 20 THEN 'Mehr ' || city END, report_long) ELSE report_long END AS report_long
FROM (SELECT *, TRY_CAST(split_part(sunhours, ' ', 1) AS BIGINT) * 6 AS k0 FROM rec)""")
def d5(spark, sf):
    df = records(spark, sf)
    k0 = F.split("sunhours", " ")[0].try_cast("bigint") * 6
    crawled = df.select(
        "path", F.concat(F.lit("Nachtrag "), F.col("created_time")).alias("report_short"),
        F.when(k0 > 20, F.concat(F.lit("Mehr "), F.col("city"))).alias("report_long"))
    return E.backfill(df.select("path", "report_short", "report_long"), crawled, "path", ["report_short", "report_long"])


@BOOK.add("D6_merge_responses", """
WITH last AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, last.text AS gpt_rewritten_informell FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN last USING (conv_id)""")
def d6(spark, sf):
    conv = table(spark, sf, "conversations")
    answers = conv.filter("role = 'assistant'")
    return E.merge_responses(conv.select("conv_id").distinct(), answers, "conv_id", [F.col("turn")], "text", "gpt_rewritten_informell")


@BOOK.add("D7_transfer_text", SQL_REPORTS + """
SELECT path, CASE WHEN n > 3 THEN replace(replace(report, city, '<city>'), '<city>', city) END AS gpt_rewritten_apo, n <= 3 AS missing FROM rep""")
def d7(spark, sf):
    df = reports(spark, sf)
    source = df.filter("n > 3").select("path", T.mask_city("report", "city").alias("rewritten"))
    return E.transfer_text(df.select("path", "city"), source, "path", "rewritten", "gpt_rewritten_apo").select(
        "path", "gpt_rewritten_apo", "missing")


@BOOK.add("D8_negative_pairs", """
WITH placed AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx,
                  count(*) OVER () AS n, CAST('0x' || substr(md5('42-pair|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS draw FROM documents)
SELECT a.doc_id, b.doc_id AS partner_doc_id, md5(a.text) AS class_1, md5(b.text) AS class_0
FROM placed a JOIN placed b ON b.idx = (a.idx + a.draw % greatest(a.n - 1, 1) + 1) % a.n""")
def d8(spark, sf):
    pairs = E.negative_pairs(table(spark, sf, "documents"), "doc_id", "text")
    return pairs.select("doc_id", "partner_doc_id", F.md5("class_1").alias("class_1"), F.md5("class_0").alias("class_0"))


@F.pandas_udf(StringType())
def _spoken(location: pd.Series) -> pd.Series:
    """Stand-in for a translation service: swaps the two words, fails (NULL) on Spanish places."""
    return location.map(lambda s: None if s.endswith(" es") else " ".join(reversed(s.split(" "))))


@BOOK.add("D9_enrich_distinct", """
SELECT doc_id, source || ' ' || lang AS location, CASE WHEN lang = 'es' THEN source || ' es' ELSE lang || ' ' || source END AS translated FROM documents""")
def d9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(" "), "lang").alias("location"))
    return E.enrich_distinct(docs, "location", _spoken, "translated")


_SPLIT = """
WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
cut AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS b FROM placed)
SELECT doc_id, CASE WHEN idx < a THEN 'train' WHEN idx < a + b THEN 'eval' ELSE 'test' END AS split FROM cut"""


@BOOK.add("D10_union_of_splits", _SPLIT)
def d10(spark, sf):
    split = random_split(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return E.union_splits(*[split.filter(F.col("split") == s).select("doc_id", "split") for s in ("train", "eval", "test")])


@BOOK.add("D11_file_index", SQL_RECORDS + """,
placed AS (SELECT string_split(path, '/')[-1] AS file, city, row_number() OVER (ORDER BY path) - 1 AS position FROM rec),
named AS (SELECT *, split_part(string_split(file, '-')[-1], '_', 1) AS id FROM placed)
SELECT id, arg_max(city, position) AS city, arg_max(file, position) AS file, max(position) AS position FROM named GROUP BY id""")
def d11(spark, sf):
    return E.file_index(records(spark, sf).select("path", "city"), "path", "city")


@F.pandas_udf(DoubleType())
def _share_of_vowels(text: pd.Series) -> pd.Series:
    return text.str.count("[aeiou]") / text.str.len()


@BOOK.add("M1_user_scorer", """
SELECT doc_id, round(len(regexp_replace(text, '[^aeiou]', '', 'g')) / CAST(len(text) AS DOUBLE), 6) AS score FROM documents""")
def m1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(_share_of_vowels("text"), 6).alias("score"))


@BOOK.add("M2_user_transform", SQL_REPORTS + """
SELECT path, replace(replace(report, city, '<city>'), '.', '') AS text FROM rep""")
def m2(spark, sf):
    from almanac.operators.records import pipeline

    return pipeline(
        reports(spark, sf),
        lambda df: df.withColumn("text", T.mask_city("report", "city")),
        lambda df: df.withColumn("text", F.replace("text", F.lit("."), F.lit(""))),
    ).select("path", "text")
