"""Aggregations (G rows)."""

from pyspark.sql import functions as F

from almanac.functions import series as S
from almanac.functions import text as T
from almanac.operators import gates, profile as P, sampling
from almanac.plans import Book, table
from almanac.plans.rendered import SQL_RECORDS, SQL_REPORTS, records, reports

BOOK = Book()
_PREP = "regexp_replace(replace(replace(report, city, '<city>'), '°C', ' <degC>'), '[.,;:?!]', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_SENTENCES = "len(regexp_extract_all(report, '[A-Za-z0-9]+[.!?]'))"
_SERIES = ["clearness", "temperatur", "risiko", "menge", "richtung", "geschwindigkeit", "wolken"]
_GAPS = " + ".join(f"len(list_filter({c}, lambda v: v = 'NaN'))" for c in _SERIES)
_CELLS = " + ".join(f"len({c})" for c in _SERIES)
_VOCAB = f"(SELECT DISTINCT unnest({_WORDS.format(_PREP)}) AS token FROM rep)"


@BOOK.add("G1_corpus_stats", SQL_REPORTS + f"""
SELECT count(*) AS number_of_files, round(avg(len({_WORDS.format(_PREP)})), 6) AS avg_length,
  (SELECT count(*) FROM {_VOCAB} WHERE NOT regexp_matches(token, '^-?[0-9]+')) AS vocab_size, count(DISTINCT city) AS n_cities,
  round(avg({_SENTENCES}), 6) AS avg_n_sentences, round(sum({_GAPS}) / CAST(sum({_CELLS}) AS DOUBLE) * 100, 6) AS perc_nans_in_context FROM rep""")
def g1(spark, sf):
    stats = P.corpus_stats(reports(spark, sf), "report", "city")
    return stats.select("number_of_files", "vocab_size", "n_cities", *[
        F.round(c, 6).alias(c) for c in ("avg_length", "avg_n_sentences", "perc_nans_in_context")])


@BOOK.add("G2_vocabulary_words", SQL_REPORTS + f"SELECT token FROM {_VOCAB} WHERE NOT regexp_matches(token, '^-?[0-9]+')")
def g2(spark, sf):
    return P.vocabulary_words(reports(spark, sf), "report", "city")


@BOOK.add("G3_words_per_report", "SELECT doc_id, CAST(len(" + _WORDS.format("replace(regexp_replace(replace(text, source, '<city>'), '[.,;:?!]', '', 'g'), '°C', ' <degC>')") + ") AS BIGINT) AS n FROM documents")
def g3(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", P.word_count(T.profiling_text("text", "source")).cast("bigint").alias("n"))


@BOOK.add("G4_distinct_cities", SQL_RECORDS + "SELECT count(DISTINCT city) AS n FROM rec")
def g4(spark, sf):
    return records(spark, sf).agg(F.count_distinct("city").alias("n"))


@BOOK.add("G5_sentences", "SELECT doc_id, CAST(" + _SENTENCES.replace("report", "text") + " AS BIGINT) AS n FROM documents")
def g5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.sentence_count("text").cast("bigint").alias("n"))


@BOOK.add("G6_missing_share", SQL_RECORDS + f"SELECT round(sum({_GAPS}) / CAST(sum({_CELLS}) AS DOUBLE), 6) AS missing_share FROM rec")
def g6(spark, sf):
    return P.missing_share(records(spark, sf)).select(F.round("missing_share", 6).alias("missing_share"))


@BOOK.add("G7_histogram", """
WITH r AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
c AS (SELECT least(CAST(floor((n_chars - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM documents, r GROUP BY 1)
SELECT range AS bin, round(lo + range * (hi - lo) / 20, 6) AS left, round(lo + (range + 1) * (hi - lo) / 20, 6) AS right, coalesce(n, 0) AS n
FROM range(20), r LEFT JOIN c ON bin = range""")
def g7(spark, sf):
    bins = P.histogram(table(spark, sf, "documents"), "n_chars", 20)
    return bins.select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n")


@BOOK.add("G7_histogram_fixed", """
WITH v AS (SELECT value / 500 AS x FROM events), c AS (SELECT least(CAST(floor(x * 40) AS BIGINT), 39) AS bin, count(*) AS n FROM v WHERE x BETWEEN 0 AND 1 GROUP BY 1)
SELECT range AS bin, coalesce(n, 0) AS n FROM range(40) LEFT JOIN c ON bin = range""")
def g7_fixed(spark, sf):
    values = table(spark, sf, "events").select((F.col("value") / 500).alias("x"))
    return P.histogram(values, "x", 40, 0.0, 1.0).select("bin", "n")


@BOOK.add("G8_start_census", SQL_RECORDS + """,
s AS (SELECT times[1] AS first, CASE WHEN starts_with(times[1], '01') THEN 'one' WHEN starts_with(times[1], '00') THEN 'zero' ELSE 'rest' END AS kind FROM rec)
SELECT kind, '' AS label, count(*) AS n FROM s GROUP BY kind
UNION ALL SELECT 'rest label', first, count(*) FROM s WHERE kind = 'rest' GROUP BY first""")
def g8(spark, sf):
    return P.start_census(records(spark, sf))


_ZONED = """
WITH z AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Asia/Kolkata' WHEN 'MACHINERY' THEN 'America/St_Johns'
  WHEN 'HOUSEHOLD' THEN 'Europe/Berlin' WHEN 'FURNITURE' THEN 'Europe/Paris' END AS zone FROM customer),
o AS (SELECT *, CAST(date_diff('minute', t, (t AT TIME ZONE 'UTC') AT TIME ZONE zone) AS DOUBLE) / 60 AS off
      FROM (SELECT *, TIMESTAMP '2024-07-01 12:00:00' AS t FROM z))
"""
_FILE = "'UTC_' || CASE WHEN off >= 0 THEN 'plus' ELSE 'minus' END || '_' || replace(CAST(abs(off) AS VARCHAR), '.', '_')"
ZONED_SQL = _ZONED + f", named AS (SELECT c_custkey, zone, off, {_FILE} AS bucket FROM o WHERE off IS NOT NULL)"


def zoned(spark, sf):
    """Customers as cities with a zone per market segment, one of them unknown, and the offset at one instant."""
    zones = {"BUILDING": "Asia/Kolkata", "MACHINERY": "America/St_Johns", "HOUSEHOLD": "Europe/Berlin", "FURNITURE": "Europe/Paris"}
    zone = F.coalesce(F.create_map(*[F.lit(x) for pair in zones.items() for x in pair])[F.col("c_mktsegment")], F.lit("Nowhere/Land"))
    instant = F.lit("2024-07-01 12:00:00").cast("timestamp_ntz")
    cities = table(spark, sf, "customer").select("c_custkey", zone.alias("zone"))
    return cities.withColumn("off", S.utc_offset_hours("zone", instant).cast("double"))


@BOOK.add("G9_offset_summary", ZONED_SQL + """
SELECT 'UTC' || CASE WHEN off >= 0 THEN '+' ELSE '' END || CAST(off AS VARCHAR) AS utc_offset, count(*) AS cities, bucket || '.csv' AS filename,
  string_agg(DISTINCT zone, ', ' ORDER BY zone) AS zones FROM named GROUP BY off, bucket ORDER BY cities DESC""")
def g9(spark, sf):
    return P.offset_summary(zoned(spark, sf), "off", "zone")


@BOOK.add("G10_city_index", SQL_RECORDS + "SELECT city, path FROM rec WHERE trim(city) <> ''")
def g10(spark, sf):
    return P.city_index(records(spark, sf), "city", "path")


@BOOK.add("G11_available_cities", SQL_RECORDS + """
SELECT city, count(*) AS n FROM rec WHERE report_long IS NOT NULL GROUP BY city HAVING count(*) >= 3 ORDER BY city""")
def g11(spark, sf):
    df = records(spark, sf)
    return sampling.city_counts(sampling.members_only(df.select("path", "city"), df.filter("report_long IS NOT NULL"), "path"), "city", 3)


@BOOK.add("G12_token_counts", "SELECT token, count(*) AS n FROM (SELECT unnest(" + _WORDS.format("text") + ") AS token FROM documents) GROUP BY token")
def g12(spark, sf):
    return P.token_counts(table(spark, sf, "documents").select(F.explode(T.words("text")).alias("token")))


TERMS_SQL = r"""
WITH prep AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, source, '<city>'), '°C', ''), '[.,;:?!]', '', 'g'), '-?[0-9]+', '<number>', 'g') AS t FROM documents),
w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS term FROM prep),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS documents FROM tf GROUP BY term)
"""


@BOOK.add("G13_term_frequency", TERMS_SQL + "SELECT * FROM tf")
def g13(spark, sf):
    return P.term_counts(table(spark, sf, "documents"), "doc_id", T.similarity_text("text", "source"))


@BOOK.add("G13_document_frequency", TERMS_SQL + "SELECT * FROM df")
def g13_df(spark, sf):
    return P.document_counts(g13(spark, sf))


@BOOK.add("G14_compare_tokens", r"""
WITH t AS (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS token FROM documents),
p AS (SELECT token, count(*) FILTER (lang = 'de') AS l, count(*) FILTER (lang = 'en') AS r, regexp_matches(token, '^-?[0-9]+') AS num FROM t WHERE lang IN ('de', 'en') GROUP BY token)
SELECT CAST(sum(l) AS BIGINT) AS left_tokens, count(*) FILTER (l > 0) AS left_distinct, CAST(sum(r) AS BIGINT) AS right_tokens, count(*) FILTER (r > 0) AS right_distinct,
  count(*) FILTER (l > 0 AND NOT num) AS left_non_numeric, count(*) FILTER (r > 0 AND num) AS right_numeric,
  count(*) FILTER (l > 0 AND r > 0) AS shared, count(*) AS all_tokens, round(count(*) FILTER (l > 0 AND r > 0) / CAST(count(*) AS DOUBLE), 6) AS iou FROM p""")
def g14(spark, sf):
    tokens = table(spark, sf, "documents").select("lang", F.explode(T.words("text")).alias("token"))
    row = P.compare_tokens(tokens.filter("lang = 'de'"), tokens.filter("lang = 'en'"))
    return row.withColumn("iou", F.round("iou", 6))


@BOOK.add("G15_gate_counts", SQL_RECORDS + """,
c AS (SELECT count(*) AS n0, count(*) FILTER (report_short IS NOT NULL) AS n1, count(*) FILTER (report_short IS NOT NULL AND report_long IS NOT NULL) AS n2,
  count(*) FILTER (report_short IS NOT NULL AND report_long IS NOT NULL AND len(times) = 24) AS n3 FROM rec)
SELECT CAST(1 AS BIGINT) AS step, 'report' AS gate, n1 AS kept, n0 - n1 AS dropped FROM c UNION ALL SELECT 2, 'details', n2, n1 - n2 FROM c
UNION ALL SELECT 3, 'slots', n3, n2 - n3 FROM c""")
def g15(spark, sf):
    return gates.gate_counts(records(spark, sf), {
        "report": F.col("report_short").isNotNull(), "details": F.col("report_long").isNotNull(), "slots": F.size("times") == 24})


@BOOK.add("G16_run_durations", """
SELECT l_suppkey AS run, count(*) AS epochs, round(CAST(date_diff('second', min(l_shipdate), max(l_shipdate)) AS DOUBLE) / count(*), 6) AS seconds_per_epoch
FROM lineitem GROUP BY l_suppkey""")
def g16(spark, sf):
    history = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), "l_shipdate")
    return sampling.run_durations(history, "run", "l_shipdate").withColumn("seconds_per_epoch", F.round("seconds_per_epoch", 6))
