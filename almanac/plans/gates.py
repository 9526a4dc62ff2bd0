"""Filters and predicates (C rows)."""

from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import gates as G
from almanac.operators.features import feature_rows, finite_records
from almanac.plans import Book, table
from almanac.plans.rendered import SQL_RECORDS, SQL_REPORTS, records, reports

BOOK = Book()


@BOOK.add("C1_starts_at_midnight", SQL_RECORDS + "SELECT path, city FROM rec WHERE times[1] = '00 - 01 Uhr' AND report_short IS NOT NULL")
def c1(spark, sf):
    return records(spark, sf).filter(G.starts_at_midnight()).select("path", "city")


@BOOK.add("C2_complete_records", SQL_RECORDS + "SELECT path FROM rec WHERE report_short IS NOT NULL AND len(times) = 24")
def c2(spark, sf):
    df = records(spark, sf).withColumn("report_short_wout_boeen", T.drop_gust_sentences("report_short"))
    return df.filter(G.is_complete(df)).select("path")


@BOOK.add("C3_temperatures_agree", SQL_REPORTS + r"""
SELECT path, report FROM rep
WHERE len(list_filter(list_filter(regexp_split_to_array(replace(replace(report, '°C', ''), '.', ''), '\s+'),
          lambda w: regexp_matches(w, '^[+-]?([0-9]+(_[0-9]+)*([eE][+-]?[0-9]+(_[0-9]+)*)?|nan|inf|infinity)$')),
          lambda w: NOT list_contains(temperatur, w))) = 0""")
def c3(spark, sf):
    return reports(spark, sf).filter(G.temperatures_agree("report", "temperatur_in_deg_C")).select("path", "report")


# Records of some counts have a blank city, lack the rain risk (which only one profile asks for) or the temperature (which both do), or
# lack the text.
@BOOK.add("C4_loadable_by_profile", SQL_RECORDS + """
SELECT path, n % 5 <> 0 AND n % 3 <> 0 AND n % 7 <> 0 AND report_long IS NOT NULL AS standard, n % 5 <> 0 AND n % 7 <> 0 AND report_long IS NOT NULL AS simple FROM rec""")
def c4(spark, sf):
    df = records(spark, sf)

    def lacking(name, every):
        return F.when(F.col("n") % every != 0, F.col(name))

    df = df.withColumns({
        "city": F.when(F.col("n") % 5 == 0, " \t").otherwise(F.col("city")), "niederschlagsrisiko_in_perc": lacking("niederschlagsrisiko_in_perc", 3),
        "temperatur_in_deg_C": lacking("temperatur_in_deg_C", 7)})
    return df.select("path", G.loadable(df, "standard").alias("standard"), G.loadable(df, "simple").alias("simple"))


@BOOK.add("C5_finite_features", SQL_RECORDS + """
SELECT path FROM rec
WHERE NOT list_contains(temperatur, 'NaN') AND NOT list_contains(risiko, 'NaN') AND NOT list_contains(geschwindigkeit, 'NaN')
  AND NOT list_contains(druck, 'NaN') AND NOT list_contains(feuchte, 'NaN') AND NOT list_contains(wolken, 'NaN')""")
def c5(spark, sf):
    return finite_records(feature_rows(records(spark, sf), "standard", "path"), "path")


@BOOK.add("C6_cascade_delete", SQL_RECORDS + """
SELECT 'raw' AS kind, path FROM rec WHERE report_short IS NOT NULL
UNION ALL SELECT 'standardised' AS kind, path FROM rec WHERE report_short IS NOT NULL""")
def c6(spark, sf):
    df = records(spark, sf)
    raw, standard = G.drop_undescribed(df.select("path", "report_short"), df.select("path"), "path", F.col("report_short"))
    return raw.select(F.lit("raw").alias("kind"), "path").unionByName(standard.select(F.lit("standardised").alias("kind"), "path"))


@BOOK.add("C7_cities_due", """
SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 5""")
def c7(spark, sf):
    return G.due_cities(table(spark, sf, "customer"), 19, "c_nationkey", "c_custkey").select("c_custkey", "c_name")


_ACTIVE = """,
first AS (SELECT split_part(string_split(path, '-')[-1], '_', 1) AS id, arg_min(report_short IS NOT NULL, path) AS active FROM rec GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS identifier, c_acctbal AS longitude, coalesce(active, false) AS active
FROM customer LEFT JOIN first ON CAST(c_custkey AS VARCHAR) = id"""


def _active(spark, sf):
    cities = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("identifier"), F.col("c_acctbal").alias("longitude"))
    return G.active_flag(cities, records(spark, sf), "identifier", "path", "report_short")


@BOOK.add("C8_active_cities", SQL_RECORDS + _ACTIVE)
def c8(spark, sf):
    return _active(spark, sf)


@BOOK.add("C9_search_cities", "SELECT c_name FROM customer WHERE contains(lower(c_name), 'omer#00000001') ORDER BY c_name")
def c9(spark, sf):
    return G.search_names(table(spark, sf, "customer").select("c_name"), "c_name", "OMER#00000001")


@BOOK.add("C10_flagged_cities", "SELECT identifier, longitude FROM (" + SQL_RECORDS + _ACTIVE + ") WHERE active")
def c10(spark, sf):
    return _active(spark, sf).filter("active").select("identifier", "longitude")


@BOOK.add("C11_text_changed", SQL_REPORTS + "SELECT path, report FROM rep WHERE report_short <> report")
def c11(spark, sf):
    return reports(spark, sf).filter(F.col("report_short") != F.col("report")).select("path", "report")
