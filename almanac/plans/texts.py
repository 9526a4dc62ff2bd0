"""Record repair and text rewriting (E rows)."""

from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import entities, records as R
from almanac.operators.requests import request_lines
from almanac.plans import Book, table
from almanac.plans.rendered import SQL_RECORDS, SQL_REPORTS, records, reports

BOOK = Book()
_MASKED = "replace(report, city, '<city>')"


def _units(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '°C', ' <degC>'), 'l/m²', ' <l_per_sqm>'), 'km/h', ' <kmh>'), '%', ' <percent>')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


@BOOK.add("E1_drop_gust_sentences", SQL_REPORTS + "SELECT path, report FROM rep")
def e1(spark, sf):
    return reports(spark, sf).select("path", "report")


@BOOK.add("E2_first_wind_token", SQL_RECORDS + """
SELECT path, array_to_string(list_transform(richtung, lambda w: split_part(w, ' ', 1)), ';') AS wind FROM rec""")
def e2(spark, sf):
    return R.fix_wind(records(spark, sf)).select("path", F.array_join("windrichtung", ";").alias("wind"))


@BOOK.add("E3_rename_speed", SQL_RECORDS + """
SELECT path, CASE WHEN n > 2 THEN 'old' ELSE array_to_string(geschwindigkeit, ';') END AS speed FROM rec""")
def e3(spark, sf):
    df = records(spark, sf).withColumn("windgeschwindigkeit_in_km_per_s", F.when(F.col("n") > 2, F.array(F.lit("old"))))
    return R.fix_wind(df).select("path", F.array_join("windgeschwindigkeit_in_km_per_h", ";").alias("speed"))


def _rewritten_sql() -> str:
    parts = ["CASE WHEN lang = 'de' THEN 'Hier ist dein Bericht:' || chr(10) || chr(10) ELSE ' ' END",
             "'Der ' || source || ' – 20 ° C - „kalt“ ‚warm‘, **10-15 °C** 😀⛅ \"Sonnen tag\"-Wetter… '", "text",
             "'   ' || chr(10) || chr(10) || chr(10) || ' ''Zitat und Wort'' -gut Regen- und mild''-kalt ´<<x>>_ grin' || chr(173) || 'sen \"  '"]
    return "(" + " || ".join(parts) + ")"


def _clean_sql() -> str:
    x = f"replace({_rewritten_sql()}, source, '<city>')"
    for old, new in [("‚", ","), ("**", ""), ("*", ""), ("„", '"'), ("“", '"'), ("”", '"'), ("‘", "''"), ("’", "''")]:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"regexp_replace({x}, '°( *)[C]?', '°C', 'g')"
    x = rf"regexp_replace({x}, '([0-9]+)( +)°C', '\1°C', 'g')"
    for old, new in [("–", "—"), (" - ", "—"), ("…", "")]:
        x = f"replace({x}, '{old}', '{new}')"
    ranges = "".join("-".join("\\x{%s}" % e for e in r.split("-")) for r in T.EMOJI_RANGES)
    x = f"regexp_replace({x}, '[{ranges}]+', '', 'g')"
    head = f"WITH a AS (SELECT doc_id, source, {x} AS t FROM documents), b AS (SELECT *, string_split(t, chr(10) || chr(10)) AS p FROM a), "
    head += ("c AS (SELECT doc_id, source, CASE WHEN (starts_with(t, 'Hier') OR starts_with(t, 'Witziger')) AND len(p) > 1 AND "
             f"(ends_with({_strip('p[1]')}, ':') OR ends_with({_strip('p[1]')}, source)) "
             "THEN array_to_string(p[2:], chr(10) || chr(10)) ELSE t END AS t FROM b) ")
    y = r"regexp_replace(regexp_replace(t, '[ ]+[\n]{2,}', chr(10) || chr(10), 'g'), '[ ]{2,}', ' ', 'g')"
    for old, new in [("( +)''([A-Za-z0-9]+)", r'\1 \\"\2'), ("([A-Za-z0-9]+)''( +)", r'\1\\" \2'), ("([0-9]+)-([0-9])+", r"\1 bis \2"),
                     ("( +)-([A-Za-z]+)", r"-\2"), ("([A-Za-z]+)-( +)", r"\1-"), ("([a-z]+)''-([A-Za-z]+)", r'\1\\"-\2')]:
        y = f"regexp_replace({y}, '{old}', '{new}', 'g')"
    for old, new in [("´", "''"), *T.SOFT_HYPHEN_WORDS, ("<<", '"'), (">>", '"'), ("\\", '"'), ("_", '"'), ("—", " — ")]:
        y = f"replace({y}, '{old}', '{new}')"
    y = rf"""regexp_replace({y}, '"([A-Za-z0-9 ]+)"-([A-Za-z0-9]+)', '\1 \2', 'g')"""
    y = f"replace({y}, '<city>', source)"
    y = f"""regexp_replace(regexp_replace({_strip(y)}, '^"+', ''), '"+$', '')"""
    return head + f"SELECT doc_id, {_strip(y)} AS cleaned FROM c"


def _rewritten(spark, sf):
    nl = "\n"
    first = F.when(F.col("lang") == "de", "Hier ist dein Bericht:" + nl + nl).otherwise(" ")
    lead = F.concat(F.lit("Der "), "source", F.lit(" – 20 ° C - „kalt“ ‚warm‘, **10-15 °C** 😀⛅ \"Sonnen tag\"-Wetter… "))
    tail = F.lit("   \n\n\n 'Zitat und Wort' -gut Regen- und mild'-kalt ´<<x>>_ grin\u00adsen \"  ")
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("city"), F.concat(first, lead, "text", tail).alias("text"))


@BOOK.add("E4_clean_rewritten", _clean_sql())
def e4(spark, sf):
    return _rewritten(spark, sf).select("doc_id", T.clean_rewritten("text", "city").alias("cleaned"))


@BOOK.add("E4a_strip_emoji", "SELECT doc_id, regexp_replace(" + _rewritten_sql() + ", '[" + "".join(
    "-".join("\\x{%s}" % e for e in r.split("-")) for r in T.EMOJI_RANGES) + "]+', '', 'g') AS text FROM documents")
def e4a(spark, sf):
    return _rewritten(spark, sf).select("doc_id", T.strip_emoji("text").alias("text"))


@BOOK.add("E4b_drop_intro", "WITH a AS (SELECT doc_id, " + _rewritten_sql() + """ AS t FROM documents), b AS (SELECT *, string_split(t, chr(10) || chr(10)) AS p FROM a)
SELECT doc_id, CASE WHEN starts_with(t, 'Hier') AND len(p) > 1 AND ends_with(p[1], ':') THEN array_to_string(p[2:], chr(10) || chr(10)) ELSE t END AS text FROM b""")
def e4b(spark, sf):
    return _rewritten(spark, sf).select("doc_id", T.drop_intro("text", "city").alias("text"))


@BOOK.add("E5_mask_city", SQL_REPORTS + f"SELECT path, {_MASKED} AS text FROM rep")
def e5(spark, sf):
    return reports(spark, sf).select("path", T.mask_city("report", "city").alias("text"))


@BOOK.add("E6_unit_tokens", SQL_REPORTS + f"SELECT path, {_units('report')} AS text FROM rep")
def e6(spark, sf):
    return reports(spark, sf).select("path", T.unit_tokens("report").alias("text"))


def _tagged_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '\b' || regexp_escape(city) || '\b', '<city>', 'g')"
    for pattern, tag in T.UNIT_TAGS:
        x = f"regexp_replace({x}, '{pattern}', '{tag}', 'g')"
    x = f"replace(replace({x}, '*', ''), ' .', '.')"
    x = f"replace(replace({x}, chr(10) || chr(10), chr(10)), chr(10) || ' ', chr(10))"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


_DATES = r"regexp_replace({}, '\b[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}\b', '<date>', 'g')"


@BOOK.add("E7_city_and_unit_tags", SQL_RECORDS + f"SELECT path, {_tagged_sql('report_long')} AS text FROM rec WHERE report_long IS NOT NULL")
def e7(spark, sf):
    df = records(spark, sf).filter("report_long IS NOT NULL")
    return df.select("path", T.mask_city_and_units("report_long", "city").alias("text"))


@BOOK.add("E8_mask_dates", SQL_RECORDS + f"SELECT path, {_DATES.format('report_long')} AS text FROM rec WHERE report_long IS NOT NULL")
def e8(spark, sf):
    df = records(spark, sf).filter("report_long IS NOT NULL")
    return df.select("path", T.mask_dates("report_long").alias("text"))


@BOOK.add("E9_tagged_text", SQL_RECORDS + f""",
tagged AS (SELECT path, {_DATES.format(_tagged_sql('report_long'))} AS text FROM rec WHERE report_long IS NOT NULL)
SELECT path, CASE WHEN c_custkey IS NULL THEN text ELSE regexp_replace(text, 'Ort-[0-9]+', '<ne>', 'g') END AS text
FROM tagged LEFT JOIN customer ON regexp_extract(text, 'Ort-[0-9]+') = 'Ort-' || CAST(c_custkey AS VARCHAR)""")
def e9(spark, sf):
    df = records(spark, sf).filter("report_long IS NOT NULL").select("path", "city", F.col("report_long").alias("text"))
    places = table(spark, sf, "customer").select(F.concat(F.lit("Ort-"), F.col("c_custkey").cast("string")).alias("name"))
    return entities.tag_text(df, "path", "text", "city", places).select("path", "text")


_GAZETTEER = r"""
WITH gaz AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{7,}')) AS name FROM benchmark),
tok AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS t FROM documents),
pos AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok),
hit AS (SELECT doc_id, i, w, name FROM pos LEFT JOIN gaz ON w = name)
"""


def _gazetteer(spark, sf):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]{7,})"), F.lit(1)))
    return table(spark, sf, "benchmark").select(found.alias("name"))


@BOOK.add("E10_mask_entities", _GAZETTEER + """
SELECT doc_id, CASE WHEN length(any_value(text)) <= 20 THEN any_value(text)
  ELSE string_agg(CASE WHEN name IS NULL THEN w ELSE '<ne>' END, '' ORDER BY i) END AS text
FROM hit JOIN tok USING (doc_id) GROUP BY doc_id""")
def e10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return entities.mask_entities(docs, "doc_id", "text", _gazetteer(spark, sf))


@BOOK.add("E11_entity_counts", _GAZETTEER + """
SELECT name, count(*) AS n FROM hit WHERE name IS NOT NULL GROUP BY name""")
def e11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return entities.entity_counts(docs, "doc_id", "text", _gazetteer(spark, sf))


@BOOK.add("E12_unmask_city", SQL_REPORTS + f"SELECT path, replace({_MASKED}, '<city>', created_day) AS text FROM rep")
def e12(spark, sf):
    return reports(spark, sf).select("path", T.unmask_city(T.mask_city("report", "city"), "created_day").alias("text"))


@BOOK.add("E13_remove_punctuation", "SELECT doc_id, translate(text, '.,;!?:', '') AS text FROM documents")
def e13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.remove_punctuation("text").alias("text"))


def _tidy_sql(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({x}, '[ ]{{2,}}', ' ', 'g'), ' (-) ([0-9]+)', ' \1\2', 'g')")


_LOOSE = "'  ' || replace(report, '-', '-  ') || '   '"


def _loose():
    return F.concat(F.lit("  "), F.replace("report", F.lit("-"), F.lit("-  ")), F.lit("   "))


@BOOK.add("E14_tidy_text", SQL_REPORTS + f"SELECT path, {_tidy_sql(_LOOSE)} AS text FROM rep")
def e14(spark, sf):
    return reports(spark, sf).select("path", T.tidy(_loose()).alias("text"))


@BOOK.add("E15_display_text", SQL_REPORTS + f"""
SELECT path, replace(replace({_tidy_sql("replace(" + _MASKED + ", '°C', '  <degC>')")}, '<city>', city), ' <degC>', '°C') AS text FROM rep""")
def e15(spark, sf):
    shown = F.replace(T.mask_city("report", "city"), F.lit("°C"), F.lit("  <degC>"))
    return reports(spark, sf).select("path", T.display_text(shown, "city").alias("text"))


@BOOK.add("E16_profiling_text", SQL_REPORTS + f"SELECT path, regexp_replace(replace({_MASKED}, '°C', ' <degC>'), '[.,;:?!]', '', 'g') AS text FROM rep")
def e16(spark, sf):
    return reports(spark, sf).select("path", T.profiling_text("report", "city").alias("text"))


@BOOK.add("E17_similarity_text", SQL_REPORTS + f"""
SELECT path, regexp_replace(regexp_replace(replace({_MASKED}, '°C', ''), '[.,;:?!]', '', 'g'), '-?[0-9]+', '<number>', 'g') AS text FROM rep""")
def e17(spark, sf):
    return reports(spark, sf).select("path", T.similarity_text("report", "city").alias("text"))


@BOOK.add("E18_request_rows", SQL_REPORTS + f"""
SELECT to_json({{'custom_id': split_part(string_split(path, '-')[-1], '_', 1), 'method': 'POST', 'url': '/v1/chat/completions',
  'body': {{'model': 'gpt-4o-mini', 'messages': [{{'role': 'system', 'content': 'Du schreibst Wetterberichte.'}},
    {{'role': 'user', 'content': 'Schreibe um: "' || {_MASKED} || '" Kurz.'}}], 'max_tokens': 400}}}})::VARCHAR AS value FROM rep""")
def e18(spark, sf):
    return request_lines(reports(spark, sf), "path", "city", "report", "Du schreibst Wetterberichte.", "Schreibe um:", "Kurz.")


@BOOK.add("E19_file_identifier", SQL_RECORDS + "SELECT path, split_part(string_split(path, '-')[-1], '_', 1) AS id FROM rec")
def e19(spark, sf):
    return records(spark, sf).select("path", T.file_identifier("path").alias("id"))


@BOOK.add("E20_reduce_columns", SQL_REPORTS + "SELECT city, report AS report_short_wout_boeen, array_to_string(temperatur, ',') AS temperatures FROM rep")
def e20(spark, sf):
    kept = R.reduce_columns(reports(spark, sf).withColumnRenamed("report", "report_short_wout_boeen"))
    return kept.select(*[c for c in kept.columns if c != "temperatur_in_deg_C"], F.array_join("temperatur_in_deg_C", ",").alias("temperatures"))


@BOOK.add("E21_text_fallback", SQL_RECORDS + """
SELECT path, coalesce(report_long, report_short) AS standard, coalesce(report_short, report_long) AS simple FROM rec""")
def e21(spark, sf):
    df = records(spark, sf).withColumn("gpt_rewritten_v2", F.col("report_short"))
    return df.select("path", R.source_text(df, "standard").alias("standard"), R.source_text(df, "simple").alias("simple"))


@BOOK.add("E22_location", "SELECT c_custkey, c_name || ' ' || s_name AS location FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def e22(spark, sf):
    places = table(spark, sf, "customer").join(table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    return places.select("c_custkey", R.location("c_name", "s_name").alias("location"))
