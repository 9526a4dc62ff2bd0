"""Page extraction (B rows)."""

from pyspark.sql import functions as F

from almanac.functions import pages as P
from almanac.functions.pages import Field
from almanac.operators.extract import standardise_pages
from almanac.operators.gates import drop_small_groups
from almanac.plans import Book, table
from almanac.plans.rendered import SERIES, SQL_HOURS, SQL_RECORDS, hours, records

BOOK = Book()


def _plain(x: str) -> str:
    for entity, sign in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


def _tag(name: str) -> str:
    return _plain(f"regexp_extract(html, '<{name}>([^<]*)<', 1)")


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


@BOOK.add("B1_page_fields", f"""
SELECT page_id, {_strip(_tag('title'))} AS title, {_strip(_tag('h1'))} AS heading, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, CAST(NULL AS VARCHAR) AS sunrise FROM pages""")
def b1(spark, sf):
    fields = {"title": Field("title"), "heading": Field("h1"), "lang": Field("html", "@lang"),
              "sunrise": Field("span", "tail", "title", "Sonnenaufgang")}
    return P.with_fields(table(spark, sf, "pages"), "html", fields).select("page_id", *fields)


@BOOK.add("B2_mixed_text", rf"""
SELECT page_id, {_strip(r"regexp_replace(" + _plain("array_to_string(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=[^>]*>([^<]*)</a>', 1), ' ')") + r", '\s+', ' ', 'g')")} AS links FROM pages""")
def b2(spark, sf):
    return P.with_fields(table(spark, sf, "pages"), "html", {"links": Field("nav", "mixed")}).select("page_id", "links")


@BOOK.add("B3_first_text_and_attribute", f"""
SELECT page_id, {_strip(_plain("regexp_extract(html, '<div class=.ad.>([^<]*)<', 1)"))} AS notice, {_plain("regexp_extract(html, '<a href=.([^>]*).>', 1)")} AS link FROM pages""")
def b3(spark, sf):
    fields = {"notice": Field("div", "first", "class", "ad", contains=True), "link": Field("a", "@href")}
    return P.with_fields(table(spark, sf, "pages"), "html", fields).select("page_id", *fields)


@BOOK.add("B4_time_descriptions", SQL_RECORDS + """
SELECT path, substr(unnest(times), 1, 2) || ':00' AS time, unnest(clearness) || ' Regen' AS description FROM rec""")
def b4(spark, sf):
    parts = F.transform(F.arrays_zip("times", "clearness"), lambda s: F.concat(
        F.substring(s["times"], 1, 2), F.lit(":00  "), s["clearness"], F.lit(" Regen \n\t")))
    flat = F.concat(F.lit(" Weitere Werte anzeigen\n"), F.array_join(parts, " "))
    rows = records(spark, sf).select("path", flat.alias("flat"))
    return rows.select("path", F.inline(P.time_descriptions("flat")))


@BOOK.add("B5_hour_columns", SQL_HOURS + """
SELECT user_id, day, h, CASE WHEN n > 3 THEN '' ELSE slot END AS "Time", et AS "Clearness", CAST(abs(t) AS VARCHAR) || '°' AS "Temperature",
  CAST(k AS VARCHAR) || ' %' AS "Rain Chance", CAST(k % 10 AS VARCHAR) || ' l/m²' AS "Rain Amount", split_part(wdir, ' ', 1) AS "Wind Direction",
  wspeed || ' km/h' AS "Wind Speed", CASE WHEN n = 1 THEN '' ELSE 'Böen ' || CAST(n AS VARCHAR) END AS "Extras" FROM hv""")
def b5(spark, sf):
    def c(name):
        return F.col(name).cast("string")

    row = F.concat(
        F.when(F.col("n") > 3, "\n ca. ").otherwise(" \t"), "slot", F.lit("  "), "et", F.lit(" "), c("t"), F.lit("°\n "), c("k"), F.lit(" %  "),
        F.translate("amount", ".", ","), F.lit(" l/m² "), "wdir", F.lit(" "), "wspeed", F.lit(" km/h"),
        F.when(F.col("n") > 1, F.concat(F.lit(" Böen "), c("n"), F.lit("\n"))).otherwise(""))
    rows = hours(spark, sf).select("user_id", "day", "h", row.alias("row"))
    return rows.select("user_id", "day", "h", P.hour_columns("row").alias("c")).select("user_id", "day", "h", "c.*")


def _table_html(cells):
    """Rows of cells as a page with one table."""
    rows = F.transform(cells, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda v: F.concat(F.lit("<td> "), v, F.lit(" </td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit("<html><body><table class='d'>"), F.array_join(rows, ""), F.lit("</table><table><tr><td>x</td></tr></table></body></html>"))


@BOOK.add("B6_gate_before_parse", SQL_RECORDS + "SELECT path, CAST(len(times) AS BIGINT) AS n_cells FROM rec WHERE times[1] = '00 - 01 Uhr'")
def b6(spark, sf):
    kept = records(spark, sf).filter(P.on_time(F.col("times")))
    pages = kept.select("path", _table_html(F.array("temperatur_in_deg_C")).alias("html"))
    return pages.select("path", P.first_table("html").alias("cells")).select("path", F.size(F.get("cells", F.lit(0))).cast("bigint").alias("n_cells"))


@BOOK.add("B7_rows_of_two", SQL_RECORDS + """
SELECT path, unnest(times) || ';' || unnest(temperatur) || '°' AS pair FROM rec""")
def b7(spark, sf):
    flat = F.concat(F.lit("\n Ortsteile  "), F.array_join(F.transform(F.arrays_zip("times", "temperatur_in_deg_C"), lambda s: F.concat(
        s["times"], F.lit("   \t"), s["temperatur_in_deg_C"], F.lit("°"))), "     \n"))
    rows = records(spark, sf).select("path", flat.alias("flat"))
    return rows.select("path", F.explode(P.rows_of("flat", 2)).alias("r")).select("path", F.array_join("r", ";").alias("pair"))


@BOOK.add("B8_table_cells", SQL_RECORDS + """
SELECT path, CAST(0 AS BIGINT) AS row, generate_subscripts(times, 1) - 1 AS cell, unnest(times) AS value FROM rec
UNION ALL SELECT path, CAST(1 AS BIGINT), generate_subscripts(richtung, 1) - 1, unnest(richtung) FROM rec""")
def b8(spark, sf):
    pages = records(spark, sf).select("path", _table_html(F.array("times", "windrichtung")).alias("html"))
    rows = pages.select("path", F.posexplode(P.first_table("html")).alias("row", "r"))
    cells = rows.select("path", F.col("row").cast("bigint").alias("row"), F.posexplode("r").alias("cell", "value"))
    return cells.withColumn("cell", F.col("cell").cast("bigint"))


_PICKED = [("temperatur_in_deg_C", 6), ("niederschlagsrisiko_in_perc", 8), ("niederschlagsmenge_in_l_per_sqm", 10), ("windrichtung", 12),
           ("windgeschwindigkeit_in_km_per_h", 13), ("luftdruck_in_hpa", 15), ("relative_feuchte_in_perc", 17), ("bewölkungsgrad", 19)]


@BOOK.add("B9_assemble_record", SQL_RECORDS + "SELECT path, city, " + ", ".join(
    f"array_to_string({SERIES[c][0]}, ',') AS \"{c.replace('km_per_h', 'km_per_s')}\"" for c, _ in _PICKED) + " FROM rec")
def b9(spark, sf):
    at = {i: F.col(c) for c, i in _PICKED}
    pages = records(spark, sf).select("path", "city", _table_html(F.array(*[at.get(i, F.col("times")) for i in range(20)])).alias("html"))
    series = pages.select("path", "city", P.first_table("html").alias("cells")).select("path", "city", *P.diagram_series(F.col("cells")))
    return series.select("path", "city", *[F.array_join(c, ",").alias(c) for c in P.DIAGRAM_ROWS])


def _city_pages(spark, sf):
    """A city page for every record: texts, hourly rows and the diagram table where the site has them, and other things around."""
    df = records(spark, sf)

    def element(lead, value, tail):
        return F.coalesce(F.concat(F.lit(lead), value, F.lit(tail)), F.lit(""))

    slots = F.transform(F.arrays_zip("times", "clearness", "temperatur_in_deg_C"), lambda s: F.concat(
        F.lit("<div class='x swg-row-wrapper border--grey-next'> <b>"), s["times"], F.lit("</b>\n <i>"), s["clearness"], F.lit("</i> "), s["temperatur_in_deg_C"], F.lit("°</div>")))
    # A series fills its row of the table, the times all others; a row is made once of each.
    made = df.withColumns({f"_{c}": F.concat(F.lit("<tr>"), F.array_join(F.transform(c, lambda v: F.concat(F.lit("<td> "), v, F.lit(" </td>"))), ""), F.lit("</tr>"))
                           for c in ("times", *dict(_PICKED))})
    at = {i: F.col(f"_{c}") for c, i in _PICKED}
    cells = F.array(*[at.get(i, F.col("_times")) for i in range(20)])
    return made.withColumn("html", F.concat(
        F.lit("<!DOCTYPE html><html><head><script>if (a < b) { '<p>' }</script><!-- <table> --></head><body>"),
        element("<div id='cnt-with-location-attributes'><p>no</p><div><p> ", F.col("report_short"), " <em>x</em></p></div></div>"),
        element("<div id='furtherDetails'><div><div>", F.col("report_long"), "</div><div>no</div></div></div>"),
        F.lit("<p><span title='Sonnenaufgang'></span> "), "sunrise", F.lit("</p><p><span title='Sonnenuntergang'></span>"), "sundown",
        F.lit("</p><p><span class='icon icon-sun_hours'></span><b>no</b><span>"), "sunhours", F.lit("</span></p><table><tr><td>no</td></tr></table>"),
        F.lit("<div class='swg-row-wrapper border--grey-next'>outside</div><div id='uebersicht'>"), F.array_join(slots, ""),
        F.lit("</div><div id='vhs-detail-diagram'><table><thead><tr><th>head</th></tr></thead>"), F.array_join(cells, ""), F.lit("</table></div></body></html>"))).select(*df.columns, "html")


_LONG = r"trim(regexp_replace(translate(report_long, chr(10) || chr(9), ''), '\s+', ' ', 'g'))"
_TEXTS = f"report_short, {_LONG} AS report_long, sunrise, nullif(sundown, '') AS sundown, sunhours"


@BOOK.add("B1_city_page", SQL_RECORDS + f"SELECT path, {_TEXTS} FROM rec")
def b1_city(spark, sf):
    """The texts of a city page, as the raw record has them."""
    return P.with_fields(_city_pages(spark, sf).select("path", "html"), "html", P.CITY_PAGE).select("path", *P.CITY_PAGE)


@BOOK.add("B9_standardise_pages", SQL_RECORDS + f"SELECT path, city, {_TEXTS}, array_to_string(times, ',') AS times, array_to_string(clearness, ',') AS clearness, " + ", ".join(
    f"array_to_string({SERIES[c][0]}, ',') AS \"{c.replace('km_per_h', 'km_per_s')}\"" for c, _ in _PICKED) + " FROM rec WHERE times[1] = '00 - 01 Uhr'")
def b9_pages(spark, sf):
    """Pages to standardised records, the whole extraction."""
    found = standardise_pages(_city_pages(spark, sf).select("path", "city", "html"), "html")
    return found.select("path", "city", *P.CITY_PAGE, *[F.array_join(c, ",").alias(c) for c in ("times", "clearness", *P.DIAGRAM_ROWS)])


# A page of options per order: country links, a boundary, a status link, a boundary, a priority link; other values are noise.
def _options_html():
    def option(v):
        return F.concat(F.lit('<option value="'), v, F.lit('">x'))

    def link(c):
        return F.concat(F.lit("/"), F.col(c).cast("string"))

    return F.concat(F.lit("<select>"), option(link("o_custkey")), option(link("o_orderkey")), option(F.lit("")), option(F.lit("none")),
                    option(link("o_orderstatus")), option(F.lit("")), option(link("o_orderpriority")), F.lit("</select>"))


@BOOK.add("B10_option_harvest", """
SELECT o_orderkey, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM
  (SELECT o_orderkey, ['/' || o_custkey, '/' || o_orderkey, '', '/' || o_orderstatus, '', '/' || o_orderpriority] AS v FROM orders)""")
def b10(spark, sf):
    pages = spread(table(spark, sf, "orders")).select("o_orderkey", _options_html().alias("html"))
    rows = pages.select("o_orderkey", F.posexplode(P.options("html")).alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@BOOK.add("B11_sections", """
SELECT o_orderkey, '/' || o_custkey || ',/' || o_orderkey AS first, '/' || o_orderstatus AS second, '/' || o_orderpriority AS last FROM orders""")
def b11(spark, sf):
    pages = spread(table(spark, sf, "orders")).select("o_orderkey", P.options(_options_html()).alias("v"))
    return pages.select("o_orderkey", *[F.array_join(P.section(F.col("v"), k), ",").alias(n) for k, n in ((0, "first"), (1, "second"), (-1, "last"))])


@BOOK.add("B12_url_parts", r"""
SELECT page_id, string_split(url, '/')[4] AS segment, regexp_replace(string_split(url, '/')[-1], '\.html$', '') AS identifier, 'https://host' || url AS link FROM pages""")
def b12(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", P.segment("url", 3).alias("segment"), P.url_identifier("url").alias("identifier"), P.absolute("url", "https://host").alias("link"))


_TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@BOOK.add("B13_flatten_hierarchy", f"""
SELECT {_TITLE.format('c_name')} AS "Region", {_TITLE.format('n_name')} AS "Country", {_TITLE.format('r_name')} AS "Continent", 'https://host/' || c_custkey AS "Link"
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def b13(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    link = F.concat(F.lit("/"), F.col("c_custkey").cast("string"))
    tree = places.select(F.create_map("r_name", F.create_map("n_name", F.create_map("c_name", link))).alias("tree"))
    return P.flatten_hierarchy(tree, "tree", "https://host")


@BOOK.add("B14_true_name", "SELECT c_custkey, c_name AS name FROM customer")
def b14(spark, sf):
    sentence = F.concat(F.lit("Wie wird das Wetter heute in "), "c_name", F.lit("?"))
    return table(spark, sf, "customer").select("c_custkey", P.true_name(sentence, "Wie wird das Wetter heute in ").alias("name"))


#: Rows that one task makes pages of and reads them, about.
PAGES_PER_TASK = 20_000


def spread(df):
    """Rows of a table of few bytes, dealt over tasks by their number: each becomes a page, and by bytes one task would read them all."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism, -(-df.count() // PAGES_PER_TASK)))


@BOOK.add("B15_coordinates", """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS "Latitude", CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) END AS "Longitude",
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'could not convert string to float: ''n/a''' END AS "Error", 'Zone/' || c_nationkey AS "Timezone"
FROM customer WHERE c_mktsegment <> 'MACHINERY' ORDER BY "Timezone" """)
def b15(spark, sf):
    def meta(content):
        return F.concat(F.lit('<meta name="m" content="'), content, F.lit('">'))

    other = "".join('<meta name="m" content="x">' for _ in range(13))
    lat = F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.col("c_acctbal").cast("string"))
    html = F.concat(F.lit("<html><head>" + other), meta(lat), meta(F.col("c_nationkey").cast("string")), F.lit("</head></html>"))
    zone = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("Zone/"), F.col("c_nationkey").cast("string")))
    cities = spread(table(spark, sf, "customer")).select("c_custkey", P.harvest(html, "meta", "content").alias("m"), zone.alias("Timezone"))
    return P.located(P.with_coordinates(cities, F.get("m", F.lit(13)), F.get("m", F.lit(14))).drop("m"), "Timezone")


@BOOK.add("B16_wanted_links", f"""
SELECT DISTINCT link FROM (SELECT {_plain("unnest(regexp_extract_all(html, '<a href=.([^>]*).>', 1))")} AS link FROM pages)
WHERE contains(link, 'th') AND link NOT IN ('/the', '/that')""")
def b16(spark, sf):
    return P.wanted_links(table(spark, sf, "pages"), "html", "th", ["/the", "/that"])


@BOOK.add("B16_large_tables", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 7)")
def b16_tables(spark, sf):
    return drop_small_groups(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 7)
