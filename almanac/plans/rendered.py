"""Records derived from the given tables, in Spark and as the same SQL for DuckDB.

``records``: one row per user and day of ``events`` in the standardised shape. The series run from the hour of the first
event to the end of the day, so complete days and late starts both occur; hours without an event are 'NaN'.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.plans import table
from almanac.schema import NAN

# Day, hour and cell values of one hour, from its events.
_HOURS = """
ev AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%d.%m.%Y') AS day_de,
         CAST(hour(ts) AS BIGINT) AS h, strftime(ts, '%H:%M:%S') AS clock, event_type AS et,
         CAST(floor(value / 10) AS BIGINT) - 10 AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
       FROM events),
hr AS (SELECT user_id, day, day_de, h, max(et) AS et, max(t) AS t, max(k) AS k, min(clock) AS clock, count(*) AS n
       FROM ev GROUP BY ALL),
hv AS (SELECT *, lpad(CAST(h AS VARCHAR), 2, '0') || ' - ' || lpad(CAST(h + 1 AS VARCHAR), 2, '0') || ' Uhr' AS slot,
         CAST(t AS VARCHAR) AS temp, CAST(k AS VARCHAR) AS risk,
         CAST(k // 10 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) AS amount,
         CASE WHEN k >= 50 THEN upper(substr(et, 1, 2)) || ' ' || CAST(k AS VARCHAR) ELSE upper(substr(et, 1, 2)) END AS wdir,
         CAST(k + h AS VARCHAR) AS wspeed, CAST(950 + k AS VARCHAR) AS pressure, CAST(k % 9 AS VARCHAR) || '/8' AS cloud
       FROM hr),
"""


def _sql_series(column: str) -> str:
    return (f"list_transform(range(h0, 24), lambda x: coalesce(map_extract(map(list(h), list({column})), x)[1], 'NaN'))")


_RECORDS = """
dy AS (SELECT user_id, day, day_de, min(h) AS h0, min(k) AS k0, max(k) AS k1, CAST(sum(n) AS BIGINT) AS n,
         min(t) AS t0, max(t) AS t1, min(clock) AS clock,
         {cells}
       FROM hv GROUP BY user_id, day, day_de),
rec AS (SELECT user_id, 'Ort-' || CAST(user_id AS VARCHAR) AS city, day AS created_day, clock AS created_time, day_de, n,
         day || '/Ort-' || CAST(user_id AS VARCHAR) || '_standardised.json' AS path,
         CASE WHEN n > 1 THEN 'In Ort-' || CAST(user_id AS VARCHAR) || ' liegen die Werte zwischen ' || CAST(t0 AS VARCHAR)
           || ' und ' || CAST(t1 AS VARCHAR) || '°C. Regen fällt zu ' || CAST(k0 AS VARCHAR) || '%, etwa '
           || CAST(k1 AS VARCHAR) || 'l/m².'
           || CASE WHEN n > 3 THEN ' Gefühlt sind es ' || CAST(k0 AS VARCHAR) || ' °C.' ELSE '' END
           || CASE WHEN k1 > 50 THEN ' Böen bis ' || CAST(k1 AS VARCHAR) || ' km/h.' ELSE '' END END AS report_short,
         CASE WHEN n > 2 THEN 'Stand ' || day_de || ': **Ort-' || CAST(user_id AS VARCHAR) || '** meldet ' || CAST(t1 AS VARCHAR)
           || ' ° C bei ' || CAST(k1 AS VARCHAR) || ' km/h Wind .' || chr(10) || chr(10) || 'Nahe Ort-' || CAST(user_id AS VARCHAR)
           || '1 sind es ' || CAST(k0 AS VARCHAR) || ' %  und ' || CAST(k1 AS VARCHAR) || ' l/m².' END AS report_long,
         CASE WHEN k0 < 5 THEN '-' ELSE lpad(CAST(5 + k0 % 3 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k0 % 60 AS VARCHAR), 2, '0') || ' Uhr' END AS sunrise,
         CASE WHEN k1 < 5 THEN '' ELSE lpad(CAST(17 + k1 % 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k1 % 60 AS VARCHAR), 2, '0') || ' Uhr' END AS sundown,
         CASE WHEN k0 > 60 THEN 'Die Sonne ist fast nicht zu sehen' ELSE CAST(k0 // 6 AS VARCHAR) || ' h' END AS sunhours,
         list_transform(range(h0, 24), lambda x: lpad(CAST(x AS VARCHAR), 2, '0') || ' - ' || lpad(CAST(x + 1 AS VARCHAR), 2, '0') || ' Uhr') AS times,
         clearness, temperatur, risiko, menge, richtung, geschwindigkeit, druck, feuchte, wolken
       FROM dy)
"""
# Short SQL names of the series next to their record names.
SERIES = {
    "clearness": ("clearness", "et"), "temperatur_in_deg_C": ("temperatur", "temp"),
    "niederschlagsrisiko_in_perc": ("risiko", "risk"), "niederschlagsmenge_in_l_per_sqm": ("menge", "amount"),
    "windrichtung": ("richtung", "wdir"), "windgeschwindigkeit_in_km_per_h": ("geschwindigkeit", "wspeed"),
    "luftdruck_in_hpa": ("druck", "pressure"), "relative_feuchte_in_perc": ("feuchte", "risk"),
    "bewölkungsgrad": ("wolken", "cloud"),
}
SQL_HOURS = "WITH " + _HOURS.strip().rstrip(",")
SQL_RECORDS = SQL_HOURS + "," + _RECORDS.replace(
    "{cells}", ",\n         ".join(f"{_sql_series(cell)} AS {short}" for short, cell in SERIES.values()))
# Report without gust sentences, and records that have one.
SQL_REPORTS = SQL_RECORDS + """,
rep AS (SELECT *, array_to_string(list_filter(string_split(report_short, '.'), lambda s: NOT contains(s, 'Böe')), '.') AS report
        FROM rec WHERE report_short IS NOT NULL)
"""


#: Events whose records one task makes at most, about.
EVENTS_PER_TASK = 50_000


def _text(c: Column) -> Column:
    return c.cast("string")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, day and hour that has an event, with its rendered cells.

    Events are dealt once, by user and day, over a number of tasks that grows with them and holds all cores: an event is few
    bytes, but pages, features and files of some kilobytes are made of it in the same task, and by its bytes Spark would put
    too much of that work together.
    """
    events = table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_PER_TASK))
    ev = events.select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "dd.MM.yyyy").alias("day_de"),
        F.hour("ts").cast("bigint").alias("h"),
        F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.col("event_type").alias("et"),
        (F.floor(F.col("value") / 10) - 10).alias("t"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    ).repartition(tasks, "user_id", "day", "day_de")
    hr = ev.groupBy("user_id", "day", "day_de", "h").agg(
        F.max("et").alias("et"), F.max("t").alias("t"), F.max("k").alias("k"), F.min("clock").alias("clock"),
        F.count(F.lit(1)).alias("n"))
    short = F.upper(F.substring("et", 1, 2))
    return hr.select(
        "*",
        slot_label(F.col("h")).alias("slot"),
        _text(F.col("t")).alias("temp"),
        _text(F.col("k")).alias("risk"),
        F.concat(_text(F.expr("k div 10")), F.lit("."), _text(F.col("k") % 10)).alias("amount"),
        F.when(F.col("k") >= 50, F.concat(short, F.lit(" "), _text(F.col("k")))).otherwise(short).alias("wdir"),
        _text(F.col("k") + F.col("h")).alias("wspeed"),
        _text(F.col("k") + 950).alias("pressure"),
        F.concat(_text(F.col("k") % 9), F.lit("/8")).alias("cloud"),
    )


def slot_label(h: Column) -> Column:
    return F.concat(F.lpad(_text(h), 2, "0"), F.lit(" - "), F.lpad(_text(h + 1), 2, "0"), F.lit(" Uhr"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sorted({cell for _, cell in SERIES.values()})
    # At most 24 hours per group, so the collected list is bounded.
    dy = hours(spark, sf_dir).groupBy("user_id", "day", "day_de").agg(
        F.min("h").alias("h0"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.sum("n").alias("n"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("clock").alias("clock"),
        F.map_from_entries(F.collect_list(F.struct("h", F.struct(*cells)))).alias("cells"),
    )
    slots = F.sequence(F.col("h0"), F.lit(23).cast("bigint"))
    city = F.concat(F.lit("Ort-"), _text(F.col("user_id")))
    k0, k1, n = F.col("k0"), F.col("k1"), F.col("n")

    def cells_of(cell: str):
        return lambda x: F.coalesce(F.try_element_at(F.col("cells"), x)[cell], F.lit(NAN))

    def two(c: Column) -> Column:
        return F.lpad(_text(c), 2, "0")

    def say(*parts) -> Column:
        return F.concat(*[_text(p) if isinstance(p, Column) else F.lit(p) for p in parts])

    report = F.when(n > 1, F.concat(
        say("In ", city, " liegen die Werte zwischen ", F.col("t0"), " und ", F.col("t1"), "°C. Regen fällt zu ", k0,
            "%, etwa ", k1, "l/m²."),
        F.when(n > 3, say(" Gefühlt sind es ", k0, " °C.")).otherwise(""),
        F.when(k1 > 50, say(" Böen bis ", k1, " km/h.")).otherwise("")))
    details = F.when(n > 2, say(
        "Stand ", F.col("day_de"), ": **", city, "** meldet ", F.col("t1"), " ° C bei ", k1, " km/h Wind .\n\nNahe ", city,
        "1 sind es ", k0, " %  und ", k1, " l/m²."))
    return dy.select(
        "user_id",
        city.alias("city"),
        F.col("day").alias("created_day"),
        F.col("clock").alias("created_time"),
        "day_de",
        "n",
        F.concat(F.col("day"), F.lit("/"), city, F.lit("_standardised.json")).alias("path"),
        report.alias("report_short"),
        details.alias("report_long"),
        F.when(k0 < 5, "-").otherwise(say(two(5 + k0 % 3), ":", two(k0 % 60), " Uhr")).alias("sunrise"),
        F.when(k1 < 5, "").otherwise(say(two(17 + k1 % 4), ":", two(k1 % 60), " Uhr")).alias("sundown"),
        F.when(k0 > 60, "Die Sonne ist fast nicht zu sehen").otherwise(say(F.expr("k0 div 6"), " h")).alias("sunhours"),
        F.transform(slots, slot_label).alias("times"),
        *[
            F.transform(slots, cells_of(cell)).alias(name)
            for name, (_, cell) in SERIES.items()
        ],
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have a report, with ``report``: the report without gust sentences."""
    from almanac.functions.text import drop_gust_sentences

    return records(spark, sf_dir).filter("report_short IS NOT NULL").withColumn(
        "report", drop_gust_sentences("report_short"))
