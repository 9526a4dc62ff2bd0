"""Array and series functions (F rows)."""

from pyspark.sql import functions as F

from almanac.functions import series as S
from almanac.operators import features as X
from almanac.operators import records as R
from almanac.operators.index import hash_index
from almanac.plans import Book, table
from almanac.plans.rendered import SERIES, SQL_HOURS, SQL_RECORDS, SQL_REPORTS, hours, records, reports
from almanac.storage import written

BOOK = Book()
SHORT = {name: short for name, (short, _) in SERIES.items()} | {"times": "times"}


def _fill(short: str) -> str:
    return f"list_transform({short}, lambda v: CASE WHEN v = 'NaN' THEN '<missing>' ELSE v END)"


def context_sql(name: str, filled: bool = False) -> str:
    parts = [SHORT[c] for c in S.CONTEXTS[name]]
    cells = " || ';' || ".join(
        f"CASE WHEN {p}[i] = 'NaN' THEN '<missing>' ELSE {p}[i] END" if filled else f"{p}[i]" for p in parts)
    return f"array_to_string(list_transform(range(1, len(times) + 1), lambda i: {cells}), ';')"


@BOOK.add("F1_fill_missing", SQL_RECORDS + f"""
SELECT path, array_to_string({_fill('clearness')}, ';') AS clearness, array_to_string({_fill('wolken')}, ';') AS clouds FROM rec""")
def f1(spark, sf):
    return R.fill_series(records(spark, sf)).select(
        "path", F.array_join("clearness", ";").alias("clearness"), F.array_join("bewölkungsgrad", ";").alias("clouds"))


def _context_query(name: str):
    def query(spark, sf):
        return records(spark, sf).select("path", S.context(S.CONTEXTS[name]).alias("context"))

    return query


for _i, _name in zip(range(2, 7), S.CONTEXTS):
    BOOK.add(f"F{_i}_context_{_name}", SQL_RECORDS + f"SELECT path, {context_sql(_name)} AS context FROM rec")(_context_query(_name))


@BOOK.add("F7_choose_columns", SQL_REPORTS + f"SELECT {context_sql('ct')} AS context, report AS target FROM rep")
def f7(spark, sf):
    df = R.add_contexts(reports(spark, sf)).withColumnRenamed("report", "report_short_wout_boeen")
    return df.select(F.col(S.context_column("ct")).alias("context"), F.col(S.target_column("default")).alias("target"))


@BOOK.add("F8_forward_fill", SQL_HOURS + """,
span AS (SELECT user_id, day, unnest(range(min(h), 24)) AS h FROM hv GROUP BY user_id, day),
cell AS (SELECT user_id, day, h, CAST(amount AS DOUBLE) AS v FROM span LEFT JOIN hv USING (user_id, day, h))
SELECT 'Ort-' || CAST(user_id AS VARCHAR) AS city, day, h,
  coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY h ROWS UNBOUNDED PRECEDING), 0.0) AS rain FROM cell""")
def f8(spark, sf):
    filled = records(spark, sf).select(
        "city", F.col("created_day").alias("day"), "times", S.forward_fill("niederschlagsmenge_in_l_per_sqm").alias("rain"))
    rows = filled.select("city", "day", "times", F.posexplode("rain").alias("i", "rain"))
    return rows.select("city", "day", F.substring(F.get("times", F.col("i")), 1, 2).cast("bigint").alias("h"), "rain")


@BOOK.add("F9_cloud_fraction", SQL_HOURS + "SELECT user_id, day, h, round(CAST(k % 9 AS DOUBLE) / 8, 6) AS fraction FROM hv")
def f9(spark, sf):
    return hours(spark, sf).select("user_id", "day", "h", F.round(S.cloud_fraction(F.col("cloud")), 6).alias("fraction"))


@BOOK.add("F10_cyclic_hour", SQL_HOURS + """
SELECT user_id, day, h, round(CASE WHEN n > 3 THEN 0.0 ELSE sin(2 * pi() * h / 24) END, 6) + 0.0 AS hour_sin,
  round(CASE WHEN n > 3 THEN 1.0 ELSE cos(2 * pi() * h / 24) END, 6) + 0.0 AS hour_cos FROM hv""")
def f10(spark, sf):
    label = F.when(F.col("n") > 3, "Uhr - unklar").otherwise(F.col("slot"))
    sine, cosine = S.cyclic_hour(label)
    return hours(spark, sf).select(
        "user_id", "day", "h", (F.round(sine, 6) + 0.0).alias("hour_sin"), (F.round(cosine, 6) + 0.0).alias("hour_cos"))


_CLOCK = "TRY_CAST(substr({0}, 1, 2) AS DOUBLE) + TRY_CAST(substr({0}, 4, 2) AS DOUBLE) / 60"


@BOOK.add("F11_clock_hours", SQL_RECORDS + f"SELECT path, round({_CLOCK.format('sunrise')}, 6) AS rise, round({_CLOCK.format('sundown')}, 6) AS down FROM rec")
def f11(spark, sf):
    return records(spark, sf).select(
        "path", F.round(S.clock_hours("sunrise"), 6).alias("rise"), F.round(S.clock_hours("sundown"), 6).alias("down"))


SUN_SQL = f""",
slotted AS (SELECT path, unnest(times) AS slot, {_CLOCK.format('sunrise')} AS r, {_CLOCK.format('sundown')} AS s FROM rec),
sun AS (SELECT *, CAST(substr(slot, 1, 2) AS DOUBLE) AS c FROM slotted),
sunny AS (SELECT path, slot,
  CASE WHEN r IS NULL OR s IS NULL THEN 0.5 WHEN c >= r AND c <= s THEN 1.0 ELSE 0.0 END AS daylight,
  CASE WHEN r IS NULL OR s IS NULL THEN 0.0 WHEN c >= r AND c <= s THEN (c - r) / (s - r) WHEN c < r THEN -(r - c) / (24 - s + r) ELSE -1.0 END AS since_rise,
  CASE WHEN r IS NULL OR s IS NULL THEN 0.0 WHEN c >= r AND c <= s THEN (s - c) / (s - r) WHEN c < r THEN -1.0 ELSE -(c - s) / (24 - s + r) END AS until_set
FROM sun)"""


@BOOK.add("F12_sun_features", SQL_RECORDS + SUN_SQL + """
SELECT path, slot, CAST(daylight AS DOUBLE) AS daylight, round(since_rise, 10) + 0.0 AS since_rise, round(until_set, 10) + 0.0 AS until_set FROM sunny""")
def f12(spark, sf):
    slots = records(spark, sf).select(
        "path", S.clock_hours("sunrise").alias("rise"), S.clock_hours("sundown").alias("down"), F.explode("times").alias("slot"))
    slots = slots.withColumn("now", S.slot_start(F.col("slot")))
    day, since, until = S.sun_features(F.col("rise"), F.col("down"), F.col("now"))
    return slots.select("path", "slot", day.alias("daylight"), (F.round(since, 10) + 0.0).alias("since_rise"), (F.round(until, 10) + 0.0).alias("until_set"))


@BOOK.add("F13_one_hot_wind", SQL_RECORDS + """,
w AS (SELECT path, list_transform(richtung, lambda x: split_part(x, ' ', 1)) AS richtung FROM rec),
vocab AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT unnest(richtung) AS v FROM w) WHERE v <> 'NaN')
SELECT path, i - 1 AS pos, array_to_string(list_transform(vs, lambda v: CASE WHEN v = richtung[i] THEN '1.0' ELSE '0.0' END), ',') AS one_hot
FROM (SELECT path, richtung, unnest(range(1, len(richtung) + 1)) AS i FROM w), vocab""")
def f13(spark, sf):
    df = R.fix_wind(records(spark, sf))
    slots = df.withColumn("vocabulary", X.wind_vocabulary(df)).select("path", "vocabulary", F.posexplode("windrichtung").alias("pos", "direction"))
    return slots.select("path", F.col("pos").cast("bigint").alias("pos"), F.array_join(S.one_hot(F.col("direction"), F.col("vocabulary")).cast("array<string>"), ",").alias("one_hot"))


@BOOK.add("F14_hardly_any_sun", SQL_RECORDS + "SELECT path, CASE WHEN contains(sunhours, 'fast nicht zu sehen') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM rec")
def f14(spark, sf):
    return records(spark, sf).select("path", S.hardly_any_sun("sunhours").alias("flag"))


# Feature number, value and position of every slot; the one-hot block starts after ``numbers`` columns.
def _features_sql(numbers: list[str]) -> str:
    cells = ", ".join(f"{sql} AS n{i}" for i, sql in enumerate(numbers))
    n = len(numbers)
    names = "+ (SELECT len(vs) FROM vocab)"
    tail = ["sin(2 * pi() * h / 24)", "cos(2 * pi() * h / 24)", "daylight", "since_rise", "until_set", "flag"]
    parts = [f"SELECT path, pos, {i} AS feature, n{i} AS value FROM cell" for i in range(n)]
    parts.append(f"SELECT path, pos, {n} + j - 1 AS feature, CASE WHEN vs[j] = wind THEN 1.0 ELSE 0.0 END AS value "
                 "FROM cell, (SELECT vs, unnest(range(1, len(vs) + 1)) AS j FROM vocab)")
    parts += [f"SELECT path, pos, {n} {names} + {i} AS feature, {sql} AS value FROM cell" for i, sql in enumerate(tail)]
    return SUN_SQL + f""",
vocab AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT split_part(unnest(richtung), ' ', 1) AS v FROM rec) WHERE v <> 'NaN'),
flat AS (SELECT path, unnest(range(0, len(times))) AS pos, unnest(times) AS slot, unnest(temperatur) AS temp, unnest(risiko) AS risk, unnest(menge) AS amount,
  unnest(geschwindigkeit) AS speed, unnest(druck) AS pressure, unnest(feuchte) AS hum, unnest(wolken) AS cloud, split_part(unnest(richtung), ' ', 1) AS wind,
  CASE WHEN contains(sunhours, 'fast nicht zu sehen') THEN 1.0 ELSE 0.0 END AS flag FROM rec),
cell AS (SELECT f.*, daylight, since_rise, until_set, CAST(substr(f.slot, 1, 2) AS BIGINT) AS h, {cells} FROM flat f JOIN sunny s ON f.path = s.path AND f.slot = s.slot),
long AS (SELECT path, CAST(pos AS BIGINT) AS pos, CAST(feature AS BIGINT) AS feature, CAST(value AS DOUBLE) AS value FROM ({" UNION ALL ".join(parts)}))
"""


def _num(x: str) -> str:
    return f"TRY_CAST(nullif({x}, 'NaN') AS DOUBLE)"


_CLOUD = "TRY_CAST(nullif(split_part(cloud, '/', 1), 'NaN') AS DOUBLE) / 8"
_FFILL = f"coalesce(last_value({_num('amount')} IGNORE NULLS) OVER (PARTITION BY f.path ORDER BY pos ROWS UNBOUNDED PRECEDING), 0.0)"
def _wide_sql(numbers: int) -> str:
    """One row per slot: numbers, the one-hot block as text, the six closing features."""
    cells = [f"n{i}" for i in range(numbers)] + ["sin(2 * pi() * h / 24)", "cos(2 * pi() * h / 24)", "daylight", "since_rise", "until_set", "flag"]
    names = [f"n{i}" for i in range(numbers)] + TAIL
    columns = ", ".join(f"round(CAST({c} AS DOUBLE), 10) + 0.0 AS {n}" for c, n in zip(cells, names))
    return (f"SELECT path, CAST(pos AS BIGINT) AS pos, {columns}, array_to_string(list_transform(vs, "
            "lambda v: CASE WHEN v = wind THEN '1.0' ELSE '0.0' END), ',') AS one_hot FROM cell, vocab")


TAIL = ["hour_sin", "hour_cos", "daylight", "since_rise", "until_set", "hardly_any_sun"]
STANDARD_SQL = _features_sql([_num("temp"), _num("risk"), _FFILL, _num("speed"), _num("pressure"), _num("hum"), _CLOUD])
SIMPLE_SQL = _features_sql([_num("temp"), _num("hum"), _CLOUD])
def _wide(rows, numbers):
    def at(i):
        return F.round(F.element_at("features", i), 10) + 0.0

    block = F.slice("features", numbers + 1, F.size("features") - numbers - len(TAIL)).cast("array<string>")
    return rows.select(
        "path", F.col("pos").cast("bigint").alias("pos"), *[at(i + 1).alias(f"n{i}") for i in range(numbers)],
        *[at(i - len(TAIL)).alias(name) for i, name in enumerate(TAIL)], F.array_join(block, ",").alias("one_hot"))


def _rounded(long, *keys, digits=10):
    return long.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("feature").cast("bigint").alias("feature"),
                       (F.round("value", digits) + 0.0).alias("value"))


@BOOK.add("F15_standard_features", SQL_RECORDS + STANDARD_SQL + _wide_sql(7))
def f15(spark, sf):
    return _wide(X.feature_rows(records(spark, sf), "standard", "path"), 7)


@BOOK.add("F16_simple_features", SQL_RECORDS + SIMPLE_SQL + _wide_sql(3))
def f16(spark, sf):
    return _wide(X.feature_rows(records(spark, sf), "simple", "path"), 3)


@BOOK.add("F17_standardize_by_batch", SQL_RECORDS + SIMPLE_SQL + """,
placed AS (SELECT path, (row_number() OVER (ORDER BY md5('42|' || path), path) - 1) // 64 AS batch FROM rec)
SELECT batch, path, pos, feature, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8), 4) + 0.0 AS value
FROM long JOIN placed USING (path) WINDOW w AS (PARTITION BY batch, feature)""")
def f17(spark, sf):
    # Positions and wind directions are made from records, moments and values from features that were written once.
    held = written(records(spark, sf).select("path", *X.feature_columns("simple")), "records")
    batched = written(hash_index(held, ["path"]).withColumn("batch", F.floor(F.col("idx") / 64)).drop("idx"), "batched")
    rows = written(X.feature_rows(batched, "simple", ("batch", "path")), "features")
    return _rounded(X.standardize_by_batch(rows, "batch", "path"), "batch", "path", digits=4)


@BOOK.add("F18_standardize_globally", SQL_RECORDS + SIMPLE_SQL + """,
held AS MATERIALIZED (SELECT path, CAST(pos AS BIGINT) AS pos, list_concat([n0, n1, n2], list_transform(vs, lambda v: CASE WHEN v = wind THEN 1.0::DOUBLE ELSE 0.0 END),
  [sin(2 * pi() * h / 24), cos(2 * pi() * h / 24), daylight, since_rise, until_set, CAST(flag AS DOUBLE)]) AS f FROM cell, vocab),
m AS (SELECT avg(x) AS mean, stddev_samp(x) AS deviation FROM (SELECT unnest(f) AS x FROM held))
SELECT path, pos, CAST(i AS BIGINT) AS feature, round((f[i + 1] - mean) / (deviation + 1e-8), 6) + 0.0 AS value
FROM (SELECT path, pos, f, unnest(range(len(f))) AS i FROM held), m""")
def f18(spark, sf):
    # Directions are found in records, moments and values in features that were written once.
    held = written(records(spark, sf).select("path", *X.feature_columns("simple")), "records")
    rows = written(X.feature_rows(held, "simple", "path"), "features")
    return _rounded(X.standardize_globally(rows, "path"), "path", digits=6)


_TOKENS = ("replace(replace(replace(replace(replace(report, city, '<city>'), '°C', ' <degC>'), 'l/m²', ' <l_per_sqm>'), 'km/h', ' <kmh>'), '%', ' <percent>')")
CORPUS_SQL = SQL_REPORTS + ", corpus AS (SELECT path, city, " + ", ".join(
    f"{context_sql(c, True)} AS overview_{c}" for c in S.CONTEXTS) + f", {_TOKENS} AS report_short_wout_boeen FROM rep)"


def corpus(spark, sf):
    df = reports(spark, sf).withColumnRenamed("report", "report_short_wout_boeen")
    return R.corpus_rows(df, ("path",)).drop("temperatur_in_deg_C")


@BOOK.add("F19_corpus_rows", CORPUS_SQL + "SELECT * FROM corpus")
def f19(spark, sf):
    return corpus(spark, sf)


@BOOK.add("F20_hour_difference", """
SELECT ((hour(ts) - day(ts)) % 24 + 24) % 24 AS difference, count(*) AS n FROM events GROUP BY 1""")
def f20(spark, sf):
    ev = table(spark, sf, "events").select(F.hour("ts").cast("bigint").alias("scraped"), F.dayofmonth("ts").cast("bigint").alias("actual"))
    return ev.groupBy(S.hour_difference("scraped", "actual").alias("difference")).agg(F.count(F.lit(1)).alias("n"))


# Zones of the rendered city table; one of them does not exist.
ZONES = {"1-URGENT": "Europe/Berlin", "2-HIGH": "Asia/Kolkata", "3-MEDIUM": "America/St_Johns", "4-NOT SPECIFIED": "Nowhere/Land", "5-LOW": "Australia/Sydney"}


@BOOK.add("F21_utc_offset", """
WITH z AS (SELECT o_orderkey, o_orderdate AS t, CASE o_orderpriority WHEN '1-URGENT' THEN 'Europe/Berlin' WHEN '2-HIGH' THEN 'Asia/Kolkata'
  WHEN '3-MEDIUM' THEN 'America/St_Johns' WHEN '5-LOW' THEN 'Australia/Sydney' END AS zone FROM orders)
SELECT o_orderkey, CAST(date_diff('minute', t, (t AT TIME ZONE 'UTC') AT TIME ZONE zone) AS DOUBLE) / 60 AS utc_offset FROM z""")
def f21(spark, sf):
    zone = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.col("o_orderpriority")]
    return table(spark, sf, "orders").select(
        "o_orderkey", S.utc_offset_hours(zone, F.col("o_orderdate")).cast("double").alias("utc_offset"))
