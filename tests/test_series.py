import math

import pytest
from pyspark.sql import functions as F

from almanac.functions import series as S
from almanac.operators import features as X
from almanac.operators import records as R

RECORD = {
    "city": "Ulm", "times": ["05 - 06 Uhr", "06 - 07 Uhr", "07 - 08 Uhr"], "clearness": ["klar", "NaN", "trüb"],
    "temperatur_in_deg_C": ["-3", "4", "5"], "niederschlagsrisiko_in_perc": ["10", "20", "30"],
    "niederschlagsmenge_in_l_per_sqm": ["NaN", "0.30", "NaN"], "windrichtung": ["N 3", "NO", "N"],
    "windgeschwindigkeit_in_km_per_h": ["7", "8", "9"], "luftdruck_in_hpa": ["1000", "1001", "1002"],
    "relative_feuchte_in_perc": ["50", "60", "70"], "bewölkungsgrad": ["0/8", "4/8", "8/8"],
    "sunrise": "06:30 Uhr", "sundown": "18:30 Uhr", "sunhours": "10 h",
}
SCHEMA = ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in RECORD.items())


def frame(spark, **changes):
    return spark.createDataFrame([tuple((RECORD | changes).values())], SCHEMA)


def test_missing_marker(spark):
    row = R.fill_series(frame(spark)).first()
    assert row["clearness"] == ["klar", "<missing>", "trüb"]
    assert row["niederschlagsmenge_in_l_per_sqm"] == ["<missing>", "0.30", "<missing>"]


@pytest.mark.parametrize("arrays, expected", [
    ((["a", "b"], ["1", "2"]), "a;1;b;2"),
    ((["a", "b", "c"], ["1"]), "a;1"),
    (([], ["1"]), ""),
    ((["a", None], ["1", "2"]), "a;1;None;2"),
])
def test_context(one, arrays, expected):
    assert one(S.context(["a", "b"]), "a array<string>, b array<string>", arrays) == expected


def test_names_are_checked():
    assert S.context_column("ct") == "overview_ct"
    assert S.target_column("gpt") == "gpt_rewritten_apo"
    for function in (S.context_column, S.target_column):
        with pytest.raises(ValueError):
            function("other")


@pytest.mark.parametrize("given, expected", [
    (["NaN", "NaN", "1.5", "NaN", "2"], [0.0, 0.0, 1.5, 1.5, 2.0]), ([], []), (["1d", None], [0.0, 0.0])])
def test_forward_fill(one, given, expected):
    assert one(S.forward_fill("a"), "a array<string>", (given,)) == expected


@pytest.mark.parametrize("given, expected", [
    ("06:30 Uhr", 6.5), ("-", None), ("", None), (None, None), ("6 Uhr", None), ("06:30:10 Uhr", None), ("x:30", None)])
def test_clock(one, given, expected):
    assert one(S.clock_hours("c"), "c string", (given,)) == expected


def sun_by_hand(rise, down, now):
    if now is None:
        return (0.0, 0.0, 0.0)
    if rise is None or down is None:
        return (0.5, 0.0, 0.0)
    night = 24 - down + rise
    if rise <= now <= down:
        return (1.0, (now - rise) / (down - rise), (down - now) / (down - rise))
    return (0.0, -(rise - now) / night, -1.0) if now < rise else (0.0, -1.0, -(now - down) / night)


def test_sun_features(spark):
    cases = [(r, d, n) for r in (6.5, None) for d in (18.25, None) for n in (0.0, 6.0, 7.0, 18.0, 23.0, None)]
    df = spark.createDataFrame(cases, "r double, d double, n double")
    got = df.select("r", "d", "n", F.array(*S.sun_features(F.col("r"), F.col("d"), F.col("n"))).alias("v")).collect()
    for row in got:
        assert row["v"] == pytest.approx(sun_by_hand(row["r"], row["d"], row["n"]))


def test_equal_sunrise_and_sundown_do_not_fail(one):
    assert one(S.sun_features(F.lit(6.0), F.lit(6.0), F.lit(6.0))[1]) is None


def test_cyclic_hour(one):
    sine, cosine = S.cyclic_hour(F.col("s"))
    assert one(F.array(sine, cosine), "s string", ("06 - 07 Uhr",)) == pytest.approx([1.0, 0.0])
    assert one(F.array(sine, cosine), "s string", ("Uhr",)) == [0.0, 1.0]


def test_wind_and_speed_repair(spark):
    df = frame(spark).withColumn("windgeschwindigkeit_in_km_per_s", F.array(F.lit("99")))
    row = R.fix_wind(df.withColumn("windrichtung", F.array(F.lit("N 3"), F.lit(" "), F.lit("SO")))).first()
    assert row["windrichtung"] == ["N", " ", "SO"]
    assert row["windgeschwindigkeit_in_km_per_h"] == ["99"]
    assert "windgeschwindigkeit_in_km_per_s" not in row.asDict()


def test_feature_rows(spark):
    rows = X.feature_rows(frame(spark), "standard", "city").orderBy("pos").collect()
    assert len(rows) == 3
    first = rows[0]["features"]
    assert first[:7] == [-3.0, 10.0, 0.0, 7.0, 1000.0, 50.0, 0.0]
    assert first[7:9] == [1.0, 0.0]
    assert first[9:11] == pytest.approx([math.sin(2 * math.pi * 5 / 24), math.cos(2 * math.pi * 5 / 24)])
    assert first[11:] == pytest.approx([0.0, -1.5 / 12, -1.0, 0.0])
    assert rows[2]["features"][2] == 0.3
    assert len(X.feature_rows(frame(spark), "simple", "city").first()["features"]) == 3 + 2 + 2 + 3 + 1


def test_finite_records(spark):
    both = frame(spark).unionByName(frame(spark, city="Bonn", temperatur_in_deg_C=["1", "NaN", "3"]))
    kept = X.finite_records(X.feature_rows(both, "standard", "city"), "city").collect()
    assert [r["city"] for r in kept] == ["Ulm"]


def test_unknown_zone_is_null(spark):
    df = spark.createDataFrame([("Asia/Kolkata",), ("Nowhere/Land",), (None,), ("America/St_Johns",)], "z string")
    instant = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    got = [r["v"] for r in df.select(S.utc_offset_hours("z", instant).cast("double").alias("v")).collect()]
    assert got == [5.5, None, None, -3.5]


def test_corpus_rows_keep_fixed_columns(spark):
    df = frame(spark).withColumn("report_short_wout_boeen", F.lit("In Ulm 5°C"))
    row = R.corpus_rows(df).first()
    assert row["report_short_wout_boeen"] == "In <city> 5 <degC>"
    assert row["overview_ct"] == "05 - 06 Uhr;klar;-3;06 - 07 Uhr;<missing>;4;07 - 08 Uhr;trüb;5"
    assert set(row.asDict()) == set(R.KEPT) - {"gpt_rewritten_cleaned", "gpt_rewritten_apo"}


def test_features_read_only_the_series_of_their_profile(spark):
    narrow = frame(spark).select("city", *X.feature_columns("simple"))
    assert not {"niederschlagsmenge_in_l_per_sqm", "luftdruck_in_hpa", "windgeschwindigkeit_in_km_per_h"}.intersection(narrow.columns)
    rows = X.feature_rows(narrow, "simple", "city").orderBy("pos").collect()
    assert rows == X.feature_rows(frame(spark), "simple", "city").orderBy("pos").collect() and len(rows) == 3


def test_standardized_values_come_from_features_written_once(spark):
    import __spark_entry__ as entry

    for name in ("F17_standardize_by_batch", "F18_standardize_globally"):
        read = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and all("/features-" in file for file in read)


def test_standardize(spark):
    rows = spark.createDataFrame([(0, "a", 0, [1.0, 4.0]), (0, "b", 0, [3.0, None]), (1, "c", 0, [7.0, 7.0])],
                                 "batch int, path string, pos int, features array<double>")
    got = {(r["path"], r["feature"]): r["value"] for r in X.standardize_by_batch(rows, "batch", "path").collect()}
    assert got["a", 0] == pytest.approx(-1 / math.sqrt(2)) and got["b", 0] == pytest.approx(1 / math.sqrt(2))
    assert [got[k] for k in (("a", 1), ("b", 1), ("c", 0), ("c", 1))] == [None] * 4
    values = [1.0, 4.0, 3.0, 7.0, 7.0]
    mean = sum(values) / 5
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / 4)
    got = {(r["path"], r["feature"]): r["value"] for r in X.standardize_globally(rows, "path").collect()}
    assert got["c", 1] == pytest.approx((7 - mean) / deviation) and got["b", 1] is None
