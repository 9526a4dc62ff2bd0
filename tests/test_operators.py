import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanac.operators import enrich as E
from almanac.operators import entities as N
from almanac.operators import gates as G
from almanac.operators import index as I
from almanac.operators import profile as P
from almanac.operators import sampling as S
from almanac.storage import measured


def md5_order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def test_hash_index_is_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    got = {r["k"]: r["idx"] for r in I.hash_index(df, ["k"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == md5_order(range(5000))
    assert sorted(got.values()) == list(range(5000))


@pytest.mark.parametrize("values", [[], ["b"], ["ä", "a", "Z", "", "zz", "z"], [f"x{i}" for i in range(6000)]])
def test_sorted_index_is_code_point_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = I.sorted_index(df, "t").orderBy("id").collect()
    assert [r["t"] for r in got] == sorted(values)
    assert [r["id"] for r in got] == list(range(len(values)))


def test_sorted_index_of_numbers(spark):
    got = I.sorted_index(spark.range(3000).withColumn("id", F.col("id") * 3), "id", "pos").collect()
    assert all(r["pos"] * 3 == r["id"] for r in got)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_beyond_the_bound_gives_the_same_rows(spark, how):
    left = spark.range(600).select((F.col("id") % 7).alias("k"), "id").union(spark.range(300).select(F.lit(3).alias("k"), F.col("id") + 1000))
    right = spark.range(2, 6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = sorted(map(tuple, I.lookup_join(left, right, "k", how).collect()), key=str)
    large = sorted(map(tuple, I.lookup_join(left, right, "k", how, max_rows=1).collect()), key=str)
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    assert small == large == plain


def test_only_hot_keys_are_spread_and_only_their_right_rows_repeated(spark):
    left = spark.range(4000).select((F.col("id") % 500).cast("int").alias("k"), "id").union(
        spark.range(6000).select(F.lit(3).alias("k"), F.col("id") + 10_000)).union(spark.range(2000).select(F.lit(None).cast("int"), -F.col("id") - 1))
    right = spark.range(600).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    hot = {r["_code"]: r["_salts"] for r in I.hot_keys(left, ["k"], 20).collect()}
    code = {r["k"]: r["c"] for r in spark.range(1).select(F.explode(F.array(F.lit(3), F.lit(4), F.lit(None))).alias("k")).select("k", F.xxhash64("k").alias("c")).collect()}
    assert set(hot) == {code[3], code[None]} and hot[code[3]] == 11 and hot[code[None]] == 4
    joined = I.spread_join(left, right, ["k"], "left", 20)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    cold = I.hot_keys(spark.range(5000).select((F.col("id") % 1000).alias("k")), ["k"], 20)
    assert cold.count() == 0


def test_a_lookup_is_computed_once_and_measured_on_the_way(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x * 2

    right = spark.range(50).select("id", counted("id").alias("v"))
    got = I.lookup_join(spark.range(100), right, "id", "inner")
    assert got.count() == 50 and len(got.collect()) == 50 and calls.value == 50
    held = measured(right.select("id", F.lit("abc").alias("t")), "test")
    assert (held.rows, held.size) == (50, 50 * 11)
    assert (measured(right.filter("id < 0"), "test").rows, measured(right.filter("id < 0"), "test").size) == (0, 0)


def test_running_min_over_blocks(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 1000) for _ in range(100)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 5)], "g string, o long, v int")
    got = {(r["g"], r["o"]): r["m"] for r in I.running_min(df, ["g"], "o", F.col("v"), "m", block=8).collect()}
    assert all(got[("a", i)] == min(values[:i + 1]) for i in range(100)) and got[("b", 0)] == 5


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    top = I.top_per_group(df, ["g"], [F.desc("id")], 2)
    assert sorted((r["g"], r["id"]) for r in top.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_early_stop_and_best_epoch(spark):
    falling = [(1, e, float(100 - e)) for e in range(1, 47)] + [(1, e, 60.0) for e in range(47, 80)]
    ties = [(2, e, 5.0) for e in range(1, 30)]
    short = [(3, e, 1.0) for e in range(1, 5)]
    history = spark.createDataFrame(falling + ties + short, "run int, epoch long, value double")
    stops = {r["run"]: (r["stop_epoch"], r["best_epoch"]) for r in S.early_stop(history, "run", "epoch", "value").collect()}
    assert stops == {1: (56, 46), 2: (11, 1), 3: (None, None)}
    best = {r["run"]: (r["best_epoch"], r["best_value"]) for r in S.best_epoch(history, "run", "epoch", "value").collect()}
    assert best == {1: (46, 54.0), 2: (1, 5.0), 3: (1, 1.0)}
    most = {r["run"]: r["best_epoch"] for r in S.best_epoch(history, "run", "epoch", "value", maximize=True).collect()}
    assert most == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("n, size", [(0, -1), (1, -1), (10, -1), (97, -1), (97, 30), (5, 30)])
def test_split_sizes(spark, n, size):
    rows = S.random_split(spark.range(n).select(F.col("id").alias("k")), "k", size=size).collect()
    total = n if size == -1 else min(n, size)
    count = {s: sum(r["split"] == s for r in rows) for s in ("train", "eval", "test")}
    assert count == {"train": int(total * 0.7), "eval": int(total * 0.2), "test": total - int(total * 0.7) - int(total * 0.2)}
    assert len({r["k"] for r in rows}) == total


def test_split_shares_are_checked(spark):
    with pytest.raises(ValueError):
        S.random_split(spark.range(3), "id", 0.8, 0.2)


def test_subsets_nest(spark):
    rows = S.nested_subsets(spark.range(50), "id", [10, 20, 400]).collect()
    members = {s: {r["id"] for r in rows if r["size"] == s} for s in (10, 20, 400)}
    assert len(members[10]) == 10 and members[10] < members[20] < members[400] and len(members[400]) == 50


def test_holdout_rounds_up(spark):
    rows = S.holdout_split(spark.range(11), "id").collect()
    assert sum(r["split"] == "test" for r in rows) == 2


def test_requested_cities(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",), (" ",)], "city string")
    asked = spark.createDataFrame([("A",), ("C",)], "city string")
    assert {tuple(r) for r in S.check_cities(asked, df, "city").collect()} == {("A", 2, True), ("C", 0, False)}


def test_negative_partner_is_another_row(spark):
    rows = E.negative_pairs(spark.range(40).select("id", F.col("id").cast("string").alias("t")), "id", "t").collect()
    assert len(rows) == 40 and all(r["id"] != r["partner_id"] and r["class_0"] != r["class_1"] for r in rows)
    two = E.negative_pairs(spark.range(2).select("id", F.col("id").cast("string").alias("t")), "id", "t").collect()
    assert {(r["id"], r["partner_id"]) for r in two} == {(0, 1), (1, 0)}
    assert E.negative_pairs(spark.range(1).select("id", F.lit("x").alias("t")), "id", "t").count() == 0


def test_true_names(spark):
    records = spark.createDataFrame([("Bad-Ort-DE1",), ("X-DE9",)], "city string")
    cities = spark.createDataFrame([("DE1", " Bad Ort ")], "Identifier string, `True Name` string")
    kept = E.with_true_names(records, cities, on_missing="keep").collect()
    assert sorted(r["city"] for r in kept) == ["Bad Ort", "X-DE9"]
    with pytest.raises(PySparkException):
        E.with_true_names(records, cities).collect()


def test_backfill_only_touches_rows_with_a_gap(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", "c"), (3, None, "d"), (4, None, None)], "k int, s string, l string")
    crawled = spark.createDataFrame([(1, "A", "L"), (2, "B", "C"), (3, None, "D")], "k int, s string, l string")
    got = {r["k"]: (r["s"], r["l"]) for r in E.backfill(stored, crawled, "k", ["s", "l"]).collect()}
    assert got == {1: ("A", "L"), 2: ("b", "c"), 3: (None, "D"), 4: (None, None)}


def test_last_response_wins(spark):
    records = spark.createDataFrame([("1",), ("2",)], "id string")
    responses = spark.createDataFrame([("1", 0, "old"), ("1", 5, "new"), ("3", 1, "other")], "id string, n int, t string")
    got = {r["id"]: r["out"] for r in E.merge_responses(records, responses, "id", [F.col("n")], "t", "out").collect()}
    assert got == {"1": "new", "2": None}


def test_expensive_function_runs_once_per_text(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(30)] + [(99, None), (98, "")], "i int, t string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(t):
        calls.add(1)
        return None if t == "t3" else t.upper()

    got = {r["i"]: r["o"] for r in E.enrich_distinct(df, "t", slow, "o").collect()}
    assert got[1] == "HOT" and got[3] == "t3" and got[6] == "T6" and got[99] is None and got[98] == ""
    assert len(got) == 32


@pytest.mark.parametrize("report, series, expected", [
    ("Werte 3 bis 5°C.", ["3", "5"], True), ("Werte 3 bis 6°C.", ["3", "5"], False), ("Um -4.", ["-4"], True),
    ("ohne Zahl", [], True), ("nan bleibt", ["NaN"], False), ("1d ist keine", ["2"], True), ("1_0 schon", ["10"], False)])
def test_temperatures_agree(one, report, series, expected):
    assert one(G.temperatures_agree("r", "s"), "r string, s array<string>", (report, series)) is expected


def test_gates_survive_empty_series(spark):
    df = spark.createDataFrame([([], "x"), (None, "x"), (["00 - 01 Uhr"], None), (["00 - 01 Uhr"], "x")], "times array<string>, report_short string")
    assert [r[0] for r in df.select(G.starts_at_midnight()).collect()] == [False, False, False, True]


def test_due_cities_cap(spark):
    cities = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("d"))
    assert [r["k"] for r in G.due_cities(cities, 23, "d", "k", cap=7).collect()] == md5_order(range(1, 100, 2))[:7]
    assert G.due_cities(cities, 0, "d", "k").count() == 50


def test_entities_longest_first_and_tags_kept(spark):
    names = spark.createDataFrame([("Bad",), ("Bad Ems",), ("St. Pölten",), ("city",), ("Ems Nord",)], "name string")
    df = spark.createDataFrame([
        (1, "Von Bad Ems Nord nach St. Pölten, <city> Badstadt Bad."), (2, "Bad zu kurz"), (3, None), (4, "ohne jeden Namen im ganzen Text")], "k int, t string")
    got = {r["k"]: r["t"] for r in N.mask_entities(df, "k", "t", names).collect()}
    assert got == {1: "Von <ne> Nord nach <ne>, <city> Badstadt <ne>.", 2: "Bad zu kurz", 3: None, 4: "ohne jeden Namen im ganzen Text"}
    counts = {r["name"]: r["n"] for r in N.entity_counts(df, "k", "t", names).collect()}
    assert counts == {"Bad Ems": 1, "St. Pölten": 1, "Bad": 2}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 9, 10)], "v double")
    assert [r["n"] for r in P.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 2]
    flat = P.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 0, 2, 0] and flat[0]["left"] == 2.5


def test_offset_names(spark):
    df = spark.createDataFrame([(5.5,), (-3.0,), (0.0,)], "o double")
    assert [r[0] for r in df.select(P.offset_bucket(F.col("o"))).collect()] == ["UTC_plus_5_5", "UTC_minus_3_0", "UTC_plus_0_0"]


def test_due_cities_without_cap_are_all(spark):
    cities = spark.range(12_000).selectExpr("id AS k", "1 AS d")
    assert G.due_cities(cities, 23, "d", "k").count() == 12_000


def test_older_speed_key_is_loadable(spark):
    rows = spark.createDataFrame([("Ulm",)], "city string")
    for name in G.PROFILE_KEYS["standard"]:
        if name != "city":
            rows = rows.withColumn(name, F.lit("x"))
    assert not rows.select(G.loadable(rows, "standard")).first()[0]
    for speed in G.SPEED_KEYS:
        with_speed = rows.withColumn(speed, F.lit("x"))
        assert with_speed.select(G.loadable(with_speed, "standard")).first()[0]


def test_last_true_name_wins(spark):
    from almanac.operators import enrich

    records = spark.createDataFrame([("x-7",)], "city string")
    cities = spark.createDataFrame([("7", " Ulm ", 2), ("7", "Aalen", 1)], "Identifier string, `True Name` string, line int")
    assert [r["city"] for r in enrich.with_true_names(records, cities, order="line").collect()] == ["Ulm"]


def test_costly_function_runs_once_per_text(spark):
    from almanac.operators import enrich

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(t):
        calls.add(1)
        return t.upper()

    rows = spark.createDataFrame([(i, f"text {i % 10}") for i in range(40)], "k int, t string")
    assert enrich.enrich_distinct(rows, "t", costly, "up").filter("up = upper(t)").count() == 40
    assert calls.value == 10


def test_many_wind_directions_become_features(spark):
    from almanac.operators import features

    names = [f"W{i:05}" for i in range(5000)]
    vocabulary = spark.createDataFrame([(names,)], "windrichtung array<string>")
    assert vocabulary.select(F.size(features.wind_vocabulary(vocabulary))).first()[0] == 5000


def test_names_that_begin_with_a_sign_are_masked(spark):
    from almanac.operators import entities

    rows = spark.createDataFrame([(1, "Regen in 's-Hertogenbosch und in Ulm am <city> heute")], "k int, t string")
    places = spark.createDataFrame([("'s-Hertogenbosch",), ("Ulm",)], "name string")
    assert entities.mask_entities(rows, "k", "t", places).first()["t"] == "Regen in <ne> und in <ne> am <city> heute"
