import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanac.operators import training as R
from almanac.operators import vocabulary as V


def test_encode_then_decode_words(spark):
    df = spark.createDataFrame([(1, "Es regnet, viel."), (2, "Es stürmt viel."), (3, "")], "k int, t string")
    vocab = V.vocabulary(V.word_tokens(df.filter("k = 1"), "t"), V.WORD_SPECIALS + [t for _, t in V.EXTRA_TOKENS])
    names = {r["id"]: r["token"] for r in vocab.collect()}
    assert [names[i] for i in range(len(names))] == sorted(names.values())
    ids = V.encode_words(df, "k", "t", vocab)
    rows = {r["k"]: [names[i] for i in r["ids"]] for r in ids.collect()}
    assert rows == {1: ["Es", "regnet", "<comma>", "viel", "<point>"], 2: ["Es", "<unknown>", "viel", "<point>"], 3: []}
    back = {r["k"]: r["text"] for r in V.decode(ids, "k", "ids", vocab).collect()}
    assert back == {1: "Es regnet, viel.", 2: "Es <unknown> viel.", 3: ""}


def test_encoding_needs_one_shuffle(spark):
    df = spark.createDataFrame([(1, "a;b")], "k int, c string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("<unknown>", 2)], "token string, id long")
    plan = V.encode_context(df, "k", "c", vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan


def test_context_parts_keep_empty_ones(spark):
    df = spark.createDataFrame([(1, "a;;b"), (2, "")], "k int, c string")
    assert {r["token"] for r in V.context_tokens(df, "c").collect()} == {"a", "", "b"}


def test_strict_and_lenient_remap(spark):
    df = spark.createDataFrame([(1, [5, 7, 5]), (2, [])], "k int, ids array<int>")
    mapping = V.subset_mapping(V.id_set(df, "ids"), [3])
    assert {(r["old"], r["new"]) for r in mapping.collect()} == {(3, 0), (5, 1), (7, 2)}
    assert {r["k"]: r["ids"] for r in V.remap(df, "k", "ids", mapping).collect()} == {1: [1, 2, 1], 2: []}
    more = spark.createDataFrame([(1, [5, 8])], "k int, ids array<int>")
    assert V.remap(more, "k", "ids", mapping, on_missing=0).first()["ids"] == [1, 0]
    with pytest.raises(PySparkException):
        V.remap(more, "k", "ids", mapping).collect()


def test_reduced_vocabulary_is_in_id_order(spark):
    df = spark.createDataFrame([(1, [9, 2, 9])], "k int, ids array<int>")
    got = [(r["old"], r["new"], r["n"]) for r in V.reduced_vocabulary(df, "ids", [0, 2]).orderBy("new").collect()]
    assert got == [(0, 0, 1), (2, 1, 1), (9, 2, 2)]


def test_trim_and_filter(one):
    ids = F.array(*[F.lit(i) for i in (1, 5, 1, 2)])
    assert one(V.trimmed(ids, 1, 2)) == [5, 1]
    assert one(V.trimmed(F.array().cast("array<int>"), 1, 2)) == []
    assert one(V.without_ids(ids, [1])) == [5, 2]
    assert one(V.wrapped_ids(ids, 8, 9)) == [8, 1, 5, 1, 2, 9]
    assert one(V.wrapped(F.lit("x"))) == "<start> x <stop>" and one(V.wrapped(F.lit("x"), False)) == "<start>x<stop>"


def test_windows(spark):
    df = spark.createDataFrame([("a", list(range(6))), ("b", [1, 2, 3])], "k string, ids array<int>")
    rows = [(r["k"], r["inputs"], r["labels"]) for r in R.next_token_windows(df, "ids", 4).orderBy("k", "start").collect()]
    assert rows == [("a", [0, 1, 2, 3], [1, 2, 3, 4]), ("a", [1, 2, 3, 4], [2, 3, 4, 5])]
    scored = [(r["k"], r["window"]) for r in R.score_windows(df, "ids", 4).orderBy("k", "start").collect()]
    assert scored == [("a", [0, 1, 2, 3]), ("a", [1, 2, 3, 4]), ("a", [2, 3, 4, 5]), ("b", [1, 2, 3])]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5]), (2, [])], "b int, ids array<bigint>")
    got = sorted((r["b"], r["ids"], r["attention_mask"], r["length"]) for r in R.pad_batches(df, "b", "ids", 9).collect())
    assert got == [(0, [1, 2, 3], [1, 1, 1], 3), (0, [4, 9, 9], [1, 0, 0], 1), (1, [5], [1], 1), (2, [], [], 0)]


def test_class_windows_drop_pure_padding(spark):
    df = spark.createDataFrame([([1, 0, 0, 0], [0, 0, 0, 0])], "n array<int>, p array<int>")
    assert [(r["label"], r["inputs"]) for r in R.class_windows(df, "n", "p", 2, 0).collect()] == [(0, [1, 0])]


@pytest.mark.parametrize("n", [1, 511, 512, 1300])
def test_batch_sizes(spark, n):
    rows = R.random_batches(spark.range(n).select(F.col("id").alias("k")), ["k"]).groupBy("batch").count().collect()
    batches, size = n // 512 + 1, n // (n // 512 + 1)
    assert sorted(r["count"] for r in rows) == sorted([size] * (batches - 1) + [n - size * (batches - 1)])


def test_texts_under_one_key_keep_their_own_ids(spark):
    vocab = V.vocabulary(spark.createDataFrame([("a",), ("b",), ("c",)], "token string"), ["<unknown>"])
    assert "Window" not in vocab._jdf.queryExecution().toString() and "FileScan" in vocab._jdf.queryExecution().toString()
    rows = [(1, "a;b"), (1, "c;a"), (1, "c;a"), (2, "b"), (2, None), (None, "c;x")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = sorted(((r["k"] or 0, r["ids"]) for r in V.encode_context(df, "k", "t", vocab).collect()), key=str)
    assert got == sorted([(1, [1, 2]), (1, [3, 1]), (1, [3, 1]), (2, [2]), (2, []), (0, [3, 0])], key=str)


def test_small_tables_are_looked_up_where_the_arrays_lie(spark):
    mapping = spark.createDataFrame([(5, 0), (7, 1)], "old bigint, new bigint")
    df = spark.createDataFrame([(1, [7, 5, 7]), (1, [7, 5, 7]), (2, []), (3, None), (4, [9, None, 5])], "k int, ids array<bigint>")
    found = V.remap(df, "k", "ids", mapping, on_missing=8)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["ids"]) for r in found.collect()) == [(1, [1, 0, 1]), (1, [1, 0, 1]), (2, []), (3, []), (4, [8, 8, 0])]
