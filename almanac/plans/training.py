"""Training rows (I12-I16)."""

from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import training as R
from almanac.operators.index import hash_index
from almanac.plans import Book, table

BOOK = Book()
PAD, BLOCK = 0, 20
# Turns of the conversations as texts, word lengths as token ids.
SEQ = r"""
WITH seq AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key, role,
  list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CAST(len(w) AS BIGINT)) AS ids FROM conversations),
placed AS (SELECT *, (row_number() OVER (ORDER BY md5('42|' || key), key) - 1) // 32 AS batch FROM seq),
padded AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM placed),
p AS (SELECT key, conv_id, turn, role, batch, len(ids) AS n, m, list_concat(ids, list_transform(range(len(ids), m), lambda x: CAST(0 AS BIGINT))) AS ids FROM padded)
"""


def sequences(spark, sf):
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    ids = F.transform(T.words("text"), lambda w: F.length(w).cast("bigint"))
    return table(spark, sf, "conversations").select(key.alias("key"), "role", ids.alias("ids"))


def batches(spark, sf):
    placed = hash_index(sequences(spark, sf), ["key"]).withColumn("batch", F.floor(F.col("idx") / 32)).drop("idx")
    return R.pad_batches(placed, "batch", "ids", PAD)


def _text(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@BOOK.add("I12_pad_batches", SEQ + """
SELECT key, batch, array_to_string(ids, ',') AS ids, CAST(n AS BIGINT) AS length,
  array_to_string(list_transform(range(1, m + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END), ',') AS attention_mask FROM p""")
def i12(spark, sf):
    return batches(spark, sf).select("key", "batch", _text("ids"), F.col("length").cast("bigint").alias("length"), _text("attention_mask"))


_WINDOWS = SEQ + """,
w AS (SELECT key, ids, unnest(range(0, len(ids) - 20)) AS start FROM p),
win AS (SELECT key, start, array_to_string(ids[start + 1:start + 20], ',') AS inputs, array_to_string(ids[start + 2:start + 21], ',') AS labels FROM w)
"""


@BOOK.add("I13_next_token_windows", _WINDOWS + "SELECT * FROM win")
def i13(spark, sf):
    rows = R.next_token_windows(batches(spark, sf).select("key", "ids"), "ids", BLOCK)
    return rows.select("key", F.col("start").cast("bigint").alias("start"), _text("inputs"), _text("labels"))


@BOOK.add("I14_random_batches", _WINDOWS + """,
o AS (SELECT key, start, row_number() OVER (ORDER BY md5('42|' || key || '|' || CAST(start AS VARCHAR)), key, start) - 1 AS idx, count(*) OVER () AS n FROM win)
SELECT key, start, idx, least(idx // (n // (n // 512 + 1)), n // 512) AS batch FROM o""")
def i14(spark, sf):
    rows = R.next_token_windows(batches(spark, sf).select("key", "ids"), "ids", BLOCK)
    rows = rows.select("key", F.col("start").cast("bigint").alias("start"))
    return R.random_batches(rows, ["key", "start"])


@BOOK.add("I15_class_windows", SEQ + """,
pair AS (SELECT a.key, a.ids AS class_0, b.ids AS class_1 FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
w AS (SELECT key, 0 AS label, class_0 AS ids, unnest(range(0, len(class_0) - 20)) AS start FROM pair
      UNION ALL SELECT key, 1, class_1, unnest(range(0, len(class_1) - 20)) FROM pair)
SELECT key, start, CAST(label AS BIGINT) AS label, array_to_string(ids[start + 1:start + 20], ',') AS inputs FROM w
WHERE len(list_filter(ids[start + 1:start + 20], lambda t: t <> 0)) > 0""")
def i15(spark, sf):
    rows = batches(spark, sf).select("key", "ids").withColumns({
        "conv": F.split("key", "-")[0], "turn": F.split("key", "-")[1].cast("bigint")})
    before = rows.select("conv", (F.col("turn") + 1).alias("turn"), F.col("ids").alias("class_1"))
    pairs = rows.withColumnRenamed("ids", "class_0").join(before, ["conv", "turn"]).select("key", "class_0", "class_1")
    windows = R.class_windows(pairs, "class_0", "class_1", BLOCK, PAD)
    return windows.select("key", F.col("start").cast("bigint").alias("start"), F.col("label").cast("bigint").alias("label"), _text("inputs"))


@BOOK.add("I16_score_windows", SEQ + """,
w AS (SELECT key, ids, unnest(range(0, greatest(len(ids) - 19, 1))) AS start FROM seq)
SELECT key, start, array_to_string(ids[start + 1:start + 20], ',') AS "window" FROM w""")
def i16(spark, sf):
    rows = R.score_windows(sequences(spark, sf).select("key", "ids"), "ids")
    return rows.select("key", F.col("start").cast("bigint").alias("start"), _text("window"))
