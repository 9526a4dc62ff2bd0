"""Operator 8: mix sources to target weights, with DataFrame functions only.

Every document gets a pseudo-random key (md5 of seed and id). Within its source the documents are sorted by that key in
ranges (the first three hex digits of the key), each range is summed on its own, and the sums of the ranges before it are
added: a distributed prefix sum in which no task sees more than one 4096th of a source. A source's budget is cut at the exact
word: as many whole epochs as fit, then the head of the order, the last document in part.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows without id are kept and
all have the same key; an empty table gives an empty result; sources of size 0 have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read, word_count
from almanac.storage import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """(src, source_size, target) from (src, size): ``share`` of all words, by weight, no source above ``limit`` times its
    size, the excess reshared by weight.

    The sources are the rows of a catalogue, one per source. In the order of limit per weight, the level (words per unit of
    weight) rises while sources are full and falls behind the first that is not; so its maximum is the level of the rest.
    """
    named = Window.orderBy("src")
    by_fill = Window.orderBy("fill", "src")
    before, onwards, everything = (by_fill.rowsBetween(*b) for b in (
        (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    choice = F.array(*[F.lit(w) for w in weights])
    sources = (
        sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(choice, F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))))
        .withColumn("most", F.col("source_size") * limit)
        .withColumn("fill", F.col("most").cast("double") / F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
                    / F.sum("weight").over(onwards))
        .withColumn("level", F.max("level").over(everything)))
    return sources.select(
        "src", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED,
) -> DataFrame:
    """(doc, size, source_size, target, taken) of every row: how many words of it the mix takes, repeats counted."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    # "v" before a named source and "~" for the null one keep code point order with the null source last.
    src = F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("~"))
    rows = written(docs.select(
        F.col(id_col).alias("doc"), src.alias("src"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("src", "range").agg(F.sum("size").alias("words"))
        .withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .join(source_targets(rows, weights, share, limit), "src")
        .withColumn("budget", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .select("src", "range", "ahead", "source_size", "target", "epochs", "rest"))
    inside = Window.partitionBy("src", "range").orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["src", "range"])
        .withColumn("head", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("inside")))))
    return placed.select(
        "doc", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("head")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows: a document taken in whole epochs is repeated, one cut at the budget appears once more, whole, and one
    of which nothing is taken goes; a document without words goes. Columns as in ``docs``."""
    share = mix(docs, id_col, text_col, source_col, **options).filter("taken > 0").groupBy("doc").agg(
        F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    columns = [f"`{c}`" for c in docs.columns]
    plain = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"))
    taken = plain.join(share, F.col("id").eqNullSafe(F.col("doc")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


@BOOK.add("op8_mix_sources", rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('{SEED}|' || doc_id) AS key FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
filled AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (
      ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named),
aimed AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (max(level) OVER ()) * weight)::DOUBLE AS target FROM filled),
cut AS (
  SELECT s.*, source_size, target, floor(target)::BIGINT // greatest(source_size, 1) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken FROM cut""")
def op8_mix_sources(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")
