"""Operator 9: shards by vector bin packing over bytes, tokens and rows.

Groups of equal texts are summed before they travel. A group that holds more than one ``PARTS``-th of a shard in any dimension is
cut into that many parts by a hash of the document; all other groups fall by hash into ``BUNDLES`` bundles per shard. So there
are at most shards * (BUNDLES + 6 * PARTS) items at any input size; the driver places them, largest first, each
where the dot product of its vector with the residual capacity is highest. Within a shard the items lie one after
another, which makes the slots gapless without counting a shard as a whole.

Defined results: a null text has no bytes, no tokens and the checksum of the empty text, and is a copy of an empty one; rows without
id are kept; repeated rows take a slot each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read, word_count
from almanac.storage import written

SHARDS = 24
BUNDLES = 1024
PARTS = 64
OVERHEAD = 8
LOADS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item (one row per item, one column per dimension)."""
    share = items / np.maximum(items.sum(axis=0), 1) * shards
    room = np.ones((shards, items.shape[1]))
    shard = np.empty(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        shard[i] = best = int((room @ share[i]).argmax())
        room[best] -= share[i]
    return shard


def _loads(rows: DataFrame, *by: str | Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc, size, tokens, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("doc"), F.unhex(F.md5(text.cast("binary"))).alias("copy"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), word_count(text).alias("tokens")), "shard-rows")
    total = _loads(rows).first()
    groups = _loads(rows, "copy")
    part = F.greatest(*[F.col(c) / F.lit(max(1, total[c] or 0)) for c in LOADS]) * F.lit(shards * PARTS)
    # Each of these groups holds more than 1 / (shards * PARTS) of one of three totals, so there are at most 3 * shards * PARTS.
    heavy = groups.select("copy", F.ceil(part).alias("parts")).filter("parts > 1")
    dealt = rows.join(F.broadcast(heavy), "copy", "left")
    cut = F.concat_ws("-", F.lit("part"), F.hex("copy"), F.pmod(F.xxhash64("doc"), F.col("parts")).cast("string"))
    bundle = F.concat_ws("-", F.lit("bundle"), F.pmod(F.xxhash64("copy"), F.lit(shards * BUNDLES)).cast("string"))
    dealt = dealt.withColumn("item", F.when(F.col("parts").isNull(), bundle).otherwise(cut)).drop("copy", "parts")
    items = _loads(dealt, "item").orderBy("item").collect()  # bounded, see above
    where = place(np.array([[r[c] for c in LOADS] for r in items], np.float64).reshape(-1, len(LOADS)), shards)
    filled, table = [0] * shards, []
    for r, at in zip(items, where.tolist()):
        table.append((r["item"], at, filled[at]))
        filled[at] += r["rows"]
    spots = spark.createDataFrame(table, "item string, shard int, first long")
    inside = F.row_number().over(Window.partitionBy("item").orderBy("doc", "size", "text_crc32"))
    placed = dealt.withColumn("inside", inside).join(F.broadcast(spots), "item")
    return placed.select("doc", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).alias("slot"))


@BOOK.add("op9_shards")
def op9_shards(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")
