"""Padded batches and sliding windows over token sequences."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import col
from almanac.operators.index import hash_index

MAX_BATCH = 512
SCORE_BLOCK = 20


def padded(ids: str | Column, length: Column, pad: int) -> Column:
    ids = col(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(length - F.size(ids), F.lit(0))))


def pad_batches(df: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """Pad every sequence to the longest of its batch; add ``attention_mask`` and ``length``. Batches are small by rule."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    sized = df.withColumns({"_longest": longest, "length": F.size(ids)})
    mask = F.transform(F.sequence(F.lit(1), F.greatest("_longest", F.lit(1))), lambda i: F.when(i <= F.col("length"), 1).otherwise(0))
    return sized.withColumns({
        ids: padded(ids, F.col("_longest"), pad), "attention_mask": F.slice(mask, 1, F.col("_longest")),
    }).drop("_longest")


def _starts(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def next_token_windows(df: DataFrame, ids: str, block: int) -> DataFrame:
    """One row per start j in 0..L-block-1: ``inputs`` of length block and ``labels`` one step further.

    The last full block has no label and is left out; other columns, such as the context, are repeated.
    """
    kept = [c for c in df.columns if c != ids]
    starts = df.select(*kept, ids, F.explode(_starts(F.size(ids) - block)).alias("start"))
    return starts.select(
        *kept, "start", F.slice(ids, F.col("start") + 1, block).alias("inputs"), F.slice(ids, F.col("start") + 2, block).alias("labels"))


def class_windows(df: DataFrame, negative: str, positive: str, block: int, pad: int) -> DataFrame:
    """Windows of class-0 and class-1 sequences with their label; windows of nothing but padding are dropped."""
    kept = [c for c in df.columns if c not in (negative, positive)]

    def of(ids: str, label: int) -> DataFrame:
        starts = df.select(*kept, ids, F.explode(_starts(F.size(ids) - block)).alias("start"))
        return starts.select(*kept, "start", F.lit(label).alias("label"), F.slice(ids, F.col("start") + 1, block).alias("inputs"))

    both = of(negative, 0).unionByName(of(positive, 1))
    return both.filter(F.exists("inputs", lambda t: t != pad))


def random_batches(df: DataFrame, key: list[str], seed: int = 42, max_batch: int = MAX_BATCH) -> DataFrame:
    """Add ``idx`` (exact random position) and ``batch``: n div 512 + 1 batches of equal size, the last takes the rest."""
    placed = hash_index(df, key, seed, total="_n")
    batches = F.floor(F.col("_n") / max_batch) + 1
    size = F.floor(F.col("_n") / batches)
    return placed.withColumn("batch", F.least(F.floor(F.col("idx") / size), batches - 1)).drop("_n")


def score_windows(df: DataFrame, ids: str, block: int = SCORE_BLOCK) -> DataFrame:
    """Every block of neighbouring ids, the last one included; a shorter sequence is one window."""
    kept = [c for c in df.columns if c != ids]
    starts = df.select(*kept, ids, F.explode(_starts(F.greatest(F.size(ids) - block + 1, F.lit(1)))).alias("start"))
    return starts.select(*kept, "start", F.slice(ids, F.col("start") + 1, block).alias("window"))
