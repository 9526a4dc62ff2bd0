"""Lookups, merges and pairings between record sets."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators.index import hash_index, hash_key, lookup_join, sorted_index, top_per_group
from almanac.storage import measured, written


def with_true_names(
    records: DataFrame, cities: DataFrame, identifier: str = "Identifier", true_name: str = "True Name",
    on_missing: str = "error", order: str | None = None,
) -> DataFrame:
    """Replace the city by the stripped true name of its identifier (the part after the last dash). Of a repeated identifier the
    row that is last by ``order`` counts, or without an order the one whose name is last."""
    last = F.col(f"`{order or true_name}`")
    names = cities.groupBy(F.col(identifier).alias("_id")).agg(F.max_by(text.strip(F.col(f"`{true_name}`")), last).alias("_true"))
    joined = lookup_join(records.withColumn("_id", F.substring_index("city", "-", -1)), names, "_id")
    if on_missing == "error":
        missing = F.raise_error(F.concat(F.lit("no city with identifier "), F.col("_id"))).cast("string")
    else:
        missing = F.col("city")
    return joined.withColumn("city", F.coalesce("_true", missing)).drop("_id", "_true")


def with_columns_of(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Left join that adds some columns of a table unique on the key."""
    return lookup_join(left, right.select(on, *columns), on)


def without(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed: skip what exists, remove what is on a stop list."""
    return df.join(listed.select(*on).distinct(), list(on), "left_anti")


def removal_counts(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    flags = listed.select(*on).distinct().withColumn("_listed", F.lit(True))
    # Counted per key before the join, so a key with a large share of the rows is one row.
    joined = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(flags, list(on), "left")
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum(F.when(F.col("_listed").isNull(), F.col("_n"))), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum(F.when(F.col("_listed"), F.col("_n"))), F.lit(0)).alias("n_removed"),
    )


def backfill(stored: DataFrame, crawled: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """Fill texts from a second crawl. Only rows with a NULL among ``fields`` take part; there a new text wins."""
    new = crawled.select(on, *[F.col(f).alias(f"_new_{f}") for f in fields])
    gap = F.lit(False)
    for f in fields:
        gap = gap | F.col(f).isNull()
    joined = stored.withColumn("_gap", gap).join(new, on, "left")
    filled = {f: F.when(F.col("_gap"), F.coalesce(f"_new_{f}", f)).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(filled).select(*stored.columns)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in ``order``."""
    return top_per_group(df, key, [c.desc() for c in order], 1, "_rank").drop("_rank")


def merge_responses(records: DataFrame, responses: DataFrame, key: str, order: Sequence[Column], text_col: str,
                    target: str) -> DataFrame:
    """Add the text of the last response to each record."""
    last = latest_per_key(responses, [key], order).select(key, F.col(text_col).alias(target))
    return records.join(last, key, "left")


def transfer_text(records: DataFrame, source: DataFrame, base: str, source_text: str, target: str) -> DataFrame:
    """Copy a text by base file name, put the city back in, and flag records whose source lacks it."""
    copied = records.join(source.select(base, F.col(source_text).alias("_text")), base, "left")
    return copied.withColumn(target, text.unmask_city("_text", "city")).withColumn(
        "missing", F.col("_text").isNull()).drop("_text")


def negative_pairs(df: DataFrame, key: str, payload: str, seed: int = 42) -> DataFrame:
    """Each row with its own payload (class 1) and that of a uniformly drawn other row (class 0).

    Rows get an exact random position; the partner is a seeded step of 1..n-1 further on, so it is never the row itself.
    Positions are worked out and written for the keys alone, so the texts are shuffled only to meet their pair.
    """
    placed = written(hash_index(df.select(key), [key], seed, "idx", "_n"), "positions")
    draw = F.conv(F.substring(hash_key(f"{seed}-pair", key), 1, 8), 16, 10).cast("bigint")
    step = draw % F.greatest(F.col("_n") - 1, F.lit(1)) + 1
    steps = placed.filter("_n > 1").select(key, "idx", ((F.col("idx") + step) % F.col("_n")).alias("partner"))
    pairs = steps.join(placed.select(F.col("idx").alias("partner"), F.col(key).alias(f"partner_{key}")), "partner")
    own = df.select(key, F.col(payload).alias("class_1"))
    other = df.select(F.col(key).alias(f"partner_{key}"), F.col(payload).alias("class_0"))
    return pairs.join(own, key).join(other, f"partner_{key}")


def enrich_distinct(df: DataFrame, key: str, function: Callable[[Column], Column], name: str) -> DataFrame:
    """Apply an expensive column function once per distinct text; a NULL result falls back to the text itself.

    ``function`` is the plug-in, usually a ``pandas_udf``. Rows come back through a lookup, so a text that fills a third
    of the table is still computed once and its rows stay spread out.
    """
    unique = df.select(key).filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    done = unique.select(key, F.coalesce(function(F.col(key)), F.col(key)).alias(name))
    return lookup_join(df, measured(done, "distinct"), key).withColumn(name, F.coalesce(name, key))


def union_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for part in splits[1:]:
        out = out.unionByName(part)
    return out


def file_index(files: DataFrame, path: str, city: str) -> DataFrame:
    """(id, city, file, position): position in the listing, the last file of an identifier wins."""
    named = files.select(F.element_at(F.split(path, "/"), -1).alias("file"), F.col(city).alias("city"), F.col(path).alias("_path"))
    placed = sorted_index(named, "_path", "position")
    # One row per identifier survives a partial aggregate, so an identifier with many files is no hot group.
    last = placed.groupBy(text.file_identifier("file").alias("id")).agg(
        F.max_by(F.struct("city", "file", "position"), "position").alias("last"))
    return last.select("id", "last.city", "last.file", "last.position")
