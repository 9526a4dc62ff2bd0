"""Exact global positions, size-checked lookups and long running windows without a single-task step."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.storage import Lookup, measured, written

HEX_DIGITS = 3
RANGE_SAMPLE = 4096
LEAST_RANGES = 64
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Bytes of the right side of a shuffle join that a partition may hold as a hash table, on average.
HASHED_BYTES = 4 << 20
SEP = "\x01"


def hash_key(seed: int | str, *cols: str) -> Column:
    """Seeded md5 of the columns: the one source of pseudo-random order (the same text in every engine)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _with_offsets(bucketed: DataFrame, bucket: str, order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    # The offsets table has one row per bucket, and the number of buckets is a constant, so it may be broadcast.
    ahead = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    columns = [bucket, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset")]
    if total:
        whole = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        columns.append(F.sum("_n").over(whole).alias(total))
    offsets = bucketed.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).select(*columns)
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return (
        bucketed.withColumn("_rn", inside)
        .join(F.broadcast(offsets), bucket)
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop(bucket, "_rn", "_offset")
    )


def hash_index(
    df: DataFrame, key: Sequence[str], seed: int | str = 42, name: str = "idx", total: str | None = None
) -> DataFrame:
    """0-based position of every row in the order of md5(seed, key), and on request the number of rows as ``total``.

    md5 spreads unique keys evenly over 16**3 prefix buckets; each bucket is ranked on its own and shifted by the
    count of the buckets before it. No sort runs in one task and nothing has to be cached for the two passes to agree.
    """
    hashed = df.withColumn("_hash", hash_key(seed, *key))
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, HEX_DIGITS))
    order = [F.col("_hash"), *[F.col(c) for c in key]]
    return _with_offsets(bucketed, "_bucket", order, name, total).drop("_hash")


def sorted_index(df: DataFrame, col: str, name: str = "id", ranges: int | None = None) -> DataFrame:
    """0-based position of every row in the natural order of ``col``; values must be distinct.

    Range bounds come from the 4096 values with the lowest md5, a sample that is the same on every evaluation; the
    bounds reach the tasks as one scalar subquery of ``ranges - 1`` values, as many as there are shuffle partitions and 64 at least.
    Each range is ranked on its own.
    """
    ranges = ranges or max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    as_text = F.md5(F.col(col).cast("string"))
    sample = df.select(col).orderBy(as_text, F.col(col)).limit(RANGE_SAMPLE)
    ordered = sample.agg(F.sort_array(F.collect_list(col)).alias("v"))
    bounds = ordered.select(
        F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.size("v") > 0),
            lambda i: F.get(F.col("v"), F.floor(i * F.size("v") / ranges).cast("int")),
        ).alias("bounds")
    ).scalar()
    bounded = df.withColumn("_bounds", bounds)
    bucketed = bounded.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b <= F.col(col)))).drop("_bounds")
    return _with_offsets(bucketed, "_bucket", [F.col(col)], name)


def row_total(df: DataFrame, name: str = "n") -> Column:
    """Row count of ``df`` as a scalar inside the same plan."""
    return df.agg(F.count(F.lit(1)).alias(name)).scalar()


def lookup_join(
    left: DataFrame, right: DataFrame | Lookup, on: str | Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    unique_left: bool = False,
) -> DataFrame:
    """Equality lookup of ``right`` (unique on the key, few narrow columns) for every row of ``left``.

    ``right`` is written once and measured while it is written, unless it comes measured; it is broadcast only within ``max_rows``
    rows and 64 MB. A larger one is joined by shuffle, with the hot keys of ``left`` spread over several tasks. With keys that are
    unique on the left too there are none, and they need not be looked for.
    """
    keys = [on] if isinstance(on, str) else list(on)
    known = right if isinstance(right, Lookup) else measured(right, "lookup")
    if known.rows <= max_rows and known.size <= BROADCAST_BYTES:
        return left.join(F.broadcast(known.table), keys, how)
    # A table of few bytes a partition is held as a hash table there, so the rows of the left need not be sorted.
    hashed = how in ("inner", "left") and known.size <= HASHED_BYTES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if unique_left:
        return left.join(known.table.hint("shuffle_hash") if hashed else known.table, keys, how)
    return spread_join(left, known.table, keys, how, hashed=hashed)


def hot_keys(df: DataFrame, keys: Sequence[str], share: int | None = None) -> DataFrame:
    """(_code, _salts): hashes of the keys that hold more than one ``share``-th of the rows (of as many as there are shuffle
    partitions), and over how many tasks each is spread so that none gets more than that.

    Found by a frequent-items sketch of bounded size, which tasks fill and Spark merges; it names every key above the
    share, at most ``share`` of them.
    """
    share = share or max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The sketch holds three quarters of its slots; its error is a fraction of what a slot stands for.
    slots = 1 << max(6, (8 * share).bit_length())
    seen = df.select(F.xxhash64(*keys).alias("_code")).agg(
        F.count(F.lit(1)).alias("_n"), F.expr(f"approx_top_k(_code, {min(share, slots)}, {slots})").alias("_top"))
    found = seen.select("_n", F.inline("_top")).select(
        F.col("item").alias("_code"), F.ceil(F.col("count") * share / F.col("_n")).cast("int").alias("_salts"))
    return written(found.filter("_salts > 1"), "hot-keys")


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", share: int | None = None, hashed: bool = False) -> DataFrame:
    """Shuffle join of a left side with hot keys and a right side that is unique on them. Rows of a hot key are dealt over salts,
    and only the right row of such a key is repeated, once per salt: at most twice ``share`` rows more in all. With ``hashed``, a partition
    holds its right rows as a hash table."""
    hot = hot_keys(left, keys, share)
    # At most ``share`` rows.
    coded = left.withColumn("_code", F.xxhash64(*keys)).join(F.broadcast(hot), "_code", "left")
    # A hash of the row itself, so a task that runs again salts its rows as before.
    hashed = [f"`{f.name}`" for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = coded.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.coalesce("_salts", F.lit(1))).cast("int"))
    repeated = right.withColumn("_code", F.xxhash64(*keys)).join(F.broadcast(hot), "_code", "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    repeated = repeated.drop("_code", "_salts")
    return spread.drop("_code", "_salts").join(repeated.hint("shuffle_hash") if hashed else repeated, [*keys, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark cuts every input partition to k rows per group before the shuffle
    (WindowGroupLimit), so a group with a third of all rows sends only k rows per task."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def running_min(
    df: DataFrame, group: Sequence[str], order: str, value: Column, name: str, block: int = 4096
) -> DataFrame:
    """``min(value)`` over all rows of the group up to the current one, in blocks of ``block`` consecutive orders.

    One partial minimum per block is carried forward, so a single long group is spread over many tasks.
    """
    blocked = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / block))
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*group, "_block").agg(F.min("_value").alias("_m"))
        .withColumn("_carry", F.min("_m").over(ahead)).drop("_m")
    )
    within = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_inside", F.min("_value").over(within))
        .join(carried, [*group, "_block"])
        .withColumn(name, F.least("_inside", "_carry"))
        .drop("_value", "_block", "_inside", "_carry")
    )
