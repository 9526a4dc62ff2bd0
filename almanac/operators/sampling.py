"""Splits, subsets, samples and choices over training histories. All randomness is a seeded md5 order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.series import interval_seconds
from almanac.operators.index import hash_index, hash_key, lookup_join, running_min, top_per_group


def random_split(
    df: DataFrame, key: str, train: float = 0.7, evaluation: float = 0.2, size: int = -1, seed: int = 42
) -> DataFrame:
    """Add ``idx`` and ``split``: floor(n * train) train rows, floor(n * evaluation) eval rows, the rest test."""
    if train + evaluation >= 1.0:
        raise ValueError("train and evaluation shares must sum to less than 1")
    placed = hash_index(df, [key], seed, total="_n")
    if size != -1:
        placed = placed.withColumn("_n", F.least("_n", F.lit(size))).filter(F.col("idx") < F.col("_n"))
    n_train, n_eval = F.floor(F.col("_n") * train), F.floor(F.col("_n") * evaluation)
    name = F.when(F.col("idx") < n_train, "train").when(F.col("idx") < n_train + n_eval, "eval").otherwise("test")
    return placed.withColumn("split", name).drop("_n")


def holdout_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Two-way split; ceil(share * n) rows are held out."""
    placed = hash_index(df, [key], seed, total="_n")
    held = F.col("idx") < F.ceil(F.col("_n") * share)
    return placed.withColumn("split", F.when(held, "test").otherwise("train")).drop("_n")


def nested_subsets(df: DataFrame, key: str, sizes: Sequence[int], seed: int = 42) -> DataFrame:
    """(size, key, idx): the first n rows of one random order for every n, so a smaller subset lies in a larger one."""
    placed = hash_index(df.select(key), [key], seed)
    members = F.filter(F.array(*[F.lit(s).cast("bigint") for s in sizes]), lambda s: s > F.col("idx"))
    return placed.select(F.explode(members).alias("size"), key, "idx")


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """At most ``k`` random rows of each group."""
    return top_per_group(df, [group], [hash_key(seed, key), F.col(key)], k)


def city_counts(df: DataFrame, city: str, at_least: int = 1) -> DataFrame:
    """(city, n) of cities with enough rows, by name."""
    named = df.filter(F.trim(city) != "").groupBy(F.trim(city).alias("city")).agg(F.count(F.lit(1)).alias("n"))
    return named.filter(F.col("n") >= at_least).orderBy("city")


def pick_cities(df: DataFrame, city: str, count: int = 5, at_least: int = 3, seed: int = 42) -> DataFrame:
    """Up to ``count`` random cities with enough rows."""
    return city_counts(df, city, at_least).orderBy(hash_key(seed, "city"), "city").limit(count)


def check_cities(requested: DataFrame, df: DataFrame, city: str) -> DataFrame:
    """(city, n, found) for every requested city."""
    return requested.join(city_counts(df, city), "city", "left").select(
        "city", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("found"))


def _signed(value: str, maximize: bool) -> Column:
    return -F.col(value) if maximize else F.col(value)


def best_epoch(history: DataFrame, run: str, epoch: str, value: str, maximize: bool = False) -> DataFrame:
    """(run, epoch, value): the first epoch that reaches the optimum. A partial aggregate, no sort per run."""
    order = F.struct(_signed(value, maximize).alias("v"), F.col(epoch).alias("e"))
    return history.groupBy(run).agg(F.min(order).alias("_best")).select(
        run, F.col("_best.e").alias("best_epoch"), (-F.col("_best.v") if maximize else F.col("_best.v")).alias("best_value"))


def early_stop(
    history: DataFrame, run: str, epoch: str, value: str, patience: int = 10, maximize: bool = False
) -> DataFrame:
    """(run, stop_epoch, best_epoch): first epoch at least ``patience`` after the best one so far; NULL if it never comes.

    The running minimum of (value, epoch) names the earliest epoch of the best value, so ties do not reset the patience.
    """
    order = F.struct(_signed(value, maximize).alias("v"), F.col(epoch).alias("e"))
    seen = running_min(history, [run], epoch, order, "_best")
    waited = F.col(epoch) - F.col("_best.e") >= patience
    stop = F.min(F.when(waited, F.struct(F.col(epoch).alias("stop"), F.col("_best.e").alias("best")))).alias("_stop")
    return seen.groupBy(run).agg(stop).select(run, F.col("_stop.stop").alias("stop_epoch"), F.col("_stop.best").alias("best_epoch"))


def run_durations(history: DataFrame, run: str, stamp: str) -> DataFrame:
    """(run, epochs, seconds_per_epoch) from one timestamp per epoch."""
    spans = history.groupBy(run).agg(F.count(F.lit(1)).alias("epochs"), (F.max(stamp) - F.min(stamp)).alias("_span"))
    seconds = interval_seconds(F.col("_span")).cast("double")
    return spans.select(run, "epochs", (seconds / F.col("epochs")).alias("seconds_per_epoch"))


def latest_ingest(df: DataFrame, day: str, stamp: str, excluded: Sequence[str] = ()) -> DataFrame:
    """The entry with the latest stamp, leaving out fixed names."""
    return df.filter(~F.col(day).isin(list(excluded))).agg(
        F.max_by(day, F.struct(stamp, day)).alias(day), F.max(stamp).alias(stamp))


def members_only(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of a subset, e.g. of one split's manifest."""
    return lookup_join(df, members.select(key), key, "left_semi", unique_left=True)
