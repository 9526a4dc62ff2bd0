"""Numeric features of a record: one array of doubles per slot."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import series
from almanac.operators.gates import is_finite
from almanac.operators.records import fix_wind
from almanac.schema import NAN

# Number columns of each profile, in feature order.
NUMBERS = {
    "standard": ["temp", "risk", "rain", "speed", "pressure", "humidity", "cloud"],
    "simple": ["temp", "humidity", "cloud"],
}
SLOT_COLUMNS = {
    "times": "slot", "temperatur_in_deg_C": "temp", "niederschlagsrisiko_in_perc": "risk",
    "windgeschwindigkeit_in_km_per_h": "speed", "luftdruck_in_hpa": "pressure", "relative_feuchte_in_perc": "humidity",
    "bewölkungsgrad": "cloud", "windrichtung": "wind",
}
RAIN = "niederschlagsmenge_in_l_per_sqm"


def feature_columns(profile: str) -> list[str]:
    """Columns of a record that the features of a profile are made of."""
    return [*_slot_columns(profile), *([RAIN] if "rain" in NUMBERS[profile] else []), "sunrise", "sundown", "sunhours"]


def _slot_columns(profile: str) -> dict[str, str]:
    if profile not in NUMBERS:
        raise ValueError(f"unknown profile {profile!r}")
    # The temperatures, which every profile has, say how many slots there are.
    return {c: short for c, short in SLOT_COLUMNS.items() if short in ("slot", "wind", *NUMBERS[profile])}


def wind_vocabulary(df: DataFrame) -> Column:
    """Sorted distinct wind directions as one array inside the plan; each becomes a feature of every slot."""
    found = df.select(F.explode("windrichtung").alias("d")).filter(F.col("d") != NAN).distinct()
    return found.agg(F.sort_array(F.collect_list("d")).alias("v")).scalar()


def feature_rows(df: DataFrame, profile: str, key: str | Sequence[str], directions: Sequence[str] | None = None) -> DataFrame:
    """(key, pos, features): one row per slot, features as an array of doubles.

    Order: numbers, one-hot wind, hour sine and cosine, three sun features, sun-hours flag. A value that is no number
    becomes NULL, which the finiteness gate rejects. The arrays are zipped and exploded first, so everything after is
    plain column arithmetic inside one generated stage. Only the series of the profile are read (``feature_columns``).
    """
    series_of = _slot_columns(profile)
    keys, numbers = [key] if isinstance(key, str) else list(key), NUMBERS[profile]
    if "speed" in numbers:
        df = fix_wind(df)
    if directions is None:
        # The first token is taken of distinct directions, not of those of every slot.
        met = df.select(F.explode("windrichtung").alias("d")).distinct()
        vocabulary = wind_vocabulary(met.select(F.array(series.first_token(F.col("d"))).alias("windrichtung")))
    else:
        vocabulary = F.array(*[F.lit(d) for d in directions]).cast("array<string>")
    df = df.withColumn("_vocabulary", vocabulary)
    arrays = [F.col(c).alias(short) for c, short in series_of.items()]
    if "rain" in numbers:
        arrays.append(series.forward_fill(RAIN).alias("rain"))
    zipped = F.slice(F.arrays_zip(*arrays), 1, F.size("temperatur_in_deg_C"))
    # Clocks and the flag are parsed once per record, before the explode.
    slots = df.select(
        *keys, "_vocabulary", series.clock_hours("sunrise").alias("rise"), series.clock_hours("sundown").alias("down"),
        series.hardly_any_sun("sunhours").alias("dim"), F.posexplode(zipped).alias("pos", "s"))
    made = {"rain": F.col("s.rain"), "cloud": series.cloud_fraction(F.col("s.cloud"))}
    slots = slots.select(
        *keys, "_vocabulary", "pos", "rise", "down", "dim", series.first_token(F.col("s.wind")).alias("wind"),
        *[(made[c] if c in made else series.number(F.col(f"s.{c}"))).alias(c) for c in numbers],
        series.slot_start(F.col("s.slot")).alias("now"), series.slot_hour(F.col("s.slot")).alias("hour"))
    head = [F.col(n).cast("double") for n in numbers]
    sun = series.sun_features(F.col("rise"), F.col("down"), F.col("now"))
    tail = [*series.cyclic(F.col("hour")), *sun, F.col("dim")]
    features = F.concat(F.array(*head), series.one_hot(F.coalesce("wind", F.lit(NAN)), F.col("_vocabulary")), F.array(*tail))
    return slots.select(*keys, "pos", features.alias("features"))


def finite_records(rows: DataFrame, key: str) -> DataFrame:
    """Keys of records whose every feature of every slot is a finite number."""
    return rows.groupBy(key).agg(F.every(is_finite("features")).alias("_ok")).filter("_ok").select(key)


def long_features(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, feature, value): one row per slot and feature."""
    return rows.select(*keys, "pos", F.posexplode("features").alias("feature", "value"))


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean, deviation) of all values; a partial aggregate, so exploded values never cross the network."""
    values = rows.select(*keys, F.explode("features").alias("value")) if "feature" not in keys else rows.select(
        *[k for k in keys if k != "feature"], F.posexplode("features").alias("feature", "value"))
    return values.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))


def _scaled(mean: Column, deviation: Column, epsilon: float) -> Column:
    return (F.col("value") - mean) / (deviation + epsilon)


def standardize_by_batch(rows: DataFrame, batch: str, *keys: str, epsilon: float = 1e-8) -> DataFrame:
    """(batch, keys, pos, feature, value): (x - mean) / (std + epsilon), with the moments of each feature within its batch.

    Two steps read ``rows``, so they are better written once. Moments (count, mean, squared deviations) merge, so no values are shuffled
    for them; rows travel once, as arrays, to the moments of their batch. Scaling follows the explode, as plain arithmetic inside
    one generated stage.
    """
    moments = _moments(rows, batch, "feature").groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct("feature", "mean", "deviation"))).alias("_m"))
    joined = rows.join(moments.hint("shuffle_hash"), batch)
    long = joined.select(batch, *keys, "pos", "_m", F.posexplode("features").alias("feature", "value"))
    own = F.get("_m", F.col("feature"))
    return long.select(batch, *keys, "pos", "feature", _scaled(own["mean"], own["deviation"], epsilon).alias("value"))


def standardize_globally(rows: DataFrame, *keys: str, epsilon: float = 1e-8) -> DataFrame:
    """(keys, pos, feature, value): (x - mean) / (std + epsilon), with one mean and deviation over all values of all features.

    Two steps read ``rows``, so they are better written once. Scaling follows the explode, as plain arithmetic inside one generated
    stage.
    """
    stats = _moments(rows).select(F.struct("mean", "deviation").alias("v")).scalar()
    long = long_features(rows.withColumn("_v", stats), *keys, "_v")
    return long.select(*keys, "pos", "feature", _scaled(F.col("_v.mean"), F.col("_v.deviation"), epsilon).alias("value"))
