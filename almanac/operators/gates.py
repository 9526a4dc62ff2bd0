"""Record predicates and the filters built on them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators.index import hash_key, lookup_join
from almanac.schema import CORRUPT, FIRST_SLOT

SLOTS = 24
# Keys a complete record has.
REQUIRED = ["city", "created_day", "times", "report_short_wout_boeen"]
# Keys and texts by profile.
PROFILE_BASE = ["city", "times", "temperatur_in_deg_C", "relative_feuchte_in_perc", "bewölkungsgrad", "windrichtung"]
PROFILE_KEYS = {
    "standard": PROFILE_BASE + ["niederschlagsrisiko_in_perc", "niederschlagsmenge_in_l_per_sqm", "luftdruck_in_hpa", "report_long"],
    "simple": PROFILE_BASE,
}
# The wind speed's key now and in older records; the standard profile needs either.
SPEED_KEYS = ["windgeschwindigkeit_in_km_per_h", "windgeschwindigkeit_in_km_per_s"]
PROFILE_TEXTS = {
    "standard": ["report_long", "gpt_rewritten_v2", "gpt_rewritten_apokalyptisch_v2"],
    "simple": ["gpt_rewritten_apokalyptisch_v2", "gpt_rewritten_v2", "report_long"],
}
# Numbers as a permissive parser reads them once full stops are deleted.
NUMERIC_TOKEN = r"(?i)^[+-]?([0-9]+(_[0-9]+)*(e[+-]?[0-9]+(_[0-9]+)*)?|nan|inf|infinity)$"


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _have(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Non-null test per name; a column the frame lacks counts as absent."""
    return [F.col(n).isNotNull() if n in df.columns else F.lit(False) for n in names]


def starts_at_midnight(times: str = "times", report: str = "report_short") -> Column:
    return F.coalesce(F.get(F.col(times), F.lit(0)) == FIRST_SLOT, F.lit(False)) & F.col(report).isNotNull()


def is_complete(df: DataFrame, required: Sequence[str] = REQUIRED, slots: int = SLOTS) -> Column:
    return _all(_have(df, required)) & F.coalesce(F.size("times") == slots, F.lit(False))


def temperatures_agree(report: str | Column, series: str | Column) -> Column:
    """Every number token of the report is one of the series' texts."""
    bare = text.swap(text.swap(text.col(report), "°C", ""), ".", "")
    found = F.filter(text.words(bare), lambda w: w.rlike(NUMERIC_TOKEN))
    return F.forall(found, lambda w: F.array_contains(text.col(series), w))


def loadable(df: DataFrame, profile: str) -> Column:
    """Required keys of the profile, one text at least, and a city that is not blank."""
    if profile not in PROFILE_KEYS:
        raise ValueError(f"unknown profile {profile!r}")
    any_text = _any(_have(df, PROFILE_TEXTS[profile]))
    speed = _any(_have(df, SPEED_KEYS)) if profile == "standard" else F.lit(True)
    return _all(_have(df, PROFILE_KEYS[profile])) & speed & any_text & (text.strip("city") != "")


def is_readable(df: DataFrame) -> Column:
    return F.col(CORRUPT).isNull()


def is_finite(features: str | Column) -> Column:
    """No value of an array of doubles is NULL, NaN or infinite."""
    return F.forall(text.col(features), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def gate_counts(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Kept rows after each gate, applied one after the other, in one pass: (step, gate, kept, dropped)."""
    kept, so_far = [F.count(F.lit(1)).alias("n0")], F.lit(True)
    for i, gate in enumerate(gates.values(), 1):
        so_far = so_far & F.coalesce(gate, F.lit(False))
        kept.append(F.count_if(so_far).alias(f"n{i}"))
    rows = [
        F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("gate"), F.col(f"n{i}").alias("kept"),
                 (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("dropped"))
        for i, name in enumerate(gates, 1)
    ]
    return df.agg(*kept).select(F.inline(F.array(*rows)))


def drop_undescribed(raw: DataFrame, standard: DataFrame, base: str, description: Column) -> tuple[DataFrame, DataFrame]:
    """Remove raw rows without a description together with their standardised siblings of the same base name."""
    gone = raw.filter(description.isNull()).select(base)
    return raw.filter(description.isNotNull()), standard.join(gone, base, "left_anti")


def due_cities(cities: DataFrame, hour: int, difference: str, key: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Cities whose local midnight is now; on request a seeded random ``cap`` of them when there are more."""
    to_midnight = 24 - hour if hour else 0
    due = cities.filter(F.col(difference) == to_midnight)
    return due if cap is None else due.orderBy(hash_key(seed, key), F.col(key)).limit(cap)


def active_flag(cities: DataFrame, files: DataFrame, identifier: str, name: str, description: str) -> DataFrame:
    """``active``: the first file (by name) of a city's identifier has a description; cities without a file are not.

    The first file per identifier is a partial aggregate, so a city with many files sends one row per task.
    """
    first = (
        files.select(text.file_identifier(name).alias(identifier), F.col(name).alias("_name"),
                     F.col(description).isNotNull().alias("_described"))
        .groupBy(identifier).agg(F.min_by("_described", "_name").alias("active"))
    )
    joined = cities.join(first, identifier, "left")
    return joined.withColumn("active", F.coalesce("active", F.lit(False)))


def search_names(cities: DataFrame, name: str, query: str) -> DataFrame:
    return cities.filter(F.lower(name).contains(query.lower())).orderBy(name)


def drop_small_groups(df: DataFrame, group: str, more_than: int) -> DataFrame:
    """Rows of groups with more than ``more_than`` rows."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than).select(group)
    return lookup_join(df, big, group, "left_semi")


