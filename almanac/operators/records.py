"""Record-level transforms and the fixed pipeline of the corpus."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import series, text
from almanac.operators.gates import PROFILE_TEXTS

# Texts the pipeline masks, and the columns it keeps.
PIPELINE_TEXTS = ["report_short_wout_boeen", "gpt_rewritten_cleaned", "gpt_rewritten_apo"]
KEPT = ["city", *[f"overview_{c}" for c in series.CONTEXTS], *PIPELINE_TEXTS, "temperatur_in_deg_C"]
OLD_SPEED, NEW_SPEED = "windgeschwindigkeit_in_km_per_s", "windgeschwindigkeit_in_km_per_h"

Transform = Callable[[DataFrame], DataFrame]


def pipeline(df: DataFrame, *transforms: Transform) -> DataFrame:
    """Apply ``DataFrame -> DataFrame`` functions in order; the result is still one lazy plan."""
    for transform in transforms:
        df = df.transform(transform)
    return df


def fill_series(df: DataFrame, token: str = series.MISSING) -> DataFrame:
    return df.withColumns({c: series.fill_missing(c, token) for c in series.FILLED_SERIES if c in df.columns})


def mask_cities(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.mask_city(c, "city") for c in PIPELINE_TEXTS if c in df.columns})


def tokenize_units(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.unit_tokens(c) for c in PIPELINE_TEXTS if c in df.columns})


def add_contexts(df: DataFrame) -> DataFrame:
    return df.withColumns({f"overview_{name}": series.context(parts) for name, parts in series.CONTEXTS.items()})


def reduce_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in KEPT if c in df.columns])


def corpus_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Missing markers, city, units, contexts, kept columns: the fixed order of the corpus."""
    done = pipeline(df, fill_series, mask_cities, tokenize_units, add_contexts)
    return done.select(*keep, *[c for c in KEPT if c in done.columns and c not in keep])


def fix_wind(df: DataFrame) -> DataFrame:
    """First token of every wind direction; the old speed name wins where both exist and is then dropped."""
    df = df.withColumn("windrichtung", series.first_tokens("windrichtung"))
    if OLD_SPEED not in df.columns:
        return df
    new = F.coalesce(OLD_SPEED, NEW_SPEED) if NEW_SPEED in df.columns else F.col(OLD_SPEED)
    return df.withColumn(NEW_SPEED, new).drop(OLD_SPEED)


def source_text(df: DataFrame, profile: str) -> Column:
    """First text present, in the order of the profile."""
    present = [c for c in PROFILE_TEXTS[profile] if c in df.columns]
    return F.coalesce(*present)


def location(city: str, country: str) -> Column:
    """City and country; NULL when one is missing."""
    return F.concat(F.col(city), F.lit(" "), F.col(country))
