"""Column functions on the parallel hourly arrays of a record, kept wide (24 slots) inside one row."""

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.text import col
from almanac.schema import NAN

MISSING = "<missing>"
# Series in which missing cells are replaced.
FILLED_SERIES = [
    "times", "clearness", "temperatur_in_deg_C", "niederschlagsrisiko_in_perc", "niederschlagsmenge_in_l_per_sqm",
    "windrichtung", "windgeschwindigkeit_in_km_per_h", "bewölkungsgrad",
]
# The series of each context, in print order.
CONTEXTS = {
    "full": FILLED_SERIES,
    "ctpc": ["times", "clearness", "temperatur_in_deg_C", "niederschlagsrisiko_in_perc",
             "niederschlagsmenge_in_l_per_sqm", "bewölkungsgrad"],
    "ctc": ["times", "clearness", "temperatur_in_deg_C", "bewölkungsgrad"],
    "ct": ["times", "clearness", "temperatur_in_deg_C"],
    "tpwc": ["times", "temperatur_in_deg_C", "niederschlagsrisiko_in_perc", "niederschlagsmenge_in_l_per_sqm",
             "windrichtung", "windgeschwindigkeit_in_km_per_h", "bewölkungsgrad"],
}
# Target column by name.
TARGETS = {"gpt": "gpt_rewritten_apo", "default": "report_short_wout_boeen"}
# Fixed value: sun-hours sentence that means the sun hardly shows.
HARDLY_ANY_SUN = "fast nicht zu sehen"
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def fill_missing(series: str | Column, token: str = MISSING) -> Column:
    return F.transform(col(series), lambda v: F.when(v == NAN, F.lit(token)).otherwise(v))


def positions(n: Column) -> Column:
    """0 .. n-1, empty for n = 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def context(series: Sequence[str | Column]) -> Column:
    """Slots joined by ``;``, the chosen series of a slot joined by ``;``; stops at the shortest series.

    The arrays are zipped once and walked together; reading each array by index inside the walk would make Spark rebuild
    a computed array for every slot.
    """
    arrays = [col(s) for s in series]
    zipped = F.arrays_zip(*[a.alias(f"c{i}") for i, a in enumerate(arrays)])
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    slots = F.transform(
        F.slice(zipped, 1, n),
        lambda s: F.concat_ws(";", *[F.coalesce(s[f"c{i}"], F.lit("None")) for i in range(len(arrays))]),
    )
    return F.array_join(slots, ";")


def context_column(name: str) -> str:
    if name not in CONTEXTS:
        raise ValueError(f"unknown context {name!r}, expected one of {sorted(CONTEXTS)}")
    return f"overview_{name}"


def target_column(name: str) -> str:
    if name not in TARGETS:
        raise ValueError(f"unknown target {name!r}, expected one of {sorted(TARGETS)}")
    return TARGETS[name]


def first_token(value: Column) -> Column:
    """First white-space token of a text; a blank or missing one stays."""
    token = F.regexp_extract(value, r"(?U)(\S+)", 1)
    return F.when(token == "", value).otherwise(token)


def first_tokens(series: str | Column) -> Column:
    """First white-space token of every element; blank and missing ones stay."""
    return F.transform(col(series), first_token)


def number(text: Column) -> Column:
    """Double of a plain decimal text, NULL for anything else (``try_cast`` alone would accept type suffixes)."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def forward_fill(series: str | Column) -> Column:
    """Numbers of a series with gaps filled by the last number before them, 0.0 at the start."""
    filled = F.aggregate(
        col(series),
        F.array(F.lit(0.0)),
        lambda acc, v: F.concat(acc, F.array(F.coalesce(number(v), F.element_at(acc, -1)))),
    )
    return F.slice(filled, 2, F.greatest(F.size(filled) - 1, F.lit(0)))


def cloud_fraction(text: Column) -> Column:
    return number(F.substring_index(text, "/", 1)) / 8


def slot_hour(slot: Column) -> Column:
    """Start hour of a slot label; NULL when it does not begin with an integer."""
    head = F.trim(F.substring_index(slot, " - ", 1))
    return F.when(head.rlike("^[+-]?[0-9]+$"), head.try_cast("int"))


def cyclic_hour(slot: Column) -> tuple[Column, Column]:
    return cyclic(slot_hour(slot))


def cyclic(hour: Column) -> tuple[Column, Column]:
    """Sine and cosine of an hour on the 24-hour circle; (0, 1) when there is none."""
    angle = hour * F.lit(2 * math.pi) / 24
    return F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(1.0))


def clock_hours(text: str | Column) -> Column:
    """Hours of a clock text such as ``06:30 Uhr``; NULL for a dash, a blank, no colon or non-numbers."""
    clock = F.substring_index(col(text), " ", 1)
    hours, minutes = F.substring_index(clock, ":", 1), F.substring_index(clock, ":", -1)
    return F.when(clock.rlike("^[0-9]+:[0-9]+$"), hours.try_cast("int") + minutes.try_cast("int") / 60)


def sun_features(rise: Column, down: Column, now: Column) -> tuple[Column, Column, Column]:
    """(daylight flag, share since sunrise, share until sunset) of an hour; all three arguments are hours.

    Pass columns that hold the parsed clocks: every argument occurs many times in the result.
    """
    unknown = rise.isNull() | down.isNull()
    day = now.between(rise, down)
    night = F.lit(24.0) - down + rise
    since = (
        F.when(day, F.try_divide(now - rise, down - rise))
        .when(now < rise, -F.try_divide(rise - now, night)).otherwise(F.lit(-1.0)))
    until = (
        F.when(day, F.try_divide(down - now, down - rise))
        .when(now < rise, F.lit(-1.0)).otherwise(-F.try_divide(now - down, night)))

    def pick(missing: float, value: Column) -> Column:
        return F.when(now.isNull(), F.lit(0.0)).when(unknown, F.lit(missing)).otherwise(value)

    return pick(0.5, F.when(day, 1.0).otherwise(0.0)), pick(0.0, since), pick(0.0, until)


def slot_start(slot: Column) -> Column:
    """Start of a slot label as a number of hours, NULL when it is none."""
    return number(F.substring_index(slot, " - ", 1))


def one_hot(value: Column, vocabulary: Column) -> Column:
    return F.transform(vocabulary, lambda v: F.when(v == value, 1.0).otherwise(0.0))


def hardly_any_sun(text: str | Column) -> Column:
    return F.when(F.coalesce(col(text), F.lit("")).contains(HARDLY_ANY_SUN), 1.0).otherwise(0.0)


def hour_difference(scraped: str | Column, actual: str | Column) -> Column:
    return F.pmod(col(scraped) - col(actual), F.lit(24))


def interval_seconds(span: Column) -> Column:
    """Seconds of a day-time interval, such as the difference of two timestamps; no session time zone is involved."""
    def part(name: str) -> Column:
        return F.extract(F.lit(name), span)

    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def utc_instant(wall: str | Column) -> Column:
    """Instant of a UTC wall-clock time stored without zone, whatever the session's zone is."""
    return F.timestamp_seconds(interval_seconds(col(wall) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def utc_offset_hours(zone: str | Column, instant: Column) -> Column:
    """Offset of a zone at ``instant`` (a UTC timestamp without zone) in hours; NULL for an unknown zone."""
    zero = F.lit(0)
    known = F.try_make_timestamp(F.lit(2000), F.lit(1), F.lit(1), zero, zero, zero.cast("decimal(16,6)"), col(zone)).isNotNull()
    there = F.convert_timezone(F.lit("UTC"), F.when(known, col(zone)), instant)
    shift = there - instant
    return F.extract(F.lit("HOUR"), shift) + F.extract(F.lit("MINUTE"), shift) / 60
