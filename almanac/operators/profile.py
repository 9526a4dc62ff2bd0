"""Corpus statistics. Every count is a partial aggregate before the shuffle, so hot words and cities stay cheap."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import series, text
from almanac.schema import NAN

NUMBER_PREFIX = r"^-?[0-9]+"
SENTENCE_END = r"[A-Za-z0-9]+[.!?]"
SERIES = [c for c in series.FILLED_SERIES if c != "times"]


def word_count(prepared: str | Column) -> Column:
    return F.size(text.words(prepared))


def sentence_count(report: str | Column) -> Column:
    return F.regexp_count(text.col(report), F.lit(SENTENCE_END))


def vocabulary_words(df: DataFrame, report: str, city: str) -> DataFrame:
    """Distinct tokens of the prepared reports that do not start like a number."""
    tokens = df.select(F.explode(text.words(text.profiling_text(report, city))).alias("token"))
    return tokens.filter(~F.col("token").rlike(NUMBER_PREFIX)).distinct()


def missing_cells() -> tuple[Column, Column]:
    """(missing cells, all cells) of a record over its series without the times."""
    gaps, cells = F.lit(0), F.lit(0)
    for c in SERIES:
        gaps = gaps + F.size(F.filter(c, lambda v: v == NAN))
        cells = cells + F.size(c)
    return gaps, cells


def missing_share(df: DataFrame) -> DataFrame:
    gaps, cells = missing_cells()
    return df.agg(F.try_divide(F.sum(gaps), F.sum(cells)).alias("missing_share"))


def corpus_stats(df: DataFrame, report: str, city: str) -> DataFrame:
    """One row: files, mean words, vocabulary size, cities, mean sentences, percentage of missing cells."""
    gaps, cells = missing_cells()
    size = vocabulary_words(df, report, city).agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = df.agg(
        F.count(F.lit(1)).alias("number_of_files"),
        F.avg(word_count(text.profiling_text(report, city))).alias("avg_length"),
        F.count_distinct(city).alias("n_cities"),
        F.avg(sentence_count(report)).alias("avg_n_sentences"),
        (F.try_divide(F.sum(gaps), F.sum(cells)) * 100).alias("perc_nans_in_context"),
    )
    return stats.withColumn("vocab_size", size)


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, left, right, n) of equal-width bins over low..high or over the data's own range; the last bin is closed.

    Every bin is listed. A single-valued column gets a range of one around its value. Values outside fall away.
    """
    if low is None or high is None:
        ends = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("r")).scalar()
        flat = F.col("_r.lo") == F.col("_r.hi")
        lo = F.when(flat, F.col("_r.lo") - 0.5).otherwise(F.col("_r.lo"))
        hi = F.when(flat, F.col("_r.hi") + 0.5).otherwise(F.col("_r.hi"))
    else:
        ends = F.struct(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
        lo, hi = F.col("_r.lo"), F.col("_r.hi")

    def ranged(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_r", ends).withColumns({"_lo": lo, "_hi": hi}).drop("_r")

    inside = ranged(df.select(F.col(value).cast("double").alias("_v"))).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    counts = inside.groupBy(F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    every = ranged(df.sparkSession.range(bins).withColumnRenamed("id", "bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"))


def start_census(df: DataFrame, times: str = "times") -> DataFrame:
    """(kind, label, n): series starting with 01, with 00, all others, and the others by their first 11 characters."""
    first = F.get(F.col(times), F.lit(0))
    starts = df.select(F.substring(first, 1, 11).alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("start").startswith("01"), "one").when(F.col("start").startswith("00"), "zero").otherwise("rest")
    total = F.struct(kind.alias("kind"), F.lit("").alias("label"))
    detail = F.struct(F.lit("rest label").alias("kind"), F.col("start").alias("label"))
    rows = starts.select(F.explode(F.when(kind == "rest", F.array(total, detail)).otherwise(F.array(total))).alias("r"), "n")
    return rows.groupBy("r.kind", "r.label").agg(F.sum("n").alias("n"))


def offset_bucket(offset: Column) -> Column:
    """Name of an offset's file: ``UTC_plus_5_5``, ``UTC_minus_3_0``."""
    sign = F.when(offset >= 0, "plus").otherwise("minus")
    return F.concat(F.lit("UTC_"), sign, F.lit("_"), F.replace(F.abs(offset).cast("string"), F.lit("."), F.lit("_")))


def offset_summary(df: DataFrame, offset: str, zone: str) -> DataFrame:
    """(utc_offset, cities, filename, zones) per offset, most cities first. The set of zones is bounded by the zone list."""
    label = F.concat(F.lit("UTC"), F.when(F.col(offset) >= 0, "+").otherwise(""), F.col(offset).cast("string"))
    grouped = df.filter(F.col(offset).isNotNull()).groupBy(offset).agg(
        F.count(F.lit(1)).alias("cities"), F.array_join(F.sort_array(F.collect_set(zone)), ", ").alias("zones"))
    return grouped.select(
        label.alias("utc_offset"), "cities", F.concat(offset_bucket(F.col(offset)), F.lit(".csv")).alias("filename"), "zones",
    ).orderBy(F.desc("cities"), "utc_offset")


def city_index(df: DataFrame, city: str, key: str) -> DataFrame:
    """(city, key) sorted: the records of every city. One row per record, so a hot city spreads over range partitions."""
    name = text.strip(city)
    return df.select(name.alias("city"), key).filter(F.col("city") != "").orderBy("city", key)


def token_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n"))


def term_counts(df: DataFrame, key: str, prepared: Column) -> DataFrame:
    """(key, term, n): how often each term occurs in each report."""
    return df.select(key, F.explode(text.words(prepared)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def document_counts(terms: DataFrame) -> DataFrame:
    """(term, documents)."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def compare_tokens(left: DataFrame, right: DataFrame, token: str = "token") -> DataFrame:
    """One row: sizes of two token lists with and without duplicates, number-like tokens, overlap and IoU."""
    both = left.select(token, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(token, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy(token).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    in_l, in_r, digits = F.col("l") > 0, F.col("r") > 0, F.col(token).rlike(NUMBER_PREFIX)
    return per.agg(
        F.sum("l").alias("left_tokens"), F.count_if(in_l).alias("left_distinct"),
        F.sum("r").alias("right_tokens"), F.count_if(in_r).alias("right_distinct"),
        F.count_if(in_l & ~digits).alias("left_non_numeric"), F.count_if(in_r & digits).alias("right_numeric"),
        F.count_if(in_l & in_r).alias("shared"), F.count(F.lit(1)).alias("all_tokens"),
        F.try_divide(F.count_if(in_l & in_r), F.count(F.lit(1))).alias("iou"),
    )
