"""Entity masking and counting with a caller's gazetteer table (column ``name``)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import series, text
from almanac.operators.index import hash_index, lookup_join

TOKEN = "(" + "|".join(text.PROTECTED_TAGS) + r"|[\p{L}\p{N}_]+|[^\p{L}\p{N}_])"
WORD = r"^[\p{L}\p{N}_]"
MIN_FREE_CHARS = 20


def _tokens(c: str | Column) -> Column:
    """Tags, words and single other characters; joined without a separator they give the text back."""
    return F.regexp_extract_all(text.col(c), F.lit("(?s)" + TOKEN), F.lit(1))


def _matches(df: DataFrame, key: str, text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(key, matches): leftmost-longest, non-overlapping gazetteer spans as structs (start, len, name)."""
    names = gazetteer.select("name").filter("name <> ''").distinct()
    # Only lengths that occur among the names are tried, and only signs with which a name begins: two small arrays in the plan.
    sizes = names.agg(F.sort_array(F.collect_set(F.size(_tokens("name")))).alias("v")).scalar()
    signs = names.select(F.get(_tokens("name"), F.lit(0)).alias("t")).filter(~F.col("t").rlike(WORD) & ~F.col("t").isin(text.PROTECTED_TAGS))
    signs = signs.agg(F.sort_array(F.collect_set("t")).alias("v")).scalar()

    def spans(tokens: Column) -> Column:
        lengths = F.col("_sizes")
        begins = F.filter(series.positions(F.size(tokens)), lambda i: F.get(tokens, i).rlike(WORD) | F.array_contains(F.col("_signs"), F.get(tokens, i)))
        at = F.transform(begins, lambda i: F.transform(
            lengths, lambda n: F.struct(i.alias("start"), n.alias("len"), F.array_join(F.slice(tokens, i + 1, n), "").alias("name"))))
        return F.filter(F.flatten(at), lambda s: s["start"] + s["len"] <= F.size(tokens))

    tokens = _tokens(text_col)
    candidates = df.select(key, tokens.alias("_tokens"), sizes.alias("_sizes"), signs.alias("_signs")).select(key, F.inline(spans(F.col("_tokens"))))
    found = lookup_join(candidates, names, "name", "inner")
    # Only real matches of one text are gathered, so a group is bounded by the length of that text.
    per_text = found.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", (-F.col("len")).alias("back"), "len", "name"))).alias("_all"))
    none = F.array().cast("array<struct<start:int,back:int,len:int,name:string>>")

    def keep(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        free = (F.size(kept) == 0) | (s["start"] >= last["start"] + last["len"])
        return F.when(F.size(kept) == 0, F.array(s)).when(free, F.concat(kept, F.array(s))).otherwise(kept)

    return per_text.select(key, F.aggregate("_all", none, keep).alias("matches"))


def mask_entities(df: DataFrame, key: str, text_col: str, gazetteer: DataFrame, tag: str = "<ne>") -> DataFrame:
    """Replace gazetteer names in ``text_col`` by ``tag``, longest first, in place; tags stay as they are.

    Texts with at most 20 characters outside tags are left alone.
    """
    spans = _matches(df, key, text_col, gazetteer)
    joined = df.join(spans, key, "left").withColumn("_tokens", _tokens(text_col))
    n = F.size("matches")

    def piece(i: Column) -> Column:
        at = F.get("matches", i)
        before = F.get("matches", i - 1)
        start = F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["len"])
        return F.concat(F.array_join(F.slice("_tokens", start + 1, at["start"] - start), ""), F.lit(tag))

    last = F.element_at("matches", -1)
    end = last["start"] + last["len"]
    rest = F.array_join(F.slice("_tokens", end + 1, F.size("_tokens")), "")
    masked = F.concat(F.array_join(F.transform(series.positions(n), piece), ""), rest)
    skip = F.col("matches").isNull() | (text.free_length(text_col) <= MIN_FREE_CHARS)
    return joined.withColumn(text_col, F.when(skip, F.col(text_col)).otherwise(masked)).drop("_tokens", "matches")


def tag_text(df: DataFrame, key: str, text_col: str, city: str, gazetteer: DataFrame) -> DataFrame:
    """City, units and dates, then entities outside the tags."""
    return mask_entities(df.withColumn(text_col, text.tagged_text(text_col, city)), key, text_col, gazetteer)


def entity_counts(
    df: DataFrame, key: str, text_col: str, gazetteer: DataFrame, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """(name, n) over all texts, or over a seeded sample of ``sample`` texts."""
    texts = df.filter(F.col(text_col).isNotNull())
    if sample is not None:
        texts = texts.join(hash_index(texts.select(key), [key], seed).filter(F.col("idx") < sample).select(key), key, "left_semi")
    found = _matches(texts, key, text_col, gazetteer)
    return found.select(F.explode("matches.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
