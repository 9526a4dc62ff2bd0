"""Vocabularies, token sequences and id remaps."""

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import text
from almanac.operators.index import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, sorted_index
from almanac.storage import measured, written

# Special tokens of the two vocabularies and the word vocabulary's stand-ins for punctuation.
CONTEXT_SPECIALS = ["<unknown>", "<padding>", "<missing>"]
WORD_SPECIALS = ["<city>", "<start>", "<stop>", "<unknown>", "<padding>"]
EXTRA_TOKENS = [(".", "<point>"), (",", "<comma>")]
UNKNOWN = "<unknown>"
START, STOP = "<start>", "<stop>"


def context_parts(context: str | Column) -> Column:
    return F.split(text.col(context), ";", -1)


def context_tokens(df: DataFrame, context: str) -> DataFrame:
    """Distinct parts between semicolons."""
    return df.select(F.explode(context_parts(context)).alias("token")).distinct()


def word_tokens(df: DataFrame, report: str) -> DataFrame:
    """Distinct words once basic punctuation and brackets are deleted."""
    bare = F.translate(report, ".,!:?();", "")
    return df.select(F.explode(text.words(bare)).alias("token")).distinct()


def id_set(df: DataFrame, ids: str, extra: Sequence[int] = ()) -> DataFrame:
    """Distinct ids of given id arrays together with extra ones, e.g. those of the written numbers."""
    used = df.select(F.explode(F.col(ids).cast("array<bigint>")).alias("id"))
    more = df.sparkSession.createDataFrame([(int(i),) for i in extra], "id bigint")
    return used.union(more).distinct()


def vocabulary(tokens: DataFrame, specials: Sequence[str]) -> DataFrame:
    """(token, id): tokens and specials in code-point order, numbered from 0.

    The distinct tokens are written, and the numbered ones again: a vocabulary is read several times, and neither the corpus
    should be scanned nor the tokens numbered again for each of them.
    """
    more = tokens.sparkSession.createDataFrame([(s,) for s in specials], "token string")
    distinct = written(tokens.select("token").union(more).distinct(), "tokens")
    return written(sorted_index(distinct, "token", "id"), "vocabulary")


def with_extra_tokens(s: str | Column) -> Column:
    out = text.col(s)
    for mark, token in EXTRA_TOKENS:
        out = text.swap(out, mark, f" {token}")
    return out


def without_extra_tokens(s: str | Column) -> Column:
    out = text.col(s)
    for mark, token in EXTRA_TOKENS:
        out = text.swap(out, f" {token}", mark)
    return out


def wrapped(s: str | Column, spaced: bool = True) -> Column:
    """Start and stop tokens around a text; the word-piece variant has no spaces."""
    gap = " " if spaced else ""
    return F.concat(F.lit(START + gap), text.col(s), F.lit(gap + STOP))


def wrapped_ids(ids: str | Column, start: int, stop: int) -> Column:
    return F.array_append(F.array_prepend(text.col(ids), F.lit(start)), F.lit(stop))


def _replace_each(df: DataFrame, key: str, parts: Column, table: DataFrame, old: str, new: str, miss: Column | Callable[[Column], Column], out: str, in_place: bool = True) -> DataFrame:
    """(key, out): every element of an array looked up in a table, in order.

    With ``in_place``, a table within the bounds of a broadcast goes to the tasks as two Arrow columns, and the arrays are looked up as they lie: nothing
    is exploded, shuffled or gathered again. Otherwise rows are hash-partitioned by key and content while the arrays are
    still compact, and there numbered among those that agree in both: one result per row, also where keys repeat. The explode and
    the lookup keep that partitioning, so gathering the elements again needs no second shuffle.
    """
    known = measured(table.select(old, F.col(new).alias("_new")), "lookup")
    if in_place and known.rows <= BROADCAST_ROWS and known.size <= BROADCAST_BYTES:
        found = df.select(key, F.coalesce(parts, F.array().cast(df.select(parts).schema[0].dataType)).alias("_parts")).withColumn("_found", _looked_up(known.table, old, "_parts"))
        if isinstance(miss, Column):
            # A scalar subquery may not stand inside a lambda.
            found = found.withColumn("_miss", miss)
        pairs = F.arrays_zip(F.col("_parts").alias(old), F.col("_found").alias("_new"))
        return found.select(key, F.transform(pairs, lambda s: F.coalesce(s["_new"], F.col("_miss") if isinstance(miss, Column) else miss(s[old]))).alias(out))
    items = df.select(key, parts.alias("_parts")).withColumn("_row", F.xxhash64("_parts")).repartition(key, "_row")
    items = items.withColumn("_copy", F.row_number().over(Window.partitionBy(key, "_row").orderBy("_row")))
    rows = items.select(key, "_row", "_copy", F.posexplode_outer("_parts").alias("_pos", old))
    found = lookup_join(rows, known, old)
    value = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_new", miss if isinstance(miss, Column) else miss(F.col(old))).alias("v")))
    gathered = found.groupBy(key, "_row", "_copy").agg(F.sort_array(F.collect_list(value)).alias("_all"))
    return gathered.select(key, F.transform("_all", lambda s: s["v"]).alias(out))


def _looked_up(table: DataFrame, old: str, parts: str) -> Column:
    """For every element of an array its ``_new`` in a small table, NULL where it has none."""
    held = table.filter(F.col(old).isNotNull()).toArrow().combine_chunks()
    # Two plain lists of buffers, sent along once with the function.
    olds, news = (held.column(i).combine_chunks() for i in (0, 1))

    def look_up(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        flat = lists.flatten()
        at = pc.index_in(flat, value_set=olds.cast(flat.type))
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(starts, news.take(at))

    kind = T.ArrayType(table.schema["_new"].dataType)
    return F.arrow_udf(look_up, kind)(F.col(parts))


def encode(df: DataFrame, key: str, parts: Column, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """(key, ids); a part outside the vocabulary gets the id of ``<unknown>``."""
    unknown = vocab.filter(F.col("token") == UNKNOWN).agg(F.max("id").alias("u")).scalar()
    return _replace_each(df, key, parts, vocab, "token", "id", unknown, out, in_place=False)


def encode_context(df: DataFrame, key: str, context: str, vocab: DataFrame) -> DataFrame:
    return encode(df, key, context_parts(context), vocab)


def encode_words(df: DataFrame, key: str, report: str | Column, vocab: DataFrame) -> DataFrame:
    return encode(df, key, text.words(with_extra_tokens(report)), vocab)


def _miss(what: str, kind: str) -> Callable[[Column], Column]:
    return lambda part: F.raise_error(F.concat(F.lit(f"no {what} for "), part.cast("string"))).cast(kind)


def decode(df: DataFrame, key: str, ids: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """(key, text): tokens joined by a space, stop and comma tokens put back; an unknown id is an error."""
    table = vocab.select(F.col("id").cast("bigint"), "token")
    words = _replace_each(df, key, F.col(ids).cast("array<bigint>"), table, "id", "token", _miss("token", "string"), "_words")
    return words.select(key, without_extra_tokens(F.array_join("_words", " ")).alias(out))


def remap(df: DataFrame, key: str, ids: str, mapping: DataFrame, old: str = "old", new: str = "new",
          on_missing: str | int = "error", out: str = "ids") -> DataFrame:
    """(key, ids) with every id replaced; a miss is an error, or the given id."""
    miss = _miss("id", "bigint") if on_missing == "error" else F.lit(int(on_missing)).cast("bigint")
    return _replace_each(df, key, F.col(ids).cast("array<bigint>"), mapping, old, new, miss, out)


def subset_mapping(ids: DataFrame, specials: Sequence[int]) -> DataFrame:
    """(old, new): the used ids and the special ones, numbered from 0 in id order."""
    more = ids.sparkSession.createDataFrame([(int(s),) for s in specials], "id bigint")
    used = written(ids.select(F.col("id").cast("bigint")).union(more).distinct(), "ids")
    return written(sorted_index(used.withColumnRenamed("id", "old"), "old", "new"), "mapping")


def reduced_vocabulary(df: DataFrame, ids: str, specials: Sequence[int]) -> DataFrame:
    """(old, new, n): used ids with their counts and specials (count 1 when unused), ordered by id, not by frequency."""
    more = df.sparkSession.createDataFrame([(int(s),) for s in specials], "old bigint").distinct()
    used = df.select(F.explode(F.col(ids).cast("array<bigint>")).alias("old")).groupBy("old").agg(F.count(F.lit(1)).alias("n"))
    unused = more.join(used.select("old"), "old", "left_anti").withColumn("n", F.lit(1).cast("bigint"))
    return written(sorted_index(written(used.unionByName(unused), "used-ids"), "old", "new"), "reduced")


def reduction(mapping: DataFrame, full_size: int) -> DataFrame:
    return mapping.agg(
        F.count(F.lit(1)).alias("reduced_size"), (F.count(F.lit(1)) / full_size * 100).alias("percent"))


def without_ids(ids: str | Column, skipped: Sequence[int]) -> Column:
    """Ids without model specials; order and repeats of the others stay."""
    return F.filter(text.col(ids), lambda t: ~t.isin(list(skipped)))


def trimmed(ids: str | Column, start: int, stop: int) -> Column:
    """One leading start and one trailing stop removed."""
    ids = text.col(ids)
    first = F.when(F.get(ids, F.lit(0)) == start, 2).otherwise(1)
    rest = F.slice(ids, first, F.size(ids))
    return F.when(F.try_element_at(rest, F.lit(-1)) == stop, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
