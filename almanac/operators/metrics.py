"""Scores of generated reports: a score per row first, then the mean per run. Punctuation is removed before scoring."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators.index import lookup_join
from almanac.operators.training import SCORE_BLOCK, score_windows
from almanac.schema import NAN

CHUNK = 4096
#: Vectors of one side that are compared at once with a chunk of the other.
SLAB = 256
LCS_BITS = 62
#: Windows that a scorer with context gets at once.
WINDOW_BATCH = 1024


def _ngram_counts(left: str, right: str, orders: int) -> Column:
    """Clipped matches of the n-gram multisets of two token arrays: an array of (hits, left_n, right_n), one for every order from 1.

    Counted within the row, so neither n-grams nor tokens are shuffled, sorted or spilled; three numbers an order leave it.
    """
    def counts(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        from collections import Counter

        def grams(tokens, n):
            return Counter(tokens) if n == 1 else Counter(zip(*[tokens[i:] for i in range(n)]))

        out = []
        for i in range(len(lefts)):
            sides, found = [x[i].as_py() or [] for x in (lefts, rights)], []
            for n in range(1, orders + 1):
                l, r = (grams(t, n) for t in sides)
                found.append({"hits": (l & r).total(), "left_n": l.total(), "right_n": r.total()})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("hits", pa.int64()), ("left_n", pa.int64()), ("right_n", pa.int64())])))

    return F.arrow_udf(counts, "array<struct<hits:bigint,left_n:bigint,right_n:bigint>>")(F.col(left), F.col(right))


def _f1(hits: Column, left: Column, right: Column) -> Column:
    """Harmonic mean of hits/left and hits/right; 0 without a match."""
    return F.coalesce(F.try_divide(2 * hits, left + right), F.lit(0.0))


def common_length(df: DataFrame, row: str, left: str, right: str, bits: int = LCS_BITS) -> DataFrame:
    """(row, common): length of the longest common subsequence of two token arrays; rows without a common token are left out.

    Bit-parallel: bit j of a row of bits is 0 where the subsequence grows at token j of the right side, and one token of the left
    side moves the row on by ``(v + (v & m)) | (v & ~m)`` for the mask m of its places. The row is kept in blocks of ``bits`` bits
    with a carry between them; blocks are shorter than a long, so no sum overflows. Masks are partial aggregates over exploded
    tokens, the walk is one fold per row. Everything is partitioned by ``row``, which must be unique, and shuffled once.
    """
    whole = (1 << bits) - 1

    def tokens(name: str, side: int) -> Column:
        return F.transform(F.col(name), lambda t, i: F.struct(F.lit(side).alias("side"), t.alias("token"), i.alias("at")))

    flat = df.select(row, left, right).repartition(row).select(
        row, F.ceil(F.size(right) / bits).cast("int").alias("_blocks"), F.inline(F.concat(tokens(left, 0), tokens(right, 1))))
    on_right = F.col("side") == 1
    bit = F.expr(f"shiftleft(1L, at % {bits})")
    masks = flat.groupBy(row, "_blocks", "token", "side", F.when(on_right, F.floor(F.col("at") / bits)).otherwise(-1).cast("int").alias("block")).agg(
        F.bit_or(F.when(on_right, bit)).alias("mask"), F.collect_list(F.when(~on_right, F.col("at"))).alias("at"))
    words = masks.groupBy(row, "_blocks", "token").agg(
        F.flatten(F.collect_list("at")).alias("at"), F.sort_array(F.collect_list(F.when(on_right, F.struct("block", "mask")))).alias("masks"))

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0).cast("long"), n.cast("int"))

    met = F.aggregate("masks", F.array().cast("array<long>"), lambda a, m: F.concat(a, zeros(m["block"] - F.size(a)), F.array(m["mask"])))
    dense = F.concat(met, zeros(F.col("_blocks") - F.size(met)))
    steps = words.filter("size(at) > 0 and size(masks) > 0").select(row, "_blocks", dense.alias("masks"), F.explode("at").alias("at"))
    walk = steps.groupBy(row, "_blocks").agg(F.sort_array(F.collect_list(F.struct("at", "masks"))).alias("steps"))

    def moved(held: Column, step: Column) -> Column:
        """All blocks after one token; the carry goes from block to block."""
        start = F.struct(F.array().cast("array<long>").alias("row"), F.lit(0).cast("long").alias("carry"))

        def block(done: Column, pair: Column) -> Column:
            v, m = pair["v"], pair["m"]
            total = v + v.bitwiseAND(m) + done["carry"]
            kept = total.bitwiseAND(F.lit(whole)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
            return F.struct(F.concat(done["row"], F.array(kept)).alias("row"), F.shiftright(total, bits).alias("carry"))

        return F.aggregate(F.zip_with(held, step["masks"], lambda v, m: F.struct(v.alias("v"), m.alias("m"))), start, block, lambda a: a["row"])

    ones = F.array_repeat(F.lit(whole).cast("long"), F.col("_blocks"))
    grown = F.aggregate("steps", ones, moved, lambda v: F.aggregate(v, F.lit(0), lambda n, x: n + bits - F.bit_count(x)))
    return walk.select(row, grown.cast("long").alias("common"))


def _tokenized(df: DataFrame, key: str, prediction: str, label: str, tokens: Callable[[Column], Column]) -> DataFrame:
    return df.select(
        key, tokens(text.remove_punctuation(prediction)).alias("_p"), tokens(text.remove_punctuation(label)).alias("_l"))


def rouge_ngrams(df: DataFrame, key: str, prediction: str, label: str, letters: str = "a-z0-9") -> DataFrame:
    """(key, rouge_1, rouge_2): F1 of the unigram and bigram multisets."""
    pairs = _tokenized(df, key, prediction, label, lambda c: text.rouge_tokens(c, letters))
    counted = pairs.select(key, _ngram_counts("_p", "_l", 2).alias("_c"))

    def score(n: int) -> Column:
        at = F.get("_c", F.lit(n - 1))
        return _f1(at["hits"], at["left_n"], at["right_n"])

    return counted.select(key, *[score(n).alias(f"rouge_{n}") for n in (1, 2)])


def rouge_l(df: DataFrame, key: str, prediction: str, label: str, letters: str = "a-z0-9") -> DataFrame:
    """(key, rouge_l): F1 of the longest common subsequence, one row per distinct (key, prediction, label) and copy of it."""
    def tokens_of(c: str, letters: str) -> Column:
        return text.rouge_tokens(text.remove_punctuation(c), letters)

    rows = df.groupBy(key, F.col(prediction).alias("_p"), F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumns({"_row": F.sha2(F.to_json(F.struct(key, "_p", "_l")), 256), "_p": tokens_of("_p", letters), "_l": tokens_of("_l", letters)})
    lengths = common_length(rows, "_row", "_p", "_l")
    score = _f1(F.coalesce("common", F.lit(0)), F.size(F.coalesce("_p", F.array())), F.size(F.coalesce("_l", F.array())))
    return rows.join(lengths, "_row", "left").select(key, score.alias("rouge_l"), F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("col")


def bleu(df: DataFrame, key: str, prediction: str, label: str, orders: int = 4) -> DataFrame:
    """(key, bleu): unsmoothed BLEU with brevity penalty; 0 when some order has no match or a text is empty."""
    pairs = _tokenized(df, key, prediction, label, text.bleu_tokens)
    counted = pairs.select(key, _ngram_counts("_p", "_l", orders).alias("_c"))
    first = F.get("_c", F.lit(0))
    logs = F.aggregate("_c", F.lit(0.0), lambda a, c: a + F.ln(c["hits"] / c["left_n"]))
    penalty = F.when(first["left_n"] > first["right_n"], 1.0).otherwise(F.exp(1 - F.try_divide(first["right_n"], first["left_n"])))
    return counted.select(key, F.when(F.forall("_c", lambda c: c["hits"] > 0), penalty * F.exp(logs / orders)).otherwise(0.0).alias("bleu"))


def dealt(vectors: DataFrame, pair: str, side: str, position: str, vector: str, chunk: int) -> DataFrame:
    """The vectors of pairs that have both sides, with the number of chunks of either side and the vector's own ``_chunk``."""
    rows = vectors.select(pair, side, position, vector)
    sizes = rows.groupBy(pair).agg(*[F.ceil(F.count_if(F.col(side) == s) / chunk).cast("int").alias(f"_n{s}") for s in (0, 1)])
    sized = lookup_join(rows, sizes.filter("_n0 > 0 and _n1 > 0"), pair, "inner").filter(F.col(side).isin(0, 1))
    own = F.when(F.col(side) == 0, F.col("_n0")).otherwise(F.col("_n1"))
    return sized.withColumn("_chunk", F.pmod(F.xxhash64(position), own).cast("int"))


def greedy_match(vectors: DataFrame, pair: str, side: str, position: str, vector: str, chunk: int = CHUNK) -> DataFrame:
    """(pair, precision, recall, f1) of greedy cosine matching; side 0 is the prediction, side 1 the label.

    Each side of a pair is dealt into as many chunks as keep them near ``chunk`` vectors, by a hash of the position, so chunks are full
    however far apart the positions lie. One task sees one chunk of each side; a very long pair is thereby spread out, and only
    the best match of every token leaves a task. A vector travels once for every chunk of the other side.
    """
    sized = dealt(vectors, pair, side, position, vector, chunk)
    opposite = F.when(F.col(side) == 0, F.col("_n1")).otherwise(F.col("_n0"))
    met = sized.withColumn("_met", F.explode(F.sequence(F.lit(0), opposite - 1)))
    met = met.select(
        pair, side, position, vector,
        F.when(F.col(side) == 0, F.col("_chunk")).otherwise(F.col("_met")).alias("_c0"),
        F.when(F.col(side) == 0, F.col("_met")).otherwise(F.col("_chunk")).alias("_c1"))

    slab = SLAB

    def best(part: pa.Table) -> pa.Table:
        sides, unit, top = part[side].to_numpy(), [], []
        for s in (0, 1):
            held = part[vector].filter(pa.array(sides == s)).combine_chunks()
            m = held.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(held), -1) if len(held) else np.zeros((0, 0))
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            unit.append(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
        found = np.full(len(sides), np.nan)
        if len(unit[0]) and len(unit[1]):
            right = np.full(len(unit[1]), -np.inf)
            for at in range(0, len(unit[0]), slab):
                sims = unit[0][at:at + slab] @ unit[1].T
                top.append(sims.max(axis=1))
                right = np.maximum(right, sims.max(axis=0))
            found[sides == 0], found[sides == 1] = np.concatenate(top), right
            kept = part
        else:
            kept, found = part.slice(0, 0), found[:0]
        return kept.select([pair, side, position]).append_column("best", pa.array(found, pa.float64()))

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    found = met.groupBy(pair, "_c0", "_c1").applyInArrow(
        best, f"{pair} {types[pair]}, {side} {types[side]}, {position} {types[position]}, best double")
    tokens = found.groupBy(pair, side, position).agg(F.max("best").alias("best"))
    scores = tokens.groupBy(pair).agg(
        F.avg(F.when(F.col(side) == 0, F.col("best"))).alias("precision"),
        F.avg(F.when(F.col(side) == 1, F.col("best"))).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def has_city(prediction: str | Column) -> Column:
    return text.remove_punctuation(prediction).contains(text.CITY).cast("int")


def city_rate(df: DataFrame, run: str, prediction: str) -> DataFrame:
    return df.groupBy(run).agg(F.avg(has_city(prediction)).alias("accuracy"))


def temperature_accuracy(df: DataFrame, run: str, prediction: str, series: str) -> DataFrame:
    """Share of all integers in the predictions of a run that are texts of their series; NULL when there are none."""
    said = text.numbers(text.remove_punctuation(prediction))
    right = F.size(F.filter(said, lambda t: F.array_contains(F.col(series), t)))
    return df.groupBy(run).agg(F.try_divide(F.sum(right), F.sum(F.size(said))).alias("accuracy"))


def range_score(prediction: str | Column, series: str | Column) -> Column:
    """Share of the predicted temperature interval that lies in the interval of the series; closed integer intervals."""
    said = F.transform(text.numbers(text.remove_punctuation(prediction)), lambda t: t.try_cast("bigint"))
    known = F.transform(
        F.filter(text.col(series), lambda t: ~t.isin("<missing>", NAN)), lambda t: t.try_cast("bigint"))
    low, high = F.array_min(said), F.array_max(said)
    common = F.least(F.array_max(known), high) - F.greatest(F.array_min(known), low) + 1
    score = F.greatest(common, F.lit(0)) / (high - low + 1)
    return F.when((F.size(said) == 0) | (F.size(known) == 0), 0.0).otherwise(score)


def temperature_range(df: DataFrame, run: str, prediction: str, series: str) -> DataFrame:
    return df.groupBy(run).agg(F.avg(range_score(prediction, series)).alias("mean_score"))


def window_score(df: DataFrame, run: str, key: str, ids: str, scorer: Callable[[Column], Column], block: int = SCORE_BLOCK) -> DataFrame:
    """Mean over a run's records of the mean score of their windows. ``scorer`` is the plug-in, e.g. a ``pandas_udf``."""
    windows = score_windows(df.select(run, key, ids), ids, block)
    per_record = windows.select(run, key, scorer(F.col("window")).alias("_s")).groupBy(run, key).agg(F.avg("_s").alias("_s"))
    return per_record.groupBy(run).agg(F.avg("_s").alias("mean_score"))


def context_window_score(
    df: DataFrame, run: str, key: str, ids: str, context: str, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = SCORE_BLOCK,
) -> DataFrame:
    """(run, mean_score): mean over a run's records of the mean score of their windows, each scored beside the record's context.

    ``scorer(context, windows)`` is the plug-in: it gets the context ids of one record once and a (windows, block) matrix of
    ids, at most ``WINDOW_BATCH`` rows at a time, and returns a score per window. A record shorter than a block is one window of
    its length, a null context is empty; a score that is NaN counts for nothing, and a record without any score is left out.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = []
            for own, beside in zip(batch.column(2), batch.column(3)):
                own, beside = (np.array(x.as_py() or [], np.int64) for x in (own, beside))
                windows = np.lib.stride_tricks.sliding_window_view(own, block) if len(own) >= block else own[None]
                found = np.concatenate([np.asarray(scorer(beside, windows[a:a + WINDOW_BATCH]), np.float64) for a in range(0, len(windows), WINDOW_BATCH)])
                found = found[~np.isnan(found)]
                means.append(float(found.mean()) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(means, pa.float64())], names=[run, key, "score"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(run, key, F.col(ids).cast("array<long>"), F.col(context).cast("array<long>"))
    scored = rows.mapInArrow(score, f"`{run}` {types[run]}, `{key}` {types[key]}, score double")
    return scored.groupBy(run).agg(F.avg("score").alias("mean_score"))


def per_run(scores: DataFrame, run: str, *names: str) -> DataFrame:
    """Means of the named figures over the pairs of every run."""
    return scores.groupBy(run).agg(*[F.avg(n).alias(n) for n in names])


def metric_rows(metrics: dict[str, DataFrame], run: str) -> DataFrame:
    """(run, metric, name, value): one row per figure of the chosen metrics, each a frame with one row per run."""
    out = None
    for metric, frame in metrics.items():
        names = [c for c in frame.columns if c != run]
        figures = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
        rows = frame.select(run, F.lit(metric).alias("metric"), F.inline(figures))
        out = rows if out is None else out.unionByName(rows)
    return out


def metric_report(rows: DataFrame, run: str) -> DataFrame:
    """(run, report): ``{metric: {name: value}}`` as JSON. A run has a handful of figures."""
    inner = rows.groupBy(run, "metric").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("figures"))
    nested = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("metric"), F.map_entries("figures").alias("e")))))
    return inner.groupBy(run).agg(
        F.to_json(F.transform_values(nested, lambda _, e: F.map_from_entries(e))).alias("report"))


def cross_entropy(df: DataFrame, run: str, label: str, probability: str, pad: int) -> DataFrame:
    """Mean negative log probability of the target tokens; padding does not count."""
    kept = df.filter(F.col(label) != pad)
    loss = F.when(F.col(probability) > 0, -F.ln(probability)).otherwise(float("inf"))
    return kept.groupBy(run).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"))


def log_loss(df: DataFrame, run: str, label: str, probability: str) -> DataFrame:
    """Mean binary cross-entropy; logarithms are floored at -100."""
    def log(p: Column) -> Column:
        return F.when(p > 0, F.greatest(F.ln(p), F.lit(-100.0))).otherwise(-100.0)

    p, y = F.col(probability), F.col(label)
    loss = -(y * log(p) + (1 - y) * log(1 - p))
    return df.groupBy(run).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"))
