"""Operator 1: language identification for code-switched text by a linear-chain conditional random field.

Every word is a position of the chain, every learned language a state. Emissions come from hashed byte n-grams of the word with
its borders (those at a border are its affixes) and from a lexicon of whole words; transitions are learned with them. Training
runs on the driver over a bounded sample (``SAMPLE_ROWS`` distinct labelled texts per language, of at most ``SAMPLE_CHARS`` characters each,
from which ``SEQUENCES`` chains of ``CHAIN`` words are cut, switching language on the way); labelling runs in Arrow batches over
whole texts. Forward-backward is exact: a text is cut into blocks, each block becomes one transfer matrix, the matrices are
chained, and the messages are filled in inside all blocks at once.

A document's language is the one with most posterior mass over its words; the score is its share of that mass.

Defined results: null, empty and letterless texts give ``und`` with score 0, as does every text when nothing could be learned;
ties go to the first language in code point order; rows without id are kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, learning_part, read

SAMPLE_ROWS = 200
SAMPLE_CHARS = 20_000
SEQUENCES = 3000
CHAIN = 32
RUN_WORDS = 10
ROUNDS = 20
LEXICON_COUNT = 3
TABLE_BITS = 18
ORDERS = (2, 3, 4, 5)
#: Texts are labelled in portions of about so many bytes.
PORTION = 1 << 18
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """The words of the text: lower case, letters and their marks only, one blank between words; empty without a letter.
    Runs that hold a digit (keys, codes) are no words, unless there is nothing else."""
    lower = F.lower(text)
    coded = F.regexp_replace(lower, r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}]*+\p{N}[\p{L}\p{M}\p{N}]*+", " ")
    words, rest = (F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}]+", " ")) for t in (coded, lower))
    return F.when(words.rlike(r"\p{L}"), words).when(rest.rlike(r"\p{L}"), rest).otherwise(F.lit(""))


def mixed(codes: np.ndarray) -> np.ndarray:
    """Scramble 64-bit codes so that any of their bits can serve as an index."""
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


@dataclass
class Words:
    """Features of all words of some texts: per n-gram order and byte the table row (the last row, always zero, where no n-gram
    starts), the first byte of each word and its whole-word code."""

    rows: list[np.ndarray]
    first: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Words:
        """``texts`` are non-empty and have single blanks between their words."""
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        n = len(data)
        blank = data == 32
        starts = np.flatnonzero(blank)
        seen = np.cumsum(blank)
        wide = data.astype(np.uint64) + np.uint64(1)
        rows = []
        for order in ORDERS:
            code = np.full(n - order + 1, order, np.uint64)
            for i in range(order):
                code = code * np.uint64(0x100000001B3) + wide[i:n - order + 1 + i]
            index = (mixed(code) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            inner = seen[order - 2:n - 1] - seen[:n - order + 1]  # blanks inside the n-gram, its ends left out
            whole = np.full(n, 1 << TABLE_BITS, np.int32)
            whole[:n - order + 1] = np.where(inner == 0, index, 1 << TABLE_BITS)
            rows.append(whole)
        first = starts[:-1]
        step = np.arange(n) - first[np.minimum(seen - 1, len(first) - 1)]
        power = np.cumprod(np.full(int(step.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        return Words(rows, first, mixed(np.add.reduceat(np.where(blank, np.uint64(0), wide * power[step]), first)))

    def __len__(self) -> int:
        return len(self.first)


@dataclass
class Crf:
    """Learned weights: n-gram table, lexicon (sorted word codes and their rows), transitions and first state."""

    langs: list[str]
    table: np.ndarray
    lexicon: np.ndarray
    lexicon_rows: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def lexicon_at(self, words: Words) -> np.ndarray:
        """Row of the lexicon for each word; the last row, always zero, for words not in it."""
        if not len(self.lexicon):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, words.codes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == words.codes, at, len(self.lexicon))

    def emissions(self, words: Words) -> np.ndarray:
        total = self.table[words.rows[0]]
        for rows in words.rows[1:]:
            total += self.table[rows]
        return (np.add.reduceat(total, words.first, axis=0) + self.lexicon_rows[self.lexicon_at(words)]).astype(np.float64)

    def posteriors(self, words: Words, lengths: np.ndarray) -> np.ndarray:
        """P(language | text) of every word; ``lengths`` are the word counts of the texts, none of them 0."""
        emitted = np.exp(np.clip((e := self.emissions(words)) - e.max(axis=1, keepdims=True), -60, 0))
        blocks = -(-lengths // CHAIN)
        text = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * CHAIN
        size = np.minimum(CHAIN, lengths[text] - nth * CHAIN)
        inside = np.arange(CHAIN) < size[:, None]
        at = np.minimum(begin[:, None] + np.arange(CHAIN), len(emitted) - 1)
        local = emitted[at]
        go, start = np.exp(self.moves), np.exp(self.start)
        transfer = np.einsum("bi,ij->bij", local[:, 0], np.eye(len(go)))
        for t in range(1, CHAIN):
            grown = (transfer @ go) * local[:, t, None, :]
            grown /= grown.max(axis=(1, 2), keepdims=True)
            transfer = np.where(inside[:, t, None, None], grown, transfer)
        left, right = np.empty((len(text), len(go))), np.empty((len(text), len(go)))
        head = np.cumsum(blocks) - blocks
        left[head], right[head + blocks - 1] = start, 1.0
        for j in range(1, int(blocks.max())):
            b = head[blocks > j] + j
            left[b] = scaled(np.einsum("bi,bij->bj", left[b - 1], transfer[b - 1]) @ go)
            b = (head + blocks - 1 - j)[blocks > j]
            right[b] = scaled(np.einsum("bij,bj->bi", transfer[b + 1], right[b + 1]) @ go.T)
        forward, backward = messages(left, right, local, inside, go)
        post = scaled((forward * backward)[inside], total=True)
        return post


def scaled(v: np.ndarray, total: bool = False) -> np.ndarray:
    return v / (v.sum(axis=-1, keepdims=True) if total else v.max(axis=-1, keepdims=True))


def messages(left: np.ndarray, right: np.ndarray, local: np.ndarray, inside: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the position's own emission) and backward messages inside blocks, from what enters at their ends."""
    forward, backward = np.empty_like(local), np.empty_like(local)
    into = left
    for t in range(local.shape[1]):
        forward[:, t] = scaled(into * local[:, t])
        into = forward[:, t] @ go
    into = right
    for t in range(local.shape[1] - 1, -1, -1):
        backward[:, t] = into
        into = np.where(inside[:, t, None], scaled((into * local[:, t]) @ go.T), into)
    return forward, backward


def train(samples: dict[str, list[str]], seed: int = 7) -> Crf:
    """Fit the field on texts (as ``letters`` gives them) per language, by gradient ascent on the likelihood of chains that
    switch between runs of words of different languages."""
    langs = sorted(lang for lang, texts in samples.items() if any(texts))
    rng = np.random.default_rng(seed)
    runs = {lang: [w for text in samples[lang] for w in text.split(" ") if w] for lang in langs}
    words, truth = [], []
    for _ in range(SEQUENCES if langs else 0):
        chain: list[tuple[str, int]] = []
        while len(chain) < CHAIN:
            lang = int(rng.integers(len(langs)))
            source = runs[langs[lang]]
            at = int(rng.integers(len(source)))
            chain += [(w, lang) for w in source[at:at + int(rng.geometric(1 / RUN_WORDS))]]
        words += [w for w, _ in chain[:CHAIN]]
        truth += [y for _, y in chain[:CHAIN]]
    s = len(langs)
    if not langs:
        return Crf([], np.zeros((1, 0)), np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    features = Words.of([" ".join(words).encode()])
    codes, counts = np.unique(features.codes, return_counts=True)
    lexicon = codes[counts >= LEXICON_COUNT]
    model = Crf(langs, np.zeros(((1 << TABLE_BITS) + 1, s), np.float32), lexicon, np.zeros((len(lexicon) + 1, s), np.float32),
                np.zeros((s, s)), np.zeros(s))
    owner = np.repeat(np.arange(len(features)), np.diff(np.append(features.first, len(features.rows[0]))))
    target = np.eye(s)[np.array(truth)]
    spots = np.concatenate(features.rows)
    owners = np.tile(owner, len(features.rows))[spots < 1 << TABLE_BITS]
    known, place = np.unique(spots[spots < 1 << TABLE_BITS], return_inverse=True)
    lex = model.lexicon_at(features)
    params = [model.table, model.lexicon_rows, model.moves, model.start]
    power = [np.full(p.shape, 1e-8) for p in params]
    shape = (SEQUENCES, CHAIN, s)
    for _ in range(ROUNDS):
        e = model.emissions(features)
        local = np.exp(np.clip(e - e.max(axis=1, keepdims=True), -60, 0)).reshape(shape)
        go = np.exp(model.moves)
        ends = np.broadcast_to(np.exp(model.start), (SEQUENCES, s)), np.ones((SEQUENCES, s))
        forward, backward = messages(*ends, local, np.ones(shape[:2], bool), go)
        post = scaled(forward * backward, total=True)
        pair = forward[:, :-1, :, None] * go * (local * backward)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        hit = target.reshape(shape)
        miss = target - post.reshape(-1, s)
        table = np.zeros(model.table.shape)
        rows = np.zeros(model.lexicon_rows.shape)
        for y in range(s):
            table[known, y] = np.bincount(place, miss[owners, y], len(known))
            rows[:, y] = np.bincount(lex, miss[:, y], len(rows))
        rows[-1] = 0
        moves = np.einsum("bti,btj->ij", hit[:, :-1], hit[:, 1:]) - pair.sum(axis=(0, 1))
        start = (hit[:, 0] - post[:, 0]).sum(axis=0)
        for p, g, h in zip(params, (table, rows, moves, start), power):
            h += g * g
            p += (0.3 * g / np.sqrt(h)).astype(p.dtype)
    return model


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Train on a bounded sample of the labelled texts: per language those with the smallest hash, copies taken once."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("order"))
    # Copies have one hash, so the sample is drawn from distinct hashes; two texts of one hash would count as one.
    keys = rows.select("lang", "order").groupBy("lang", "order").agg(F.count(F.lit(1)).alias("copies"))
    first = Window.partitionBy("lang").orderBy("order")
    chosen = keys.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE_ROWS).select("lang", "order", "n")
    sample = rows.join(F.broadcast(chosen), ["lang", "order"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "n").select("lang", letters(F.col("text")).alias("words")).collect():
        texts.setdefault(row["lang"], []).append(row["words"])
    return train(texts)


def label_texts(model: Crf, texts: list[bytes]) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, runs of words in one language) of each text, worked on in portions of bounded size."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size * max(1, len(model.langs)) >= 4 * PORTION:
            yield from _label_portion(model, part)
            part, size = [], 0
    yield from _label_portion(model, part)


def _label_portion(model: Crf, texts: list[bytes]) -> Iterator[tuple[str, float, list[dict]]]:
    kept = [t for t in texts if t and model.langs]
    if kept:
        lengths = np.array([t.count(b" ") + 1 for t in kept])
        post = model.posteriors(Words.of(kept), lengths)
        ends = np.cumsum(lengths)
        share = np.add.reduceat(post, ends - lengths, axis=0) / lengths[:, None]
        best, word_best = share.argmax(axis=1), post.argmax(axis=1)
    k = 0
    for text in texts:
        if not text or not model.langs:
            yield UNKNOWN, 0.0, []
            continue
        own = word_best[ends[k] - lengths[k]:ends[k]]
        cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        spans = [{"lang": model.langs[own[a]], "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:])]
        yield model.langs[best[k]], min(1.0, float(share[k, best[k]])), spans
        k += 1


def labelled(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score, spans) of every row; ``spans`` are the runs of words in one language: (lang, words)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        for batch in batches:
            found = list(label_texts(model, batch.column(1).cast(pa.binary()).to_pylist()))
            lang, score, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                names=["doc", "lang_pred", "score", "spans"])

    words = F.coalesce(letters(F.col(text_col)), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), words.alias("words")).mapInArrow(
        label, "doc long, lang_pred string, score double, spans array<struct<lang:string,words:long>>")


def recognised(docs: DataFrame, model: Crf, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has letters and, if any language was learned, one with at least a share of ``least``."""

    @F.pandas_udf("boolean")
    def fits(words: pd.Series) -> pd.Series:
        texts = [w.encode() for w in words]
        if not model.langs:
            return pd.Series([bool(t) for t in texts])
        return pd.Series([lang != UNKNOWN and score >= least for lang, score, _ in label_texts(model, texts)], dtype=bool)

    columns = [f"`{c}`" for c in docs.columns]
    words = F.coalesce(letters(F.col(text_col)), F.lit(""))
    return docs.select(F.struct(*columns).alias("row"), words.alias("words")).filter(fits("words")).select("row.*")


@BOOK.add("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    fold = learning_part(F.col("doc_id"), 4)
    found = labelled(docs, fit(docs.filter(fold != 2)))
    held = F.coalesce(learning_part(F.col("doc"), 4) == 2, F.lit(False))
    return found.select(F.col("doc").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
