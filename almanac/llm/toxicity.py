"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text, by one rule: both hold the words that are common in
both classes, and each goes on with the words and beginnings of words that documents of its own class hold significantly more
often. A text is cut into windows of ``WINDOW`` words; each is compressed with either dictionary, and the bytes that the toxic one
saves, or costs, against the ordinary one tell toxic windows. The document's score is a logistic function of the shares of its
windows that save at least 1, 2, ... bytes and of the largest saving, calibrated on labelled documents that took no part in the
dictionaries; 0.7 is the threshold of a prediction.

Training uses a bounded sample: ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` labelled rows of the learning part (those with the
smallest hash of the id), of at most ``SAMPLE_CHARS`` characters each. The calibrated log odds are then shifted by
those of all labels of the learning part less those of the calibration rows, so that the score does not depend on how much of a
class the sample holds. Scoring reads whole texts in Arrow batches.

Defined results: null and empty texts are scored like any text without a toxic window; when the sample lacks one of the classes
every score is 0; of several labels for one document the largest counts; rows without id are scored and none of them is held out;
repeated rows are scored each, copies teach once; very long texts are scored window by window, whole, and never teach;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, learning_part, read

WINDOW = 8
SAMPLE_TOXIC = 2000
SAMPLE_ORDINARY = 3000
SAMPLE_CHARS = 20_000
COMMON_WORDS = 400
SEGMENTS = 200
LEAST_BYTES, MOST_BYTES = 4, 12
#: A toxic segment is held by more toxic than ordinary documents: by this share of them, and by so many standard errors.
LEAST_EXCESS = 0.01
LEAST_ERRORS = 5.0
SAVINGS = (1, 2, 3, 4, 5, 6)
THRESHOLD = 0.7
#: Stands before every window and at the end of both dictionaries. zstandard stores a window as it is when it saves too little; the
#: lead always saves enough, so every byte that the window saves is counted.
LEAD = bytes(range(1, 32)) + bytes(range(1, 32, 2))
WORD = re.compile(rb"[^\x00-\x20!-/:-@\[-`{-~]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, without ASCII punctuation."""
    return WORD.findall((text or "").lower().encode("utf-8", "replace"))


def windows(words: list[bytes]) -> list[bytes]:
    return [LEAD + b" " + b" ".join(words[i:i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def beginnings(words: list[bytes]) -> set[bytes]:
    """What a dictionary may hold of the words: each with the blanks around it, and its first bytes with the blank before."""
    return {b" " + w + b" " for w in words} | {b" " + w[:n] for w in set(words) for n in range(LEAST_BYTES, min(len(w), MOST_BYTES) + 1)}


def telling(own: list[set[bytes]], other: list[set[bytes]], base: bytes) -> list[bytes]:
    """Segments that the documents of one class hold more often than those of the other, by ``LEAST_EXCESS`` of them and by
    ``LEAST_ERRORS`` standard errors; the most useful last, since the last bytes of a dictionary are the nearest to the window."""
    n = len(own), len(other)
    held = [Counter(x for segments in side for x in segments) for side in (own, other)]
    worth = []
    for segment, times in held[0].items():
        excess = times / n[0] - held[1][segment] / n[1]
        both = (times + held[1][segment]) / sum(n)
        error = (both * (1 - both) * (1 / n[0] + 1 / n[1])) ** 0.5
        if excess >= LEAST_EXCESS and excess >= LEAST_ERRORS * error and segment not in base:
            worth.append((excess * len(segment), segment))
    chosen: list[bytes] = []
    for _, segment in sorted(worth, reverse=True):
        if len(chosen) < SEGMENTS and not any(segment.startswith(x) or x.startswith(segment) for x in chosen):
            chosen.append(segment)
    return chosen[::-1]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary from the words of sample documents, each trained on its own class by the same
    rule: the words that are commonest in both classes together (both weigh the same), then what tells the class from the other."""
    sides = ordinary, toxic
    shares = [Counter(w for words in side for w in set(words)) for side in sides]
    common = {w: min(shares[0][w] / len(ordinary), shares[1][w] / len(toxic)) for w in shares[0].keys() & shares[1].keys()}
    base = b" " + b" ".join(sorted(sorted(common, key=lambda w: (-common[w], w))[:COMMON_WORDS], key=lambda w: (common[w], w))) + b" "
    segments = [[beginnings(words) for words in side] for side in sides]
    return tuple(base + b"".join(telling(segments[i], segments[1 - i], base)) + b" " for i in (0, 1))


@dataclass
class Toxicity:
    """Dictionary contents and calibrated weights; without weights nothing was learned."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None

    def meter(self):
        """Function from the words of a text to its features."""
        import zstandard

        def compressor(content: bytes):
            params = zstandard.ZstdCompressionParameters(
                window_log=15, chain_log=12, hash_log=12, search_log=3, min_match=4, target_length=0,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
            held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress

        plain, other = compressor(self.ordinary), compressor(self.toxic)

        def features(words: list[bytes]) -> list[float]:
            saved = [len(plain(w)) - len(other(w)) for w in windows(words)]
            count = Counter(saved)
            n = max(1, len(saved))
            shares = [sum(c for v, c in count.items() if v >= least) / n for least in SAVINGS]
            most = max(saved, default=0)
            return [1.0, *(s ** 0.5 for s in shares), min(most, 12) / 4, max(0, most - 3) / 4 / (1 + np.log1p(n))]

        return features

    def scorer(self):
        if self.weights is None:
            return lambda text: 0.0
        features = self.meter()
        return lambda text: float(1 / (1 + np.exp(-np.clip(np.dot(features(words_of(text)), self.weights), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def without_copies(rows: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Sample rows without (near) copies of earlier ones, which would make any of their words look telling: copies share the
    smallest of their hashed four-word shingles under one of three orders."""
    seen, kept = set(), []
    for words, mark in rows:
        codes = np.array([zlib.crc32(b" ".join(words[i:i + 4])) for i in range(max(1, len(words) - 3))], np.uint64)
        least = {(k, int((codes * np.uint64(odd) % np.uint64(1 << 32)).min())) for k, odd in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        if not least & seen:
            kept.append((words, mark))
        seen |= least
    return kept


def train(sample: list[tuple[str, int]], labelled: dict[int, int] | None = None) -> Toxicity:
    """Fit on (text, toxic) rows: two of three for the dictionaries, the third to calibrate. ``labelled`` has the numbers of labels 0
    and 1 that the rows were drawn from, the rows' own if there is none."""
    rows = without_copies([(words_of(text), toxic) for text, toxic in sorted(sample)])
    dictionary, rest = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    sides = [[words for words, toxic in dictionary if toxic == y] for y in (1, 0)]
    labels = np.array([float(toxic) for _, toxic in rest])
    if not all(sides) or len(set(labels.tolist())) < 2:
        return Toxicity()
    model = Toxicity(*train_dictionaries(*sides))
    features = model.meter()
    model.weights = logistic(np.array([features(words) for words, _ in rest]), labels)
    every = labelled or Counter(toxic for _, toxic in sample)
    model.weights[0] += np.log(every[1] / every[0]) - np.log(labels.sum() / (len(labels) - labels.sum()))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Train on a bounded sample of the documents that carry a label."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).alias("mark"))
    sides = [marked.filter(F.col("mark") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    chosen = F.broadcast(sides[0].union(sides[1]))  # at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    labelled = {r["mark"]: r["n"] for r in marked.filter(F.col("mark").isin(0, 1)).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    return train([(r["text"], r["mark"]) for r in texts.join(chosen, "id").select("text", "mark").collect()], labelled)


def scored(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in batches:
            found = [rate(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(score, "doc long, score double")


@BOOK.add("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = scored(docs, fit(docs, labels.filter(learning_part(F.col("doc_id"), 3) != 1)))
    held = F.coalesce(learning_part(F.col("doc"), 3) == 1, F.lit(False))
    return found.select(F.col("doc").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
