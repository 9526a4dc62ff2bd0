"""Operator 13: quality of documents by supervised subword embeddings.

Features of a text are its words and the character n-grams of each word with a blank on either side (so affixes differ from what
stands inside). Both are hashed to rows of one table of learned vectors. A document is the mean of the vectors of all its
features, a softmax layer on it gives the classes. Table and layer are learned by stochastic gradient descent in numpy, one
document a step, the rate falling to zero. Upper and lower case, punctuation and digits are kept: they are telling here.

Once learned, mean and layer are linear, so each row of the table is reduced to its one logit; scoring is a look-up and a mean in
Arrow batches. Texts are worked through whole, in pieces of bounded size that end at blanks.

Training uses a bounded sample: of each class the ``SAMPLE_TEXTS`` distinct texts of the learning part with the smallest hash, each
taught by its first ``SAMPLE_CHARS`` characters. One in ``HELD_BACK`` of them takes no part in the descent but calibrates the score:
slope and intercept of a logistic function, the intercept shifted by the log odds of all labels of the learning part less those of
the calibration texts, so the score does not depend on how much of a class the sample holds. 0.7 is the threshold of a prediction.

Defined results: null and empty texts and those of blanks only have no feature and get the score of the mean vector zero; when the
labels lack a class, every text gets the smoothed share of label 1, (n1 + 1) / (n + 2); of several labels for one document the
largest counts, labels other than 0 and 1 and rows of ``labels`` without id count for nothing; repeated rows are scored each, equal
texts alike, and teach once; rows without id are scored and none of them is held out; very long texts cost a piece's memory; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, learning_part, read
from almanac.storage import written

SAMPLE_TEXTS = 2000
SAMPLE_CHARS = 20_000
HELD_BACK = 4
TABLE_BITS = 17
ORDERS = (2, 3, 4)
DIMENSIONS = 12
EPOCHS = 8
RATE = 2.0
SEED = 13
#: Bytes of text that are turned into features at once.
PORTION = 1 << 20
THRESHOLD = 0.7
BLANKS = (32, 9, 10, 11, 12, 13)


def _blank_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[list(BLANKS)] = 32
    return fold


def features(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, place) arrays of the features of a text: the row of the table and the byte at which the feature stands. Words are runs
    between blanks; an n-gram may begin or end with a blank, but not both (that is a whole word, which is counted already), and has
    none inside."""
    text = _blank_table()[np.frombuffer(b" " + data + b" ", np.uint8)]
    n = len(text)
    blank = text == 32
    wide = text.astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - TABLE_BITS)
    found = []
    code = np.full(n, 0x811C9DC5, np.uint32)
    inside = np.zeros(n, bool)
    for order in range(1, max(ORDERS) + 1):
        length = n - order + 1
        if length <= 0:
            break
        code = code[:length] * np.uint32(0x01000193) ^ wide[order - 1:]
        if order > 2:  # the byte before the last has become an inner one
            inside = inside[:length] | blank[order - 2:n - 1]
        if order in ORDERS:
            place = np.flatnonzero(~(inside[:length] | (blank[:length] & blank[order - 1:])))
            found.append((((code[place] ^ (code[place] >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift).astype(np.int32), place))
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(starts):
        step = np.arange(n) - np.repeat(np.concatenate([[0], starts]), np.diff([0, *starts, n]))
        power = np.cumprod(np.full(int(step.max()) + 1, 0x9E3779B1, np.uint32), dtype=np.uint32)
        word = np.add.reduceat(np.where(blank, np.uint32(0), wide * power[step]), starts, dtype=np.uint32)
        found.append((((word ^ (word >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift).astype(np.int32), starts))
    return found


def pieces(text: bytes, limit: int = PORTION) -> Iterator[bytes]:
    """The text in pieces of at most ``limit`` bytes, cut at a blank where one is near the end."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(bytes([b]), at + limit // 2, at + limit) for b in BLANKS)
        cut = at + limit if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Quality:
    """One logit per row of the table, the logit of a text without features and the calibration; without a table every score is
    ``share``."""

    share: float = 0.5
    table: np.ndarray | None = None
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean logit of the features of each text, before calibration. Small texts go together."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))

        def add(held: list[tuple[int, bytes]]) -> None:
            ends = np.cumsum([len(t) + 1 for _, t in held])
            owner = np.array([i for i, _ in held])
            for rows, place in features(b" ".join(t for _, t in held)):
                cut = np.searchsorted(place, np.concatenate([[0], ends]))
                sums = np.concatenate([[0.0], np.cumsum(self.table[rows], dtype=np.float64)])
                np.add.at(total, owner, np.diff(sums[cut]))
                np.add.at(count, owner, np.diff(cut))

        held, size = [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text):
                if held and size + len(piece) > PORTION:
                    add(held)
                    held, size = [], 0
                held.append((i, piece))
                size += len(piece) + 1
        if held:
            add(held)
        return self.base + total / np.maximum(count, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias from bags (rows, their shares of the document) and labels 0 and 1, by stochastic gradient descent.
    Both classes weigh the same."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << TABLE_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rows, share = bags[i]
            rate = np.float32(1 - done / steps)
            done += 1
            near = vectors[rows]
            mean = share @ near
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max())
            slope = (odds / odds.sum()).astype(np.float32)
            slope[labels[i]] -= 1
            slope *= np.float32(weight[labels[i]]) * rate
            back = layer @ slope
            # The gradient of a row is its share of the document; a document has thousands of rows, hence the rate.
            vectors[rows] = near - np.float32(RATE) * share[:, None] * back
            layer -= np.outer(mean, slope)
            bias -= np.float32(0.1) * slope
    return vectors, layer, bias


def calibrated(logits: np.ndarray, labels: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic function that fits the labels best, by Newton steps."""
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(bend, x.T @ (p - labels) + ridge * w)
        w = w - np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def train(sample: list[tuple[str, int]], counts: tuple[int, int]) -> Quality:
    """Fit on (text, label) rows; ``counts`` are the numbers of labels 0 and 1 that the rows were drawn from."""
    share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
    rows = sorted((label, text) for text, label in sample)
    learn, held = [r for i, r in enumerate(rows) if i % HELD_BACK], [r for i, r in enumerate(rows) if not i % HELD_BACK]
    if any({label for label, _ in side} != {0, 1} for side in (learn, held)):
        return Quality(share)

    bags, labels = [], []
    for label, text in learn:
        found = features(text.encode("utf-8", "replace"))
        row, times = np.unique(np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int32), return_counts=True)
        if len(row):
            bags.append((row, (times / times.sum()).astype(np.float32)))
            labels.append(label)
    if len(set(labels)) < 2:
        return Quality(share)
    vectors, layer, bias = descend(bags, np.array(labels))
    lean = (layer[:, 1] - layer[:, 0]).astype(np.float64)
    model = Quality(share, (vectors @ lean).astype(np.float32), float(bias[1] - bias[0]))
    marks = np.array([float(label) for label, _ in held])
    model.slope, model.shift = calibrated(model.logits([text.encode("utf-8", "replace") for _, text in held]), marks)
    model.shift += float(np.log(counts[1] / counts[0]) - np.log(marks.sum() / (len(marks) - marks.sum())))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Quality:
    """Train on a bounded sample of the documents that carry a label. Of equal texts with one label only the one with the smallest
    id is looked at."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("mark")).filter(
        "id is not null and mark in (0, 1)").groupBy("id").agg(F.max("mark").alias("mark"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, SAMPLE_CHARS).alias("text"))
    hashed = written(texts.select("id", F.xxhash64("text").alias("code")).join(marked, "id"), "quality-marks")
    counts = {r["mark"]: r["n"] for r in hashed.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    distinct = hashed.groupBy("mark", "code").agg(F.min("id").alias("id"))
    sides = [distinct.filter(F.col("mark") == y).orderBy("code", "id").limit(SAMPLE_TEXTS) for y in (0, 1)]
    chosen = F.broadcast(sides[0].union(sides[1]).select("id", "code", "mark"))  # at most twice SAMPLE_TEXTS rows
    sample = texts.withColumn("code", F.xxhash64("text")).join(chosen, ["id", "code"]).select("text", "mark").distinct().collect()
    return train([(r["text"], r["mark"]) for r in sample], (counts.get(0, 0), counts.get(1, 0)))


def scored(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts), pa.float64())], names=["doc", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(score, "doc long, score double")


@BOOK.add("op13_quality_classifier")
def op13_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = scored(docs, fit(docs, labels.filter(learning_part(F.col("doc_id"), 4) != 2)))
    held = F.coalesce(learning_part(F.col("doc"), 4) == 2, F.lit(False))
    return found.select(F.col("doc").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
