"""Operator 11: grouping of spelling variants by k-d trees over letter-count vectors.

*Words.* Maximal runs of Latin letters are counted over whole texts, in tasks first; of a run that a checksum names, one letter is
deleted. Words of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences are kept.

*Trees.* A word is the vector of its letter counts, one dimension per code point from A-Z a-z and U+00C0 to U+00FF. One edit moves
it by at most two in L1: a replacement raises one count and lowers one, an insertion raises one. For every length there is a k-d
tree. Its upper part is built on the driver from a bounded sample of words (``SAMPLE_WORDS``, those with the smallest hash) and only
divides space; its leaves are cells of about ``CELL_WORDS`` words. A word goes to its own cell as a point and, as a query, to every
cell of its own and of the next length that its range meets: boxes are pruned when they lie more than one above or, for the own
length, more than one below (for the next length, any below). Within a cell a k-d tree over the distinct vectors goes on with
tight boxes; the words of two vectors in range are then compared letter by letter, many pairs at once.

*Bounds.* A cell with many points or queries is dealt in blocks of ``POINTS`` and ``QUERIES``, every block of points meeting every block of
queries in a task of its own, so no cell, however many anagrams it holds, must fit one task, and nothing is capped. A task
returns, for each word, how many near words it found and the best of them; pairs never leave it. Cells number at most a fixed share
of the sample, so what is sent to all tasks is bounded.

*Roots.* Forms have five times the occurrences of their word, so chains are short; they are followed by doubling, one join a round.

Defined results: null texts and texts without letters have no words; rows without id have words as they are, without deletion; repeated
rows count as often as they occur; ties of occurrences go to the word smaller in code-point order; a word without near words is its
own root; very long texts are read run by run and very long words compared like others; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, LOWER, UPPER, read
from almanac.storage import written

LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_TIMES = 5
#: Of the runs, those whose checksum this number divides lose a letter.
DELETE_ONE_IN = 199
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
SAMPLE_WORDS = 200_000
CELL_WORDS = 4096
LEAST_SAMPLE = 16
POINTS = 8192
QUERIES = 16_384
LEAF = 16
#: Words counted in a task before their counts are passed on.
HELD_WORDS = 200_000
#: Cells of (words, letters) or (pairs, letters) that are worked on at once.
CELLS = 4 << 20


def words_of(docs: DataFrame, id_col: str, text_col: str, least_letters: int) -> DataFrame:
    """(word, n) over all texts, counted."""
    fold = str.maketrans(UPPER, LOWER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile(f"[A-Za-zÀ-ÿ]{{{least_letters},}}")
        held: Counter = Counter()

        def counted():
            return pa.RecordBatch.from_pydict({"word": list(held), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                runs = Counter(m[0] for m in run.finditer(text.as_py() or ""))
                begun = zlib.crc32(f"{doc.as_py()}:".encode()) if doc.is_valid else None
                lower: Counter = Counter()
                for word, n in runs.items():
                    lower[word.lower() if word.isascii() else word.translate(fold)] += n
                for word, n in lower.items():
                    if begun is not None and (code := zlib.crc32(word.encode(), begun)) % DELETE_ONE_IN == 0:
                        at = code % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    plain = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return plain.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str]) -> np.ndarray:
    """(words, length) matrix of the code points of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(matrix: np.ndarray) -> np.ndarray:
    """Letter counts of the rows of a code-point matrix; counts beyond those of 16 bits stay at the largest."""
    place = np.zeros(256, np.int64)
    place[LETTERS] = np.arange(len(LETTERS))
    out = np.zeros((len(matrix), len(LETTERS)), np.int16)
    for at in range(0, len(matrix), max(1, CELLS // max(1, matrix.shape[1]))):
        part = matrix[at:at + max(1, CELLS // max(1, matrix.shape[1]))]
        cell = place[part] + np.arange(len(part))[:, None] * len(LETTERS)
        out[at:at + len(part)] = np.minimum(np.bincount(cell.ravel(), minlength=len(part) * len(LETTERS)), 32767).reshape(len(part), -1)
    return out


@dataclass
class Tree:
    """Nodes of a k-d tree: box bounds, children (-1 at a leaf) and, at leaves, the range of the ordered points."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray

    @staticmethod
    def build(points: np.ndarray, leaf: int, tight: bool) -> Tree:
        """Split the widest dimension (of the points in the node, the one of largest variance) at its median until nodes hold at most
        ``leaf`` points or equal ones. Boxes are those of the splits, or ``tight`` ones around the points."""
        order = np.arange(len(points))
        low, high, left, right, first, last = [], [], [], [], [], []

        def node(a: int, b: int, floor: np.ndarray, top: np.ndarray) -> int:
            low.append(points[order[a:b]].min(axis=0) if tight else floor)
            high.append(points[order[a:b]].max(axis=0) if tight else top)
            for column, value in ((left, -1), (right, -1), (first, a), (last, b)):
                column.append(value)
            return len(left) - 1

        wide = np.iinfo(np.int16)
        edges = np.full(points.shape[1], wide.min, np.int16), np.full(points.shape[1], wide.max, np.int16)
        todo = [node(0, len(points), *edges)] if len(points) else []
        while todo:
            i = todo.pop()
            a, b = first[i], last[i]
            if b - a <= leaf:
                continue
            own = points[order[a:b]]
            spread = own.var(axis=0)
            axis = int(spread.argmax())
            if spread[axis] == 0:
                continue
            # The last value that goes left: the median, or the one below it where all from the median on are equal.
            value = np.sort(own[:, axis])[(b - a - 1) // 2]
            if value == own[:, axis].max():
                value = own[own[:, axis] < value, axis].max()
            below = own[:, axis] <= value
            middle = a + int(below.sum())
            order[a:b] = np.concatenate([order[a:b][below], order[a:b][~below]])
            top, floor = high[i].copy(), low[i].copy()
            top[axis], floor[axis] = value, value + 1
            left[i], right[i] = node(a, middle, low[i], top), node(middle, b, floor, high[i])
            todo += [left[i], right[i]]
        shape = (len(left), points.shape[1])
        return Tree(np.array(low, np.int16).reshape(shape), np.array(high, np.int16).reshape(shape),
                    *(np.array(c, np.int64) for c in (left, right, first, last)), order)

    def search(self, queries: np.ndarray, fall: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf node) pairs whose box can be reached by raising counts by one at most in all and lowering them by ``fall`` at
        most. Queries go down together, some thousand at a time."""
        if not len(self.left):
            return
        portion = max(1, CELLS // (64 * queries.shape[1]))
        stack = [(np.arange(a, min(a + portion, len(queries))), np.zeros(min(portion, len(queries) - a), np.int64)) for a in range(0, len(queries), portion)]
        while stack:
            query, at = stack.pop()
            if len(query) > 2 * portion:
                half = len(query) // 2
                stack += [(query[:half], at[:half]), (query[half:], at[half:])]
                continue
            own = queries[query]
            inside = (np.maximum(self.low[at], own) - own).sum(axis=1) <= 1
            inside &= (own - np.minimum(self.high[at], own)).sum(axis=1) <= fall
            query, at = query[inside], at[inside]
            ends = self.left[at] < 0
            if ends.any():
                yield query[ends], at[ends]
            query, at = query[~ends], at[~ends]
            if len(query):
                stack.append((np.concatenate([query, query]), np.concatenate([self.left[at], self.right[at]])))


class Upper:
    """Upper parts of the trees of all lengths, with consecutive cell numbers."""

    def __init__(self, sample: list[str], counts: dict[int, int]):
        """``counts``: number of all words by length."""
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.trees, self.cells, total = {}, {}, 0
        for length, number in sorted(counts.items()):
            words = by_length.get(length, [])
            points = vectors(letters(words)) if words else np.zeros((0, len(LETTERS)), np.int16)
            leaf = max(LEAST_SAMPLE, len(words) * CELL_WORDS // max(1, number)) if number > CELL_WORDS else max(1, len(words))
            tree = Tree.build(points, leaf, tight=False) if len(points) else Tree.build(np.zeros((1, len(LETTERS)), np.int16), 1, tight=False)
            leaves = np.flatnonzero(tree.left < 0)
            number_of = np.full(len(tree.left), -1)
            number_of[leaves] = total + np.arange(len(leaves))
            total += len(leaves)
            self.trees[length], self.cells[length] = tree, number_of
        self.total = total

    def route(self, words: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(role, index of the word, cell) for words of one length. Roles: 0 point, 1 query for its own length, 2 for the next."""
        length = len(words[0])
        own = vectors(letters(words))
        out = []
        for role, target, fall in ((0, length, 0), (1, length, 1), (2, length + 1, 0)):
            if target not in self.trees:
                continue
            tree, number = self.trees[target], self.cells[target]
            if role == 0:
                at = np.zeros(len(own), np.int64)
                while (inner := self.trees[target].left[at] >= 0).any():
                    right = (own[inner] >= tree.low[tree.right[at[inner]]]).all(axis=1)
                    at[inner] = np.where(right, tree.right[at[inner]], tree.left[at[inner]])
                out.append((0, np.arange(len(own)), number[at]))
            else:
                out += [(role, query, number[leaf]) for query, leaf in tree.search(own, fall)]
        return out


def routed(words: DataFrame, upper: Upper) -> DataFrame:
    """(cell, role, word, n) of the words (word, n)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, n = pc.utf8_length(batch.column(0)).to_numpy(), batch.column(1).to_numpy()
            for size in np.unique(sizes):
                step = max(1, CELLS // (8 * max(int(size), len(LETTERS))))
                rows = np.flatnonzero(sizes == size)
                for a in range(0, len(rows), step):
                    own = rows[a:a + step]
                    for role, at, cell in upper.route(batch.column(0).take(pa.array(own)).to_pylist()):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell), pa.array(np.full(len(at), role, np.int32)), batch.column(0).take(pa.array(own[at])), pa.array(n[own[at]])],
                            names=["cell", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(deal, "cell long, role int, word string, n long")


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows in which two matrices of one shape differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``b``, one letter longer, that are ``a`` with one letter inserted: what agrees from the front and what agrees from the
    back cover ``a``."""
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def in_range(points: np.ndarray, queries: np.ndarray, fall: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) index pairs of rows whose vectors an edit may lead from one to the other. Equal vectors are searched once."""
    point_kinds, point_of = np.unique(points, axis=0, return_inverse=True)
    query_kinds, query_of = np.unique(queries, axis=0, return_inverse=True)
    tree = Tree.build(point_kinds, LEAF, tight=True)
    point_rows, query_rows = np.argsort(point_of.ravel(), kind="stable"), np.argsort(query_of.ravel(), kind="stable")
    point_at = np.concatenate([[0], np.cumsum(np.bincount(point_of.ravel(), minlength=len(point_kinds)))])
    query_at = np.concatenate([[0], np.cumsum(np.bincount(query_of.ravel(), minlength=len(query_kinds)))])
    clipped = bool(len(points)) and int(points.max()) == 32767
    for query, leaf in tree.search(query_kinds, fall):
        size = tree.last[leaf] - tree.first[leaf]
        pairs_q = np.repeat(query, size)
        pairs_p = tree.order[np.repeat(tree.first[leaf] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        step = max(1, CELLS // points.shape[1])
        for a in range(0, len(pairs_q), step):
            q, p = pairs_q[a:a + step], pairs_p[a:a + step]
            gap = point_kinds[p].astype(np.int32) - query_kinds[q]
            up, down = np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)
            fits = (up <= 1) & (down <= fall) & ((up == 1) & (down == fall) | clipped)
            q, p = q[fits], p[fits]
            # All words of two such vectors, in portions.
            nq, np_ = query_at[q + 1] - query_at[q], point_at[p + 1] - point_at[p]
            many = np.cumsum(nq * np_)
            start = 0
            while start < len(q):
                base = many[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(many, base + CELLS // 8, side="right")))
                size = (nq * np_)[start:stop]
                kind = np.repeat(np.arange(start, stop), size)
                for b in range(0, len(kind), CELLS):
                    k = kind[b:b + CELLS]
                    inner = np.arange(b, b + len(k)) - (many[k] - (nq * np_)[k] - base)
                    yield query_rows[query_at[q[k]] + inner // np_[k]], point_rows[point_at[p[k]] + inner % np_[k]]
                start = stop


def nearest(points: tuple[list[str], np.ndarray], queries: tuple[list[str], np.ndarray], role: int) -> list[dict]:
    """(word, near, best_n, best) columns: near words that a tile shows, for the queries and, towards the next length, the points
    too. Both sides have words of one length and their occurrences."""
    a, b = letters(queries[0]), letters(points[0])
    sides = [queries, points] if role == 2 else [queries]
    other = [points, queries]
    # Rank of a word as the best near word: most occurrences first, then code-point order.
    order = [np.lexsort((np.array(words), -n)) for words, n in other]
    rank = [np.argsort(o) for o in order]
    near = [np.zeros(len(n), np.int64) for _, n in sides]
    best = [np.full(len(n), np.iinfo(np.int64).max) for _, n in sides]
    step = max(1, CELLS // max(1, b.shape[1]))
    for q, p in in_range(vectors(b), vectors(a), 1 if role == 1 else 0):
        for at in range(0, len(q), step):
            x, y = q[at:at + step], p[at:at + step]
            hit = (one_replaced if role == 1 else one_inserted)(a[x], b[y])
            ends = (x[hit], y[hit])
            for i in range(len(sides)):
                near[i] += np.bincount(ends[i], minlength=len(near[i]))
                np.minimum.at(best[i], ends[i], rank[i][ends[1 - i]])
    out = []
    for i, (words, _) in enumerate(sides):
        found = np.flatnonzero(near[i])
        chosen = order[i][best[i][found]]
        out.append({"word": [words[k] for k in found], "near": near[i][found], "best_n": other[i][1][chosen], "best": [other[i][0][k] for k in chosen]})
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of the words (word, n) that have near words: how many, and the one with most occurrences. ``words`` should be
    a written table, as it is read three times."""
    spark = words.sparkSession
    counts = {r["size"]: r["words"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()}
    sample = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).select("word").collect()]
    upper = Upper(sample, counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // (4 * CELL_WORDS))
    dealt = written(routed(words.repartition(parts, "word"), upper), "cells")
    # One row per cell, and cells are bounded by the sample.
    sizes = dealt.groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)) / POINTS).alias("point_blocks"),
        *[F.ceil(F.sum(F.when(F.col("role") == r, 1).otherwise(0)) / QUERIES).alias(f"blocks_{r}") for r in (1, 2)])
    sized = dealt.join(F.broadcast(sizes.filter("point_blocks > 0")), "cell")
    code = F.xxhash64("word")

    def upto(n: str):
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    def tile(kind: int, p, q):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))

    def of_point(kind: int):
        met = F.transform(upto(f"blocks_{kind}"), lambda q: tile(kind, F.pmod(code, F.col("point_blocks")), q))
        return F.when(F.col(f"blocks_{kind}") > 0, met).otherwise(F.array().cast("array<struct<kind:int,p:bigint,q:bigint>>"))

    def of_query(kind: int):
        return F.transform(upto("point_blocks"), lambda p: tile(kind, p, F.pmod(code, F.col(f"blocks_{kind}"))))

    role = F.col("role")
    met = F.when(role == 0, F.concat(of_point(1), of_point(2))).when(role == 1, of_query(1)).otherwise(of_query(2))
    tiles = sized.select("cell", "role", "word", "n", F.explode(met).alias("t"))

    def compare(tile: pa.Table) -> pa.Table:
        kind, is_point = tile["kind"][0].as_py(), pc.equal(tile["role"], 0)
        points, queries = ((t["word"].to_pylist(), t["n"].to_numpy()) for t in (tile.filter(is_point), tile.filter(pc.invert(is_point))))
        schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
        found = nearest(points, queries, kind) if points[0] and queries[0] else []
        return pa.concat_tables([schema.empty_table(), *(pa.table(f, schema=schema) for f in found)])

    found = tiles.select("cell", "role", "word", "n", "t.*").groupBy("cell", "kind", "p", "q").applyInArrow(
        compare, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")).select(
        "word", "near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of the forms (word, form): the last word of the chain. Each round doubles the steps taken."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(state.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
                      least_count: int = LEAST_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """(word, n, near, form, form_n, root) of every word."""
    words = written(words_of(docs, id_col, text_col, least_letters).filter(F.col("n") >= least_count), "words")
    near = near_words(words)
    good = F.col("best_n") >= times * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).alias("near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))"
_BYTES = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))"


@BOOK.add("op11_spelling_variants", f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
coded AS (SELECT run, n, xor(4294967295, list_reduce({_BYTES}, lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT))) AS h FROM runs, tab),
spelt AS (SELECT CASE WHEN h % {DELETE_ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM coded),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cuts b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {FORM_TIMES} * w.n THEN top END AS form_n,
  (SELECT min(other) FROM near WHERE near.word = w.word AND near.n = top AND top >= {FORM_TIMES} * w.n) AS form FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, 0 AS step FROM words
  UNION ALL SELECT steps.word, form, step + 1 FROM steps JOIN forms ON forms.word = root WHERE form IS NOT NULL)
SELECT word, form, arg_max(root, step) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM forms JOIN steps USING (word) GROUP BY word, form""")
def op11_spelling_variants(spark, sf_dir):
    found = spelling_variants(read(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", F.col("near").alias("n_near"), "form_n")
