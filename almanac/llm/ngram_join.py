"""Operator 2: exact Jaccard self-join of word-shingle sets by PartEnum signatures, and the components of its links.

*Signatures.* Sets are put into size bands so narrow that similar sets lie in the same or in neighbouring bands. In band i two
such sets differ in at most k elements. The domain (shingle hashes) is cut into n1 ranges and each of these into n2 parts;
k < 2 * n1, so some range holds at most one difference, and of its subsets of n2 - 1 parts one is equal in both sets. Every set
emits a hash of each such subset, for its own band and the next. n1 is chosen larger than needed, so that at least 2c + 1 subsets
agree; each set then leaves out its 2c lightest ones (by elements, then hash), and the heaviest agreeing one is still
emitted by both. This keeps out the subsets that share little or nothing and would bring unrelated sets together.

*Candidates.* Signatures travel packed by bucket. Sets that share one are linked to the smallest (a star), the stars are
verified (after a look at parity sketches: the differing bits are at most as many as the differing shingles), and the links give first
components. Only groups that still hold sets of several components are looked at again, in tiles of bounded size inside tasks. A
tile names the pairs from different components whose sketches allow a link; where these are more than its members, it names itself
instead and is compared in full: by counting over postings of its shingles, exactly, and of the links found only those that join two
components leave the task. So no link between different components is lost, and no tile returns more rows than it has members,
however many pairs just miss the threshold.

*Skew.* Equal sets of one batch are one set before anything travels, sets that share a signature within a batch send it
once, equal sets meet by digest with partial aggregates, stars are joins of written tables, groups come in tiles bounded by
members and bytes.

Defined results: a text with fewer words than a shingle is one shingle; null texts and texts without words have the empty set and
are linked with nothing; rows without id take no part; rows repeated with one id are one document (its size is that of the
smallest set, should they differ), but ``drop_near_copies`` names every row by id and text and so takes rows without id and rows of one
id with different texts each for themselves; very long texts are whole sets like others; an empty table gives an empty result; other
columns are not read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read
from almanac.llm.exact_dedup import keep_rows
from almanac.llm.graph import components
from almanac.storage import written

WORDS = 4
PERCENT = 85
#: Members and bytes of shingles on one side of a tile; tiles of few members are dealt to tasks by the portion.
TILE = 1024
TILE_BYTES = 8 << 20
FEW_MEMBERS = 64
TILE_KEY = ["code", "kind", "i", "j"]
TASK_BYTES = 8 << 20
BUCKET_SIGNATURES = 400_000
SIGNATURES_PER_SHINGLE = 0.45
PORTION = 1 << 20
#: Bytes of text whose signatures are sent together.
SLICE = 8 << 20


def mixed(codes: np.ndarray) -> np.ndarray:
    """Scramble 64-bit codes."""
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z are lowered; words end at 0x20 and 0x09-0x0D."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    fold = mixed(fold + np.uint64(1))
    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = gap[data]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge = np.searchsorted(starts, ends)
    if len(starts):
        step = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff([0, *starts, len(data)]))
        power = np.cumprod(np.full(int(step.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        codes = mixed(np.add.reduceat(np.where(blank, np.uint64(0), fold[data] * power[step]), starts))
        factors = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        padded = np.concatenate([codes, np.zeros(words - 1, np.uint64)])
        full = mixed(sum(padded[i:i + len(codes)] * factors[i] for i in range(words)))
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a >= words:
            yield np.unique(full[a:b - words + 1])
        elif b > a:
            yield mixed((codes[a:b] * factors[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


class PartEnum:
    """Size bands and the layout of the domain in each of them, for a similarity of ``percent`` in a hundred."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.tops, self.layouts = percent, [], {}
        low = 1
        while low < 1 << 40:
            self.tops.append(low * 100 // percent)  # largest size of the band
            low = self.tops[-1] + 1

    def layout(self, band: int) -> tuple[int, int, np.ndarray] | None:
        """(parts per range n2, lightest subsets left out, inner borders of the parts); None where only equal sets link.

        100 * I >= p * U means at most (s + t)(100 - p) / (100 + p) differences; both sizes are at most the band's largest."""
        if band not in self.layouts:
            k = 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)
            spare = (k + 1) // 8
            n1, n2 = k // 2 + 1 + spare, 3 if k < 8 else 2
            borders = np.array([(j << 64) // (n1 * n2) for j in range(1, n1 * n2)], np.uint64)
            self.layouts[band] = (n2, 2 * spare, borders) if k else None
        return self.layouts[band]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Signatures of a non-empty sorted set, for its band and the next."""
        own = int(np.searchsorted(self.tops, len(shingles)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles), dtype=np.uint64)])
        found = [np.zeros(0, np.uint64)]
        for band in (own, own + 1):
            if not (shape := self.layout(band)):
                continue
            n2, light, borders = shape
            at = np.concatenate([[0], np.searchsorted(shingles, borders), [len(shingles)]])
            weight, content = np.diff(at).reshape(-1, n2), np.diff(sums[at]).reshape(-1, n2)
            # Subsets of n2 - 1 parts: the range without each of its parts in turn.
            weight = (weight.sum(axis=1, keepdims=True) - weight).ravel()
            content = (content.sum(axis=1, keepdims=True, dtype=np.uint64) - content).ravel()
            codes = mixed(content ^ mixed(np.arange(len(content), dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40))))
            if light:
                order = (np.minimum(weight, 1 << 20).astype(np.uint64) << np.uint64(43)) | (codes >> np.uint64(21))
                codes = codes[np.argpartition(order, light)[light:]]
            found.append(codes)
        return np.concatenate(found)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits of a set: how many of its elements fall on each of a power of two of bits, at least eight per element, modulo 2.
    Every element in which two sets differ changes one bit, so the bits that differ are at most as many."""
    bits = 64
    while bits < 8 * len(shingles):
        bits *= 2
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def possible(sketches: np.ndarray, sizes: np.ndarray, other: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
    """Which sets of equally wide sketches (one per row) may be similar to one set with a sketch as wide or wider."""
    narrow = np.bitwise_xor.reduce(other.reshape(-1, sketches.shape[1]), axis=0)
    differ = np.bitwise_count(sketches ^ narrow).sum(axis=1, dtype=np.int64)
    near = 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
    return near & (differ * (100 + percent) <= (sizes + size) * (100 - percent))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            ids.append(doc)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= PORTION:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``SLICE`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=0))
    for a, b in zip([0, *cut], [*cut, len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


def _digests(docs: DataFrame, words: int) -> DataFrame:
    """(doc, n, digest) of the set of every document."""

    def build(batches):
        import hashlib

        for ids, texts in _portions(batches):
            sets = list(shingle_sets(texts, words))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())],
                                             names=["doc", "n", "digest"])

    return docs.mapInArrow(build, "doc long, n long, digest binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc, content, sketch) of every document: its shingle hashes and their parity bits."""

    def build(batches):
        for ids, texts in _portions(batches):
            sets = list(shingle_sets(texts, words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())],
                names=["doc", "content", "sketch"])

    return docs.mapInArrow(build, "doc long, content binary, sketch binary")


def _packed_signatures(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Signatures of all documents, packed by bucket: codes, owners and how many sets an owner stands for. Three and more sets that
    share a signature within one batch send it for the smallest of them only; the others follow as (chain, low, high), dealt by
    set and not by signature."""

    def build(batches):
        import hashlib

        scheme = PartEnum(percent)
        for batch in (part for whole in batches for part in _slices(whole)):
            codes, owners, seen = [], [], set()
            rows = ((doc, s) for ids, texts in _portions(iter([batch])) for doc, s in zip(ids, shingle_sets(texts, words)))
            for doc, s in rows:
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and digest not in seen:
                    seen.add(digest)
                    codes.append(scheme.signatures(s))
                    owners.append(np.full(len(codes[-1]), doc, np.int64))
            if not sum(map(len, codes)):
                continue
            code, owner = np.concatenate(codes), np.concatenate(owners)
            order = np.lexsort((owner, code))
            first = np.concatenate([[True], code[order][1:] != code[order][:-1]])
            run = np.cumsum(first) - 1
            many = (np.bincount(run) > 2)[run]
            low = owner[order][np.flatnonzero(first)[run]]
            chained = many & ~first
            chain = (code[order][chained], low[chained], owner[order][chained])
            stands = np.ones(len(code), np.uint8)
            stands[order[many & first]] = 3
            sent = np.sort(order[~chained])
            code, owner, stands = code[sent], owner[sent], stands[sent]
            to = (code % np.uint64(buckets)).astype(np.int64)
            to_chain = (mixed(chain[0] ^ chain[2].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by, by_chain = np.argsort(to, kind="stable"), np.argsort(to_chain, kind="stable")
            at, at_chain = (np.searchsorted(t[o], np.arange(buckets + 1)) for t, o in ((to, by), (to_chain, by_chain)))
            out = []
            for b in range(buckets):
                x, y = by[at[b]:at[b + 1]], by_chain[at_chain[b]:at_chain[b + 1]]
                if len(x) or len(y):
                    out.append((b, *(c[x].tobytes() for c in (code, owner, stands)), *(c[y].tobytes() for c in chain)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in range(1, 7))],
                names=["bucket", "codes", "owners", "stands", "chain", "low", "high"])

    return docs.mapInArrow(build, "bucket int, codes binary, owners binary, stands binary, chain binary, low binary, high binary")


def _meetings(packed: DataFrame) -> DataFrame:
    """(low, member): sets that share a signature with a smaller one; and (code, member): those that share one with two others or
    more."""

    def meet(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        code, owner, stands = column("codes", np.uint64), column("owners", np.int64), column("stands", np.uint8)
        order = np.lexsort((owner, code))
        code, owner, stands = code[order], owner[order], stands[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])[:len(code)]
        run = np.cumsum(first) - 1
        low = owner[np.flatnonzero(first)[run]] if len(run) else owner
        many = (np.bincount(run, stands.astype(np.float64)) > 2)[run] & (np.bincount(run) > 1)[run] if len(run) else first
        chain, below, above = column("chain", np.uint64), column("low", np.int64), column("high", np.int64)
        pairs = np.unique(np.stack([np.concatenate([low[~first], below]), np.concatenate([owner[~first], above])]), axis=1)
        group = np.concatenate([code[many], chain, chain]).view(np.int64)
        member = np.concatenate([owner[many], above, below])
        return pa.table({"code": pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(group)]),
                         "member": np.concatenate([pairs[1], member]),
                         "low": pa.concat_arrays([pa.array(pairs[0]), pa.nulls(len(group), pa.int64())])})

    return packed.groupBy("bucket").applyInArrow(meet, "code long, member long, low long")


def _with(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (low, member, low_n, member_n) with the bytes of both sets as ``own`` and ``its``. Plain joins of written tables:
    a centre with a large share of all pairs is a skewed side that adaptive execution splits."""
    its = sets.select(F.col("doc").alias("member"), F.col(column).alias("its"))
    own = sets.select(F.col("doc").alias("low"), F.col(column).alias("own"))
    return pairs.join(its, "member").join(own, "low")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links: those whose sketches allow it, compared in full."""

    @F.pandas_udf("boolean")
    def may_hold(own: pd.Series, its: pd.Series, low_n: pd.Series, member_n: pd.Series) -> pd.Series:
        held = []
        for a, b, n, m in zip(own, its, low_n, member_n):
            (narrow, size), (wide, other) = sorted(((a, n), (b, m)), key=lambda x: len(x[0]))
            x, y = np.frombuffer(narrow, np.uint8), np.frombuffer(wide, np.uint8)
            held.append(bool(possible(x[None], np.array([size]), y, other, percent)[0]))
        return pd.Series(held, dtype=bool)

    @F.pandas_udf("boolean")
    def is_link(own: pd.Series, its: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(own, its)], dtype=bool)

    names = ["low", "member", "low_n", "member_n"]
    near = written(_with(pairs, sets, "sketch").filter(may_hold("own", "its", "low_n", "member_n")).select(*names), "near-pairs")
    return written(_with(near, sets, "content").filter(is_link("own", "its")).select(*names), "links-found")


def tile_forest(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (low, high) between the sets of a tile that join different components, as few as there are components less one.
    Exact: the shingles that a set shares with each other set are counted over the postings of the tile."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    held, at = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    _, part = np.unique(roots, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for y in range(len(sets)):
        if (part == part[y]).all():
            continue
        mine = code[starts[y]:starts[y + 1]]
        length = at[mine + 1] - at[mine]
        place = np.repeat(at[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(held[place], minlength=len(sets))
        linked = np.flatnonzero((100 * both >= percent * (sizes + sizes[y] - both)) & (part != part[y]))
        for x in linked:
            if part[x] != part[y]:
                found.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                part[part == part[x]] = part[y]
    return found


def _tiles(groups: DataFrame) -> DataFrame:
    """(code, member, n, root, members, kind, i, j): the rows of the tiles of the groups (code, member, n, root; main, main_blocks,
    rest_blocks, members). The members of a group's largest component meet the rest, block by block, but not each other; the rest
    meet among themselves too."""
    main = F.col("root") == F.col("main")
    block = F.pmod(F.xxhash64("member"), F.when(main, F.col("main_blocks")).otherwise(F.col("rest_blocks")))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    def tile(kind: str, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    b = F.col("block")
    with_main = F.transform(upto("main_blocks"), lambda k: tile("main", b, k))
    with_rest = F.transform(upto("rest_blocks"), lambda j: tile("rest", F.least(b, j), F.greatest(b, j)))
    tiles = F.when(main, F.transform(upto("rest_blocks"), lambda i: tile("main", i, b))).otherwise(F.concat(with_main, with_rest))
    rows = groups.withColumn("block", block).select("code", "member", "n", "root", "members", F.explode(tiles).alias("t"))
    return rows.select("*", "t.*").drop("t")


def _by_tile(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each tile, in the order of the members."""
    table = table.sort_by([(c, "ascending") for c in (*TILE_KEY, "member")])
    key = [table[c].to_pylist() for c in TILE_KEY]
    start = 0
    for end in range(1, len(table) + 1):
        if end == len(table) or any(k[end] != k[start] for k in key):
            yield table.slice(start, end - start)
            start = end


def tile_pairs(ids: np.ndarray, sizes: np.ndarray, roots: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]] | None:
    """Index pairs of a tile that lie in different components and whose sketches allow a link; None if they are more than the tile has
    members."""
    widths = np.array([len(s) for s in sketches])
    bits = {w: np.stack([np.frombuffer(s, np.uint8) for s in sketches if len(s) == w]) for w in np.unique(widths)}
    found = []
    for y in range(len(ids)):
        own = np.frombuffer(sketches[y], np.uint8)
        for width in (widths[y], widths[y] // 2):
            if width in bits:
                at = np.flatnonzero(widths == width)
                fits = possible(bits[width], sizes[at], own, sizes[y], percent) & (roots[at] != roots[y])
                if width == widths[y]:
                    fits &= ids[at] < ids[y]
                found += [(x, y) for x in at[fits]]
        if len(found) > len(ids):
            return None
    return found


def _candidates(tiles: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Of each tile either the pairs (low, member, low_n, member_n) that may be links or, where these would be more than its members, one
    row with its name: such a tile is compared in full. Tiles of small groups are dealt over ``tasks`` groups of rows."""
    rows = tiles.join(sets.select(F.col("doc").alias("member"), "sketch"), "member")
    numbers = ["low", "member", "low_n", "member_n"]
    schema = pa.schema([(c, pa.int64()) for c in numbers] + [("code", pa.int64()), ("kind", pa.string()), ("i", pa.int64()), ("j", pa.int64())])

    def compare(batch: pa.Table) -> pa.Table:
        pairs, dense = [np.zeros((4, 0), np.int64)], [batch.select(TILE_KEY).slice(0, 0)]
        for tile in _by_tile(batch):
            ids, sizes, roots = (tile[c].to_numpy() for c in ("member", "n", "root"))
            found = tile_pairs(ids, sizes, roots, tile["sketch"].to_pylist(), percent)
            if found is None:
                dense.append(tile.select(TILE_KEY).slice(0, 1))
            elif found:
                x, y = np.array(found).T
                x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
                pairs.append(np.stack([ids[x], ids[y], sizes[x], sizes[y]]))
        pairs, dense = np.concatenate(pairs, axis=1), pa.concat_tables(dense)
        none = [pa.nulls(len(dense), pa.int64())] * 4
        named = pa.table([*none, *(dense[c] for c in TILE_KEY)], schema=schema)
        plain = pa.table([*(pa.array(c) for c in pairs), *(pa.nulls(pairs.shape[1], schema.field(c).type) for c in TILE_KEY)], schema=schema)
        return pa.concat_tables([plain, named])

    where = F.xxhash64(*TILE_KEY)
    dealt = rows.groupBy(F.when(F.col("members") > FEW_MEMBERS, where).otherwise(F.pmod(where, F.lit(tasks))))
    return dealt.applyInArrow(compare, "low long, member long, low_n long, member_n long, code long, kind string, i long, j long")


def _tile_links(tiles: DataFrame, dense: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(low, member) that join different components in the dense tiles, each tile compared in full in one task."""
    rows = tiles.join(dense, TILE_KEY).join(sets.select(F.col("doc").alias("member"), "content"), "member")

    def compare(tile: pa.Table) -> pa.Table:
        found = tile_forest(tile["member"].to_numpy(), tile["root"].to_numpy(), [np.frombuffer(c, np.uint64) for c in tile["content"].to_pylist()], percent)
        return pa.table({"low": pa.array([a for a, _ in found], pa.int64()), "member": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy(*TILE_KEY).applyInArrow(compare, "low long, member long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(doc, n, rep, root) of every document: size of its set, smallest document with an equal set, smallest document reachable
    by links (Jaccard similarity of at least ``percent`` in a hundred)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    rows = _digests(texts, words).groupBy("doc").agg(F.min(F.struct("n", "digest")).alias("s"))
    sized = written(rows.select("doc", "s.n", "s.digest"), "set-digests")
    total = sized.agg(F.sum("n")).first()[0] or 0
    equal = written(sized.filter("n > 0").groupBy("digest").agg(F.min("doc").alias("rep")), "equal-sets")
    named = written(sized.join(equal, "digest", "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "set-names")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * SIGNATURES_PER_SHINGLE / BUCKET_SIGNATURES) + 1)
    met = written(_meetings(_packed_signatures(texts, words, percent, buckets)), "meetings")
    name = {c: named.select(F.col("doc").alias(c), F.col("rep").alias(f"{c}_rep"), F.col("n").alias(f"{c}_n")) for c in ("member", "low")}
    pairs = met.filter("low is not null").select("low", "member").distinct().join(name["member"], "member").join(name["low"], "low")
    swap = F.col("low_rep") > F.col("member_rep")
    pairs = pairs.select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (
        ("low_rep", "member_rep", "low"), ("member_rep", "low_rep", "member"), ("low_n", "member_n", "low_n"), ("member_n", "low_n", "member_n"))])
    pairs = written(pairs.filter(f"low != member and 100 * least(low_n, member_n) >= {percent} * greatest(low_n, member_n)").distinct(), "stars")
    # Groups of the same members are one group, named by them.
    groups = met.filter("code is not null").join(name["member"], "member").select(
        "code", F.col("member_rep").alias("member"), F.col("member_n").alias("n")).distinct()
    groups = written(groups, "groups")

    wanted = pairs.select(F.explode(F.array("low", "member")).alias("doc")).union(groups.select("member")).distinct()
    sets = written(_sets(texts.join(wanted, "doc", "left_semi"), words), "shared-sets")
    links = _links(pairs, sets, percent)
    roots = components(links.select(F.col("low").alias("a"), F.col("member").alias("b")))

    rooted = written(groups.join(roots.withColumnRenamed("node", "member"), "member", "left").select(
        "code", "member", "n", F.coalesce("root", "member").alias("root")), "rooted")
    by_root = rooted.groupBy("code", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("member").cast("decimal(38,0)")).alias("same"))
    open_groups = by_root.groupBy("code").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members"), F.sum("shingles").alias("shingles"), F.sum("same").alias("same"),
        F.max(F.struct("n", "root", "shingles")).alias("main"))
    open_groups = open_groups.filter("roots > 1").dropDuplicates(["members", "same"])

    def blocks(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(members / TILE), F.ceil(8 * shingles / TILE_BYTES)).cast("long")

    open_groups = written(open_groups.select(
        "code", "members", "shingles", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.shingles")).alias("main_blocks"),
        blocks(F.col("members") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("rest_blocks")), "open-groups")
    small = open_groups.filter(F.col("members") <= FEW_MEMBERS).agg(F.sum("shingles")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * small / TASK_BYTES))  # a sketch takes one to two bytes a shingle
    tiles = _tiles(rooted.join(open_groups.drop("shingles"), "code"))
    near = written(_candidates(tiles, sets, percent, tasks), "tile-candidates")
    more = _links(near.filter("low is not null").select("low", "member", "low_n", "member_n").distinct(), sets, percent)
    dense = near.filter("low is null").select(*TILE_KEY)
    if not dense.isEmpty():
        more = more.select("low", "member").union(written(_tile_links(tiles, dense, sets, percent), "tile-links"))
    roots = components(links.select("low", "member").union(more.select("low", "member")).select(F.col("low").alias("a"), F.col("member").alias("b")))

    return named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc", "n", "rep", F.coalesce("root", "rep").alias("root"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every component the row with the smallest id stays (without any id, one of its rows), once.

    Rows are named by a hash of id and text, so rows of one id with different texts, and rows without id, are compared each for
    themselves. The names are checked against a second hash; should two rows share one, the next seed is taken."""
    parts = [F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    seed = 0
    while True:
        name = F.xxhash64(F.lit(seed), *parts)
        codes = docs.select(name.alias("name"), F.xxhash64(F.lit("check"), *parts).alias("code")).groupBy("name")
        if codes.agg(F.min("code").alias("a"), F.max("code").alias("b")).filter("a != b").isEmpty():
            break
        seed += 1
    named = docs.select(name.alias("name"), F.col(text_col).alias("text"))
    found = similar_components(named, "name", "text", words, percent)
    ids = docs.select(name.alias("doc"), parts[0].alias("id")).distinct()
    first = found.join(ids, "doc").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("first"))
    return keep_rows(docs, {"name": name}, first.select(F.col("first.doc").alias("name")))


@BOOK.add("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark, sf_dir):
    found = similar_components(read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
