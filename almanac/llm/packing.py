"""Operator 4: pack token sequences by shortest-pack-first over the length histogram.

1. Tokenise every document once and cut it into pieces: whole sequences of ``LENGTH`` tokens and the remainder. The cut needs
   nothing but the document, so only (doc, start, length, checksum) leave the task, no ids.
2. Count the pieces per length. This histogram has at most ``LENGTH`` rows at any input size; the driver places its lengths,
   longest first, each into the packs with the most room, and counts *patterns*: the same mix of lengths, so many times.
3. Rank the pieces of each length and join the patterns back by (length, rank). A frequent length is ranked in many buckets.

At most one group of packs is split and one is opened per length, so there are at most 2 * LENGTH patterns; lengths that
differ and add up to 2048 are at most 63, so the slot table has a proven bound of 2 * 2048 * 63 rows (12 MB) and is broadcast.

Defined results: a null or empty text is one piece holding the end id; rows without id are kept; repeated rows are packed
each; very long texts and words are encoded whole and kept by no store; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read
from almanac.storage import written

LENGTH = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
BUCKET_PIECES = 50_000
#: Bytes of words and ids that a Python worker keeps at hand, counted with what Python needs per word; only speed depends on it.
KNOWN_BYTES = 150 << 20
WORD_OVERHEAD = 180
LONG_WORD = 64
#: Signs that the tokenizer cuts from the letters before them.
SIGNS = ".,;:!?"
#: Characters of text that are encoded together.
PORTION = 1 << 18
#: New words that are encoded as one text; the tokenizer needs more time a word in longer texts.
RUN = 50
PIECES = "doc long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer cuts text before the space of a word, so the words between single spaces can be encoded apart, and words
    seen before are looked up. A text with two spaces in a row or a special token's string is encoded as it stands, and so is every
    text if a tokenizer cuts otherwise. The store of words is bounded by bytes and holds no long words; these are encoded whenever
    they come.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The tokenizer takes U+180E for white space, Python does not.
        self.special = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), "\u180e"]
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        # Ids of words with a space before them: those met lately, and the store before; ids of runs of signs.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.size = 0
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ab.,\nThe x") if self.tokenizer.pre_tokenizer else []
        self.cuts_words = [at for _, at in cut] == [(0, 3), (3, 5), (5, 6), (6, 9), (9, 11)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str], space: str) -> list[bytes]:
        """Ids of words with ``space`` (one or none) before each, some at a time, with line feeds between them: a line feed is cut off
        on both sides and has an id of its own."""
        import numpy as np

        out = []
        runs = [space + ("\n" + space).join(words[i:i + RUN]) for i in range(0, len(words), RUN)]
        for run in runs:
            flat, at = self._plain([run])[0], 0
            ids = np.frombuffer(flat, "<u4")
            for end in [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]:
                out.append(flat[4 * at:4 * end])
                at = end + 1
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not at hand. Signs at the end of a word of letters are cut off by the tokenizer anyway and put on
        again, and so are two words with a line feed between them; others that hold white space are encoded alone. Those that are
        not long are kept, but no pairs, which seldom come back."""
        found: dict[str, bytes] = {}
        signed, plain, alone, single, pairs = [], set(), [], [], []
        for word in words:
            parts = word.split()
            if parts == [word]:
                single.append(word)
            elif len(parts) == 2 and "\n".join(parts) == word:
                pairs.append((word, *parts))
            else:
                alone.append(word)
        for word in {*single, *(first for _, first, _ in pairs if first not in self.known)}:
            stem = word.rstrip(SIGNS)
            if len(stem) < len(word) and stem.isalpha():
                signed.append((word, stem))
                if stem not in self.known:
                    plain.add(stem)
            else:
                plain.add(word)
        listed = sorted(plain)
        found.update(zip(listed, self._apart(listed, " ")))
        found.update(zip(alone, self._plain([" " + w for w in alone])))
        ends = {word[len(stem):] for word, stem in signed}.difference(self.ends)
        if ends:
            self.ends.update(zip(sorted(ends), self._plain(sorted(ends))))
        for word, stem in signed:
            found[word] = (found[stem] if stem in found else self.known[stem]) + self.ends[word[len(stem):]]
        self._keep(found)
        listed = sorted({second for _, _, second in pairs})
        seconds = dict(zip(listed, self._apart(listed, "")))
        feed = self.feed.to_bytes(4, "little")
        for word, first, second in pairs:
            found[word] = (found[first] if first in found else self.known[first]) + feed + seconds[second]
        if len(self.ends) > 1000:
            self.ends.clear()
        return found

    def _keep(self, found: dict[str, bytes]) -> None:
        """Keep words; a full store becomes the older one, of which what is asked for again comes back."""
        known, size = self.known, 0
        for word, ids in found.items():
            if len(word) <= LONG_WORD:
                known[word] = ids
                size += len(word) + len(ids) + WORD_OVERHEAD
        self.size += size

    def _missing(self, words: set[str]) -> dict[str, bytes]:
        if self.size > KNOWN_BYTES // 2:
            self.older, self.known, self.size = self.known, {}, 0
        found = {word: self.older[word] for word in words if word in self.older}
        self._keep(found)
        new = words.difference(found)
        return {**found, **self._learn(new)} if new else found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, which share what is encoded anew."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, text in enumerate(texts) if not self.cuts_words or "  " in text or any(s in text for s in self.special)]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
            out[i] = ids
        apart = sorted(set(range(len(texts))).difference(whole))
        split = [texts[i].split(" ") for i in apart]
        heads = self._plain([words[0] for words in split])
        rows, gaps, new = [], [], set()
        for n, words in enumerate(split):
            row = list(map(self.known.get, words))
            row[0] = heads[n]
            at = -1
            for _ in range(row.count(None)):
                at = row.index(None, at + 1)
                gaps.append((n, at))
                new.add(words[at])
            rows.append(row)
        learned = self._missing(new) if new else {}
        for n, at in gaps:
            rows[n][at] = learned[split[n][at]]
        for i, row in zip(apart, rows):
            out[i] = b"".join(row)
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept for its later tasks in a module of its own: functions come anew with every task."""
    import sys
    import types

    kept = sys.modules.setdefault("_almanac_encoders", types.ModuleType("_almanac_encoders"))
    if path not in vars(kept):
        setattr(kept, path, Encoder(path))
    return vars(kept)[path]


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``PORTION`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens): every document with its end id, cut into pieces of at most ``length``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode = encoder(public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            encoded = (ids for texts in portions([text or "" for text in batch.column(1).to_pylist()]) for ids in encode(texts))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                for at in range(0, len(ids), 4 * length):
                    part = ids[at:at + 4 * length]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Shortest-pack-first: (number of packs, ((piece length, pieces per pack), ...)) that use up the histogram."""
    room: dict[int, list[tuple[int, tuple]]] = {}  # free tokens -> groups of equal packs
    free: list[int] = []

    def put(left: int, group: tuple[int, tuple]) -> None:
        if left not in room:
            room[left] = []
            insort(free, left)
        room[left].append(group)

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            if not free or free[-1] < size:
                put(length - size, (n, ((size, 1),)))
                break
            left = free[-1]
            count, pattern = room[left].pop()
            if not room[left]:
                del room[left]
                free.pop()
            used = min(n, count)
            if used < count:
                put(left, (count - used, pattern))
            grown = (*pattern[:-1], (size, pattern[-1][1] + 1)) if pattern[-1][0] == size else (*pattern, (size, 1))
            put(left - size, (used, grown))
            n -= used
    return [group for left in sorted(room) for group in room[left]]


def slots(packs: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces per pack, first sequence, offset): which ranks of a length a pattern
    takes, and where they lie."""
    rows, ranks, sequence = [], {}, 0
    for count, pattern in packs:
        offset = 0
        for size, copies in pattern:
            first = ranks.get(size, 0)
            ranks[size] = first + count * copies
            rows.append((size, first, ranks[size], copies, sequence, offset))
            offset += size * copies
        sequence += count
    return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, tokenizer, length, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row per length: at most ``length`` rows.
    shares = spark.createDataFrame(
        [(size, -(-n // BUCKET_PIECES)) for size, n in sorted(histogram.items())], "length long, buckets long")
    dealt = cut.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64("doc", "start"), F.col("buckets")))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("ahead") + F.col("inside") - 1))
    table = spark.createDataFrame(
        slots(patterns(histogram, length)), "length long, first long, after long, copies long, sequence long, place long")
    placed = ranked.join(F.broadcast(table), "length").filter("rank >= first and rank < after")
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"))


@BOOK.add("op4_pack_sequences")
def op4_pack_sequences(spark, sf_dir):
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.withColumnRenamed("doc", "doc_id")
