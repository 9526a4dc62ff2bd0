"""Operator 10: exact duplicates by digest, kept in a cuckoo-filter index that supports insertion and deletion.

The digests are dealt over shards by their last bytes. A shard holds the *content* (one row per live digest: how many
documents carry it and which one stays) and a *cuckoo filter* of 16-bit fingerprints in buckets of four. A digest that the
filter does not know is new without a look at the content; a hit is verified against the content of its bucket. When an
insertion finds no room, the filter is built anew at twice the size from the stored digests. Both are tables in the shared
folder; an update writes new ones, so a lost task repeats itself on unchanged input.

Before a row travels it is summed with its copies per (digest, salt), so a digest that holds a third of all documents is at
most ``SALTS`` rows, and a shard holds about ``SHARD_DIGESTS`` digests at any input size.

Defined results: a null text counts as empty; in ``exact_groups`` a row without id cannot be named and takes no part, while
``drop_copies`` ranks it below every id, so that of equal texts without any id one stays; rows repeated with equal id and text are
one document; rows with one id and different texts are documents of their own; very long texts travel as digests until the rows that
stay are chosen; an empty table gives an empty result; other columns, whatever their names, are kept and not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, LOWER, UPPER, ascii_lower, read
from almanac.storage import written

SALTS = 8
SHARD_DIGESTS = 100_000
SLOTS = 4
KICKS = 500
#: Stands for a missing id among those that are compared.
NO_ID = -(1 << 63)
CONTENT = "shard int, digest binary, live long, keep long"
FILTER = "shard int, buckets long, slots binary"


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a digest has two possible buckets, each found from the other."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        import array

        self.buckets = buckets
        self.slots = array.array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))

    @staticmethod
    def for_keys(n: int) -> CuckooFilter:
        """A filter that is at most four fifths full with ``n`` keys."""
        buckets = 1
        while buckets * SLOTS * 4 < n * 5:
            buckets *= 2
        return CuckooFilter(buckets)

    def place(self, digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0, which marks a free slot) and first bucket."""
        return int.from_bytes(digest[8:10], "little") or 1, int.from_bytes(digest[:8], "little") & (self.buckets - 1)

    def other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & (self.buckets - 1))

    def find(self, digest: bytes) -> int:
        """Slot that may hold the digest, or -1."""
        fingerprint, first = self.place(digest)
        for bucket in (first, self.other(first, fingerprint)):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.slots[slot] == fingerprint:
                    return slot
        return -1

    def insert(self, digest: bytes) -> bool:
        """False when no room was found; the filter must then be built anew, as some fingerprint has lost its slot."""
        fingerprint, bucket = self.place(digest)
        for kick in range(KICKS):
            for at in (bucket, self.other(bucket, fingerprint)):
                for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                    if not self.slots[slot]:
                        self.slots[slot] = fingerprint
                        return True
            victim = SLOTS * bucket + (fingerprint + kick) % SLOTS
            fingerprint, self.slots[victim] = self.slots[victim], fingerprint
            bucket = self.other(bucket, fingerprint)
        return False

    def delete(self, digest: bytes) -> None:
        """Take out one fingerprint of a digest that was inserted."""
        self.slots[self.find(digest)] = 0


def update_shard(rows: pd.DataFrame) -> tuple[CuckooFilter, dict]:
    """New filter and content of one shard from its filter, its content and a batch of signed counts."""
    held, content, batch = (rows[rows["kind"] == k] for k in (0, 1, 2))
    live = {bytes(d): [n, k] for d, n, k in zip(content["digest"], content["live"], content["keep"])}
    if len(held):
        known = CuckooFilter(int(held["live"].iloc[0]), bytes(held["slots"].iloc[0]))
    else:
        known = CuckooFilter.for_keys(0)
    for digest, n, keep in zip(batch["digest"], batch["live"], batch["keep"]):
        digest = bytes(digest)
        entry = live.get(digest) if known.find(digest) >= 0 else None  # a hit of the filter is verified
        if entry:
            entry[0] += n
            entry[1] = max(entry[1], keep)
            if entry[0] <= 0:
                known.delete(digest)
                del live[digest]
        elif n > 0:
            live[digest] = [n, keep]
            fits = known.insert(digest)
            while not fits:  # overflow: twice the buckets, from the stored digests
                known = CuckooFilter(2 * known.buckets)
                fits = all(known.insert(d) for d in live)
    return known, live


@dataclass
class CuckooIndex:
    """Live digests with their counts; every update returns a new index over new tables."""

    spark: SparkSession
    shards: int
    content: DataFrame | None = None
    filters: DataFrame | None = None

    def _shard(self):
        return F.pmod(F.conv(F.substring(F.hex("digest"), 49, 8), 16, 10).cast("long"), F.lit(self.shards)).cast("int")

    def _updated(self, batch: DataFrame) -> CuckooIndex:
        shard = self._shard()
        empty = F.lit(None).cast("binary")
        rows = batch.select(shard.alias("shard"), F.lit(2).alias("kind"), "digest", "live", "keep", empty.alias("slots"))
        if self.content is not None:
            rows = rows.unionByName(self.content.select("shard", F.lit(1).alias("kind"), "digest", "live", "keep", empty.alias("slots")))
            rows = rows.unionByName(self.filters.select(
                "shard", F.lit(0).alias("kind"), empty.alias("digest"), F.col("buckets").alias("live"), F.lit(0).cast("long").alias("keep"), "slots"))

        def task(pdf: pd.DataFrame) -> pd.DataFrame:
            known, live = update_shard(pdf.sort_values(["kind", "digest", "keep"], kind="stable"))
            number = int(pdf["shard"].iloc[0])
            out = [(number, d, n, k, None) for d, (n, k) in live.items()]
            out.append((number, None, known.buckets, 0, known.slots.tobytes()))
            return pd.DataFrame(out, columns=["shard", "digest", "live", "keep", "slots"])

        after = written(rows.groupBy("shard").applyInPandas(task, "shard int, digest binary, live long, keep long, slots binary"), "cuckoo")
        content = after.filter(F.col("digest").isNotNull()).select("shard", "digest", "live", "keep")
        filters = after.filter(F.col("digest").isNull()).select("shard", F.col("live").alias("buckets"), "slots")
        return CuckooIndex(self.spark, self.shards, content, filters)

    def insert(self, documents: DataFrame) -> CuckooIndex:
        """Index with the documents (doc, digest) added; those of one document must come once."""
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
        batch = documents.groupBy("digest", salt.alias("salt")).agg(F.count(F.lit(1)).alias("live"), F.max("doc").alias("keep"))
        return self._updated(batch)

    def delete(self, documents: DataFrame, remaining: DataFrame) -> CuckooIndex:
        """Index without the documents (doc, digest). A digest whose last document goes leaves content and filter; of the
        others the document that stays is found among the ``remaining`` ones."""
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
        batch = documents.groupBy("digest", salt.alias("salt")).agg((-F.count(F.lit(1))).alias("live"))
        after = self._updated(batch.withColumn("keep", F.lit(-(1 << 62)).cast("long")))
        stay = remaining.join(documents.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("doc").alias("stay"))
        content = after.content.join(stay, "digest", "left").select(
            "shard", "digest", "live", F.coalesce("stay", "keep").alias("keep"))
        return CuckooIndex(self.spark, self.shards, written(content, "cuckoo-content"), after.filters)

    def probe(self, digests: DataFrame) -> DataFrame:
        """(digest, live) of the distinct ``digests`` that are live. The filters say no without a look at the content;
        only hits are joined with it."""
        asked = digests.select(self._shard().alias("shard"), "digest")

        def hits(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(right):
                return left[["digest"]].iloc[:0]
            known = CuckooFilter(int(right["buckets"].iloc[0]), bytes(right["slots"].iloc[0]))
            return left.loc[[known.find(bytes(d)) >= 0 for d in left["digest"]], ["digest"]]

        hit = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(hits, "digest binary")
        return hit.join(self.content.select("digest", "live"), "digest")


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the text after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, digest) of every document; rows without id have one row per digest."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), text_digest(text_col).alias("digest")).dropDuplicates(["doc", "digest"])


def _index(rows: DataFrame) -> CuckooIndex:
    spark = rows.sparkSession
    shards = max(1, math.ceil(rows.count() / SHARD_DIGESTS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return CuckooIndex(spark, shards).insert(rows)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, digest, live, keep): every document with the size of its group and the document of it that stays."""
    rows = written(digests(docs.filter(F.col(id_col).isNotNull()), id_col, text_col), "digests")
    # The groups are a written table, so a hot digest is an ordinary skewed side that adaptive execution splits.
    return rows.join(_index(rows).content.select("digest", "live", "keep"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies: of each group the row with the largest id stays, once."""
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    named = docs.select(rank.alias("doc"), F.col(text_col).alias("text"))
    content = _index(written(digests(named, "doc"), "digests")).content
    return keep_rows(docs, {"digest": text_digest(text_col), "doc": rank}, content.select("digest", F.col("keep").alias("doc")))


def keep_rows(docs: DataFrame, key: dict[str, Column], kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key``, columns that are never null, is in ``kept``, each key once. The join leaves the rows dealt by
    key, so the choice among repeated rows, by a hash of the whole row, needs no further shuffle."""
    from pyspark.sql import Window

    columns = [f"`{c}`" for c in docs.columns]
    plain = docs.select(F.struct(*columns).alias("row"), *[c.alias(n) for n, c in key.items()])
    hashed = F.xxhash64(*[F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    once = F.row_number().over(Window.partitionBy(*key).orderBy(hashed))
    return plain.join(kept.hint("merge"), list(key), "left_semi").withColumn("n", once).filter("n = 1").select("row.*")


@BOOK.add("op10_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(lowered) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lowered FROM documents)
WINDOW same AS (PARTITION BY lowered)""")
def op10_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("live").alias("group_size"),
        (F.col("doc") == F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
