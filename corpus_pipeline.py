"""A training corpus from raw documents: language identification, exact and near duplicates, source mixing, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what each
stage returns as Parquet in the shared folder and reads it again as the documents of the next. All stages but the last return
the columns of ``documents``, extra ones whatever their names included.

Defined results: null texts and texts without a letter are rejected by the first stage. Rows without id stay like others: of equal
texts the row with the largest id stays and one without id only if there is no other; of near copies the one with the smallest id,
one without id last. Rows repeated with equal id and text are one document, rows of one id with different texts are several. Very
long texts go through whole. Ties are broken by hashes of the rows, so a run repeats itself. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import exact_dedup, language_id, mixing, ngram_join, packing
from almanac.plans import Book
from almanac.storage import written

#: A document whose words belong to its language by less than this share is rejected, as is one without a letter.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; ``lang`` stays as it came. Rejected: no letters, or no language with a share of
    ``LEAST_SHARE`` of the words. With no labelled row to learn from, only texts without letters go."""
    fold = language_id.learning_part(F.col("doc_id"), 4)
    model = language_id.fit(docs.filter(fold != 2))
    return language_id.recognised(docs, model, LEAST_SHARE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for A-Z and a-z, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the one with the
    smallest id."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; a document that the mix repeats is packed as often."""
    return packing.pack(docs).withColumnRenamed("doc", "doc_id")


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
          ("mixing sources to target weights", source_mix), ("packing", packed)]

#: Language identification and packing have no SQL form; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None

BOOK = Book()


@BOOK.add("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split(" ")[0])
    return docs
