"""Set operations (K rows)."""

from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.plans import Book, table

BOOK = Book()
_WORDS = r"SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS token FROM documents WHERE doc_id % 3 = {}"
_TOKENS = r"SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS token FROM documents WHERE lang = '{}'"


def _tokens(spark, sf, lang):
    return table(spark, sf, "documents").filter(F.col("lang") == lang).select(F.explode(T.words("text")).alias("token"))


@BOOK.add("K1_union_of_tokens", " UNION ".join(_WORDS.format(k) for k in range(3)))
def k1(spark, sf):
    docs = table(spark, sf, "documents")
    first, *rest = [docs.filter(F.col("doc_id") % 3 == k).select(F.explode(T.words("text")).alias("token")) for k in range(3)]
    for part in rest:
        first = first.union(part)
    return first.distinct()


@BOOK.add("K2_shared_tokens", f"{_TOKENS.format('de')} INTERSECT {_TOKENS.format('en')}")
def k2(spark, sf):
    return _tokens(spark, sf, "de").intersect(_tokens(spark, sf, "en"))


@BOOK.add("K3_not_collected", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def k3(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
