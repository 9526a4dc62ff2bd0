"""Vocabularies and token sequences (I1-I11, I17)."""

from pyspark.sql import functions as F

from almanac.operators import vocabulary as V
from almanac.plans import Book, table
from almanac.plans.rendered import records, reports
from almanac.plans.series import CORPUS_SQL, corpus

BOOK = Book()
_SPECIAL_ROWS = " UNION ".join(f"SELECT '{s}' AS token" for s in V.CONTEXT_SPECIALS)
CONTEXT_VOCAB = CORPUS_SQL + f""",
ctx AS (SELECT DISTINCT unnest(string_split(overview_full, ';')) AS token FROM corpus),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT token FROM ctx UNION {_SPECIAL_ROWS}))
"""
_BARE = "regexp_replace(report, '[.,!:?();]', '', 'g')"
_EXTRA = " UNION ".join(f"SELECT '{s}' AS token" for s in V.WORD_SPECIALS + [t for _, t in V.EXTRA_TOKENS])
_SPLIT = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
WORD_VOCAB = CORPUS_SQL + f""",
wv AS (SELECT DISTINCT unnest({_SPLIT.format(_BARE)}) AS token FROM rep WHERE n > 2),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT token FROM wv UNION {_EXTRA})),
toks AS (SELECT path, {_SPLIT.format("replace(replace(report, '.', ' <point>'), ',', ' <comma>')")} AS ws FROM rep),
ids AS (SELECT path, i, coalesce(id, (SELECT id FROM vocab WHERE token = '<unknown>')) AS id
        FROM (SELECT path, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM toks) LEFT JOIN vocab USING (token))
"""


def _joined(df, key, col="ids"):
    return df.select(key, F.array_join(F.col(col).cast("array<string>"), ",").alias(col))


def context_vocabulary(spark, sf):
    return V.vocabulary(V.context_tokens(corpus(spark, sf), "overview_full"), V.CONTEXT_SPECIALS)


def word_vocabulary(spark, sf):
    # Built from part of the reports, so that the others hold words outside it.
    tokens = V.word_tokens(reports(spark, sf).filter("n > 2"), "report")
    return V.vocabulary(tokens, V.WORD_SPECIALS + [t for _, t in V.EXTRA_TOKENS])


@BOOK.add("I1_context_vocabulary", CORPUS_SQL + "SELECT DISTINCT unnest(string_split(overview_full, ';')) AS token FROM corpus ORDER BY token")
def i1(spark, sf):
    return V.context_tokens(corpus(spark, sf), "overview_full").orderBy("token")


@BOOK.add("I2_word_vocabulary", r"""
SELECT DISTINCT unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[.,!:?();]', '', 'g'), '\s+'), lambda w: w <> '')) AS token FROM documents ORDER BY token""")
def i2(spark, sf):
    return V.word_tokens(table(spark, sf, "documents"), "text").orderBy("token")


# Word lengths stand in for the ids of an outside tokenizer.
_LENGTHS = r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CAST(len(w) AS BIGINT))"


def id_rows(spark, sf):
    from almanac.functions.text import words

    ids = F.transform(words("text"), lambda w: F.length(w).cast("bigint"))
    return table(spark, sf, "documents").select("doc_id", "lang", ids.alias("ids"))


@BOOK.add("I3_id_set", f"SELECT DISTINCT unnest({_LENGTHS}) AS id FROM documents UNION SELECT CAST(unnest(range(-60, 61)) AS BIGINT)")
def i3(spark, sf):
    return V.id_set(id_rows(spark, sf), "ids", range(-60, 61))


@BOOK.add("I4_vocabulary_ids", CONTEXT_VOCAB + "SELECT token, id FROM vocab")
def i4(spark, sf):
    return context_vocabulary(spark, sf)


@BOOK.add("I5_encode_context", CONTEXT_VOCAB + """
SELECT path, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids FROM (SELECT path, unnest(string_split(overview_ct, ';')) AS token,
  generate_subscripts(string_split(overview_ct, ';'), 1) AS i FROM corpus) JOIN vocab USING (token) GROUP BY path""")
def i5(spark, sf):
    rows = corpus(spark, sf)
    return _joined(V.encode_context(rows, "path", "overview_ct", context_vocabulary(spark, sf)), "path")


@BOOK.add("I6_encode_words", WORD_VOCAB + "SELECT path, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids FROM ids GROUP BY path")
def i6(spark, sf):
    return _joined(V.encode_words(reports(spark, sf), "path", "report", word_vocabulary(spark, sf)), "path")


@BOOK.add("I7_decode_ids", WORD_VOCAB + """
SELECT path, replace(replace(string_agg(token, ' ' ORDER BY i), ' <point>', '.'), ' <comma>', ',') AS text FROM ids JOIN vocab USING (id) GROUP BY path""")
def i7(spark, sf):
    from almanac.storage import written

    vocab = written(word_vocabulary(spark, sf), "vocabulary-ids")
    return V.decode(V.encode_words(reports(spark, sf), "path", "report", vocab), "path", "ids", vocab)


@BOOK.add("I8_wrap_texts", "SELECT doc_id, md5('<start> ' || text || ' <stop>') AS spaced, md5('<start>' || text || '<stop>') AS unspaced FROM documents")
def i8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(V.wrapped("text")).alias("spaced"), F.md5(V.wrapped("text", False)).alias("unspaced"))


_IDS = f"""
WITH seq AS (SELECT doc_id, lang, {_LENGTHS} AS ids FROM documents),
flat AS (SELECT doc_id, lang, unnest(ids) AS old, generate_subscripts(ids, 1) AS i FROM seq)"""
_SUBSET = _IDS + """,
used AS (SELECT DISTINCT old FROM flat UNION SELECT unnest([30000, 30001, 30002, 30003])),
map AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS new FROM used)
"""


@BOOK.add("I9_subset_remap", _SUBSET + "SELECT doc_id, md5(string_agg(CAST(new AS VARCHAR), ',' ORDER BY i)) AS ids FROM flat JOIN map USING (old) GROUP BY doc_id")
def i9(spark, sf):
    rows = id_rows(spark, sf)
    mapping = V.subset_mapping(V.id_set(rows, "ids"), [30000, 30001, 30002, 30003])
    return _joined(V.remap(rows, "doc_id", "ids", mapping), "doc_id").withColumn("ids", F.md5("ids"))


@BOOK.add("I9_subset_back", _IDS + "SELECT doc_id, md5(string_agg(CAST(old AS VARCHAR), ',' ORDER BY i)) AS ids FROM flat GROUP BY doc_id")
def i9_back(spark, sf):
    from almanac.storage import written

    rows = id_rows(spark, sf)
    mapping = written(V.subset_mapping(V.id_set(rows, "ids"), [30000, 30001, 30002, 30003]), "mapping")
    there = V.remap(rows, "doc_id", "ids", mapping)
    return _joined(V.remap(there, "doc_id", "ids", mapping, "new", "old"), "doc_id").withColumn("ids", F.md5("ids"))


_REDUCED = _IDS + """,
used AS (SELECT old, count(*) AS n FROM flat GROUP BY old),
allids AS (SELECT * FROM used UNION ALL SELECT s, 1 FROM (SELECT unnest([0, 3, 102, 103]) AS s) WHERE s NOT IN (SELECT old FROM used)),
map AS (SELECT CAST(old AS BIGINT) AS old, row_number() OVER (ORDER BY old) - 1 AS new, CAST(n AS BIGINT) AS n FROM allids)
"""


@BOOK.add("I10_reduced_vocabulary", _REDUCED + "SELECT old, new, n FROM map")
def i10(spark, sf):
    return V.reduced_vocabulary(id_rows(spark, sf), "ids", [0, 3, 102, 103])


@BOOK.add("I10_reduction", _REDUCED + "SELECT count(*) AS reduced_size, round(count(*) / CAST(30000 AS DOUBLE) * 100, 6) AS percent FROM map")
def i10_reduction(spark, sf):
    row = V.reduction(V.reduced_vocabulary(id_rows(spark, sf), "ids", [0, 3, 102, 103]), 30000)
    return row.withColumn("percent", F.round("percent", 6))


@BOOK.add("I11_lenient_remap", _IDS + """,
used AS (SELECT DISTINCT old FROM flat WHERE lang = 'en'), map AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS new FROM used)
SELECT doc_id, md5(string_agg(CAST(coalesce(new, 0) AS VARCHAR), ',' ORDER BY i)) AS ids FROM flat LEFT JOIN map USING (old) GROUP BY doc_id""")
def i11(spark, sf):
    rows = id_rows(spark, sf)
    mapping = V.subset_mapping(V.id_set(rows.filter("lang = 'en'"), "ids"), [])
    return _joined(V.remap(rows, "doc_id", "ids", mapping, on_missing=0), "doc_id").withColumn("ids", F.md5("ids"))


_JOIN_IDS = "array_to_string({}, ',')"


@BOOK.add("I17_filter_specials", f"SELECT doc_id, md5(array_to_string(list_filter({_LENGTHS}, lambda t: t NOT IN (1, 2, 3)), ',')) AS ids FROM documents")
def i17(spark, sf):
    kept = id_rows(spark, sf).select("doc_id", V.without_ids("ids", [1, 2, 3]).alias("ids"))
    return _joined(kept, "doc_id").withColumn("ids", F.md5("ids"))


@BOOK.add("I17_trim_specials", f"""
WITH s AS (SELECT doc_id, {_LENGTHS} AS ids FROM documents), a AS (SELECT doc_id, CASE WHEN ids[1] = 5 THEN ids[2:] ELSE ids END AS ids FROM s)
SELECT doc_id, md5(array_to_string(CASE WHEN ids[-1] = 6 THEN ids[:-2] ELSE ids END, ',')) AS ids FROM a""")
def i17_trim(spark, sf):
    kept = id_rows(spark, sf).select("doc_id", V.trimmed("ids", 5, 6).alias("ids"))
    return _joined(kept, "doc_id").withColumn("ids", F.md5("ids"))
