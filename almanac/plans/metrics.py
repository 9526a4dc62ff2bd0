"""Evaluation metrics (J4-J13)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from almanac.functions import text as T
from almanac.operators import metrics as M
from almanac.operators.index import hash_key
from almanac.plans import Book, table
from almanac.plans.rendered import SQL_REPORTS, reports
from almanac.plans.training import sequences

BOOK = Book()
PAIRS = """
WITH pairs AS (SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS key, translate(a.text, '.,;!?:', '') AS p, translate(u.text, '.,;!?:', '') AS l
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
"""


def pairs(spark, sf):
    conv = table(spark, sf, "conversations")
    user = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("label"))
    answer = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return user.join(answer, ["conv_id", "turn"]).select(key.alias("key"), "prediction", "label")


def _run(key):
    """The pairs of conversations fall into runs by their number."""
    return (F.substring_index(key, "-", 1).cast("bigint") % 3).cast("string")


def _grams(orders: int) -> str:
    parts = []
    for n in range(1, orders + 1):
        for side in ("p", "l"):
            gram = f"list_transform(range(1, len({side}t) - {n - 1} + 1), lambda i: array_to_string({side}t[i:i + {n - 1}], ' '))"
            parts.append(f"SELECT key, {n} AS ord, unnest({gram}) AS g, {int(side == 'p')} AS a, {int(side == 'l')} AS b FROM tok")
    return f"gr AS ({' UNION ALL '.join(parts)}), " + """
each AS (SELECT key, ord, g, sum(a) AS a, sum(b) AS b FROM gr GROUP BY ALL),
cnt AS (SELECT key, ord, sum(least(a, b)) AS hits, sum(a) AS a, sum(b) AS b FROM each GROUP BY ALL)
"""


_ROUGE = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


@BOOK.add("J4_rouge_ngrams", PAIRS + f"tok AS (SELECT key, {_ROUGE.format('p')} AS pt, {_ROUGE.format('l')} AS lt FROM pairs), " + _grams(2) + """
SELECT p.key, round(coalesce(max(2.0 * hits / (a + b)) FILTER (ord = 1), 0.0), 6) AS rouge_1, round(coalesce(max(2.0 * hits / (a + b)) FILTER (ord = 2), 0.0), 6) AS rouge_2
FROM pairs p LEFT JOIN cnt ON cnt.key = p.key GROUP BY p.key""")
def j4(spark, sf):
    scores = M.rouge_ngrams(pairs(spark, sf), "key", "prediction", "label")
    return scores.select("key", F.round("rouge_1", 6).alias("rouge_1"), F.round("rouge_2", 6).alias("rouge_2"))


# One row of the table of common subsequences per token of the prediction; an entry is the largest so far in its row.
@BOOK.add("J4_rouge_l", PAIRS.replace("WITH", "WITH RECURSIVE") + f"tok AS (SELECT key, {_ROUGE.format('p')} AS pt, {_ROUGE.format('l')} AS lt FROM pairs), " + """
walk AS (SELECT key, 0 AS i, pt, lt, list_transform(lt, lambda w: 0) AS best FROM tok
  UNION ALL SELECT key, i + 1, pt, lt, list_transform(range(1, len(lt) + 1), lambda j: list_max(list_transform(lt[1:j], lambda w, k:
    CASE WHEN w = pt[i + 1] THEN greatest(best[k], coalesce(best[k - 1], 0) + 1) ELSE best[k] END))) FROM walk WHERE i < len(pt))
SELECT key, round(coalesce(2.0 * best[len(lt)] / nullif(len(pt) + len(lt), 0), 0.0), 6) AS rouge_l FROM walk WHERE i = len(pt)""")
def j4_l(spark, sf):
    return M.rouge_l(pairs(spark, sf), "key", "prediction", "label").withColumn("rouge_l", F.round("rouge_l", 6))


def _bleu_sql(x: str) -> str:
    for old, new in [("<skipped>", "''"), ("-' || chr(10) || '", "''"), ("' || chr(10) || '", "' '"), ("&quot;", "'\"'"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")]:
        x = f"replace({x}, '{old}', {new})"
    x = f"(' ' || {x} || ' ')"
    x = rf"regexp_replace({x}, '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g')"
    x = rf"regexp_replace({x}, '([^0-9])([.,])', '\1 \2 ', 'g')"
    x = rf"regexp_replace({x}, '([.,])([^0-9])', ' \1 \2', 'g')"
    x = rf"regexp_replace({x}, '([0-9])(-)', '\1 \2 ', 'g')"
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


# Answers against questions rarely share four words in a row, so the label is put in front of the prediction.
@BOOK.add("J5_bleu", PAIRS + f"tok AS (SELECT key, {_bleu_sql('(l || chr(10) || p)')} AS pt, {_bleu_sql('l')} AS lt FROM pairs), " + _grams(4) + """,
s AS (SELECT key, count(*) FILTER (hits > 0) AS k, avg(ln(CAST(hits AS DOUBLE) / a)) FILTER (hits > 0) AS m, max(a) FILTER (ord = 1) AS lp, max(b) FILTER (ord = 1) AS ll FROM cnt GROUP BY key)
SELECT p.key, round(coalesce(CASE WHEN k = 4 THEN exp(m) * CASE WHEN lp > ll THEN 1.0 ELSE exp(1 - CAST(ll AS DOUBLE) / lp) END ELSE 0.0 END, 0.0), 6) AS bleu
FROM pairs p LEFT JOIN s ON s.key = p.key""")
def j5(spark, sf):
    shown = pairs(spark, sf).withColumn("prediction", F.concat("label", F.lit("\n"), "prediction"))
    return M.bleu(shown, "key", "prediction", "label").withColumn("bleu", F.round("bleu", 6))


@BOOK.add("J6_greedy_match", """
WITH v AS (SELECT label // 2 AS pair, label % 2 AS side, vec_id AS pos, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings),
m AS (SELECT a.pair, a.pos AS i, b.pos AS j, list_sum(list_transform(list_zip(a.e, b.e), lambda t: CAST(t[1] AS DOUBLE) * t[2])) / (a.norm * b.norm) AS s
      FROM v a JOIN v b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
p AS (SELECT pair, avg(s) AS precision FROM (SELECT pair, i, max(s) AS s FROM m GROUP BY pair, i) GROUP BY pair),
r AS (SELECT pair, avg(s) AS recall FROM (SELECT pair, j, max(s) AS s FROM m GROUP BY pair, j) GROUP BY pair)
SELECT CAST(pair AS BIGINT) AS pair, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p JOIN r USING (pair)""")
def j6(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.floor(F.col("label") / 2).alias("pair"), (F.col("label") % 2).alias("side"), F.col("vec_id").alias("pos"), "embedding")
    scores = M.greedy_match(vectors, "pair", "side", "pos", "embedding")
    return scores.select("pair", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_PRED = "CASE WHEN n > 2 THEN replace(report, city, '<city>') ELSE report END"
_SAID = "regexp_extract_all(translate(pred, '.,;!?:', ''), '-?[0-9]+')"
PREDICTIONS = SQL_REPORTS + f""",
pr AS (SELECT created_day AS run, path, {_PRED} AS pred, temperatur FROM rep),
said AS (SELECT run, path, pred, temperatur, {_SAID} AS said, list_filter(temperatur, lambda t: t <> 'NaN') AS known FROM pr),
minmax AS (SELECT *, list_min(list_transform(said, lambda t: CAST(t AS BIGINT))) AS lo, list_max(list_transform(said, lambda t: CAST(t AS BIGINT))) AS hi,
  list_min(list_transform(known, lambda t: CAST(t AS BIGINT))) AS klo, list_max(list_transform(known, lambda t: CAST(t AS BIGINT))) AS khi FROM said),
scored AS (SELECT *, CASE WHEN len(said) = 0 OR len(known) = 0 THEN 0.0 ELSE greatest(0, least(khi, hi) - greatest(klo, lo) + 1) / CAST(hi - lo + 1 AS DOUBLE) END AS score FROM minmax)
"""
_CITY_SQL = "SELECT run, round(avg(CASE WHEN contains(pred, '<city>') THEN 1 ELSE 0 END), 6) AS accuracy FROM pr GROUP BY run"
_TEMP_SQL = "SELECT run, round(sum(len(list_filter(said, lambda t: list_contains(temperatur, t)))) / CAST(sum(len(said)) AS DOUBLE), 6) AS accuracy FROM said GROUP BY run"
_RANGE_SQL = "SELECT run, round(avg(score), 6) AS mean_score FROM scored GROUP BY run"


def predictions(spark, sf):
    shown = F.when(F.col("n") > 2, T.mask_city("report", "city")).otherwise(F.col("report"))
    return reports(spark, sf).select(F.col("created_day").alias("run"), "path", shown.alias("prediction"), "temperatur_in_deg_C")


def _r(df, name):
    return df.withColumn(name, F.round(name, 6))


@BOOK.add("J7_city_rate", PREDICTIONS + _CITY_SQL)
def j7(spark, sf):
    return _r(M.city_rate(predictions(spark, sf), "run", "prediction"), "accuracy")


@BOOK.add("J8_temperature_accuracy", PREDICTIONS + _TEMP_SQL)
def j8(spark, sf):
    return _r(M.temperature_accuracy(predictions(spark, sf), "run", "prediction", "temperatur_in_deg_C"), "accuracy")


@BOOK.add("J9_temperature_range", PREDICTIONS + _RANGE_SQL)
def j9(spark, sf):
    return _r(M.temperature_range(predictions(spark, sf), "run", "prediction", "temperatur_in_deg_C"), "mean_score")


@F.pandas_udf(DoubleType())
def _share_of_long(window: pd.Series) -> pd.Series:
    """Stand-in for a classifier: share of ids above 4."""
    return window.map(lambda ids: float((ids > 4).mean()) if len(ids) else None)


@BOOK.add("J10_window_score", r"""
WITH seq AS (SELECT role AS run, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key,
  list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: len(w)) AS ids FROM conversations),
w AS (SELECT run, key, ids, unnest(range(0, greatest(len(ids) - 19, 1))) AS s FROM seq),
sc AS (SELECT run, key, len(list_filter(ids[s + 1:s + 20], lambda t: t > 4)) / CAST(len(ids[s + 1:s + 20]) AS DOUBLE) AS v FROM w)
SELECT run, round(avg(v), 6) AS mean_score FROM (SELECT run, key, avg(v) AS v FROM sc GROUP BY ALL) GROUP BY run""")
def j10(spark, sf):
    rows = sequences(spark, sf).withColumnRenamed("role", "run")
    return _r(M.window_score(rows, "run", "key", "ids", _share_of_long), "mean_score")


def _overlap(context: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Stand-in for a classifier that sees the context: share of a window's ids that occur in it."""
    return np.isin(windows, context).mean(axis=1) if windows.size else np.full(len(windows), np.nan)


def _answer_ids(spark, sf):
    """Answers as word lengths, beside them the question's as context; runs by conversation."""
    lengths = [F.transform(T.words(c), lambda w: F.length(w).cast("bigint")).alias(n) for c, n in (("prediction", "ids"), ("label", "context"))]
    return pairs(spark, sf).select("key", _run("key").alias("run"), *lengths)


_LENGTHS = r"list_transform(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''), lambda w: len(w))"
_RUN_SQL = "CAST(CAST(split_part(key, '-', 1) AS BIGINT) % 3 AS VARCHAR)"
_WINDOWS = f"""
SELECT run, round(avg(v), 5) AS mean_score FROM (SELECT run, key, avg(v) AS v FROM (
  SELECT run, key, ids[s + 1:s + 20] AS w, context FROM (SELECT *, unnest(range(0, greatest(len(ids) - 19, 1))) AS s
    FROM (SELECT key, {_RUN_SQL} AS run, {_LENGTHS.format('p')} AS ids, {_LENGTHS.format('l')} AS context FROM (SELECT u.conv_id || '-' || u.turn AS key, a.text AS p, u.text AS l
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')))
) AS t, LATERAL (SELECT len(list_filter(w, lambda x: VALUE_OF)) / CAST(nullif(len(w), 0) AS DOUBLE) AS v) GROUP BY ALL) GROUP BY run"""


@BOOK.add("J10_window_score_context", _WINDOWS.replace("VALUE_OF", "list_contains(context, x)"))
def j10_context(spark, sf):
    scores = M.context_window_score(_answer_ids(spark, sf), "run", "key", "ids", "context", _overlap)
    return scores.withColumn("mean_score", F.round("mean_score", 5))


@BOOK.add("J10_answer_windows", _WINDOWS.replace("VALUE_OF", "x > 4"))
def j10_answers(spark, sf):
    scores = M.window_score(_answer_ids(spark, sf), "run", "key", "ids", _share_of_long)
    return scores.withColumn("mean_score", F.round("mean_score", 5))


def _chosen(spark, sf):
    return M.metric_rows({"CityAppearance": j7(spark, sf), "TemperatureCorrectness": j8(spark, sf), "TemperatureRange": j9(spark, sf)}, "run")


_ROWS = f"""
SELECT run, 'CityAppearance' AS metric, 'accuracy' AS name, accuracy AS value FROM ({_CITY_SQL})
UNION ALL SELECT run, 'TemperatureCorrectness', 'accuracy', accuracy FROM ({_TEMP_SQL})
UNION ALL SELECT run, 'TemperatureRange', 'mean_score', mean_score FROM ({_RANGE_SQL})"""


def _per_run(scores, *names):
    return M.per_run(scores.withColumn("run", _run("key")), "run", *names)


def _mean_sql(query: str, *names: str) -> str:
    means = ", ".join(f"round(avg({n}), 5) AS {n}" for n in names)
    return f"SELECT {_RUN_SQL} AS run, {means} FROM ({BOOK.oracles[query]}) GROUP BY 1"


@BOOK.add("J4_rouge_per_run", _mean_sql("J4_rouge_ngrams", "rouge_1", "rouge_2"))
def j4_run(spark, sf):
    means = _per_run(j4(spark, sf), "rouge_1", "rouge_2")
    return means.select("run", *[F.round(n, 5).alias(n) for n in ("rouge_1", "rouge_2")])


@BOOK.add("J4_rouge_l_per_run", _mean_sql("J4_rouge_l", "rouge_l"))
def j4_l_run(spark, sf):
    return _per_run(j4_l(spark, sf), "rouge_l").withColumn("rouge_l", F.round("rouge_l", 5))


@BOOK.add("J5_bleu_per_run", _mean_sql("J5_bleu", "bleu"))
def j5_run(spark, sf):
    return _per_run(j5(spark, sf), "bleu").withColumn("bleu", F.round("bleu", 5))


@BOOK.add("J6_match_per_run", "SELECT CAST(pair % 2 AS VARCHAR) AS run, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, "
          f"round(avg(f1), 5) AS f1 FROM ({BOOK.oracles['J6_greedy_match']}) GROUP BY 1")
def j6_run(spark, sf):
    names = ("precision", "recall", "f1")
    means = M.per_run(j6(spark, sf).withColumn("run", (F.col("pair") % 2).cast("string")), "run", *names)
    return means.select("run", *[F.round(n, 5).alias(n) for n in names])


def _figures_sql(metric: str, query: str, *names: str) -> str:
    each = " UNION ALL ".join(f"SELECT run, '{metric}' AS metric, '{n}' AS name, {n} AS value FROM figures" for n in names)
    return f"SELECT * FROM (WITH figures AS MATERIALIZED ({BOOK.oracles[query]}) {each})"


_PAIR_ROWS = " UNION ALL ".join(_figures_sql(*f) for f in (
    ("ROUGE", "J4_rouge_per_run", "rouge_1", "rouge_2"), ("ROUGE", "J4_rouge_l_per_run", "rouge_l"), ("BLEU", "J5_bleu_per_run", "bleu"),
    ("GreedyMatch", "J6_match_per_run", "precision", "recall", "f1"), ("WindowScore", "J10_answer_windows", "mean_score"),
    ("WindowScoreContext", "J10_window_score_context", "mean_score")))


def _pair_rows(spark, sf):
    rouge = j4_run(spark, sf).join(j4_l_run(spark, sf), "run", "full")
    return M.metric_rows({"ROUGE": rouge, "BLEU": j5_run(spark, sf), "GreedyMatch": j6_run(spark, sf), "WindowScore": j10_answers(spark, sf),
                          "WindowScoreContext": j10_context(spark, sf)}, "run")


@BOOK.add("J11_pair_metric_rows", _PAIR_ROWS)
def j11_pairs(spark, sf):
    return _pair_rows(spark, sf)


@BOOK.add("J11_pair_report", f"""
SELECT run, '{{' || string_agg('"' || metric || '":{{' || figures || '}}', ',' ORDER BY metric) || '}}' AS report FROM (
  SELECT run, metric, string_agg('"' || name || '":' || CAST(value AS VARCHAR), ',' ORDER BY name) AS figures FROM ({_PAIR_ROWS}) GROUP BY ALL) GROUP BY run""")
def j11_pair_report(spark, sf):
    return M.metric_report(_pair_rows(spark, sf), "run")


@BOOK.add("J11_metric_rows", PREDICTIONS + _ROWS)
def j11(spark, sf):
    return _chosen(spark, sf)


@BOOK.add("J11_metric_report", PREDICTIONS + f"""
SELECT run, '{{' || string_agg('"' || metric || '":{{"' || name || '":' || CAST(value AS VARCHAR) || '}}', ',' ORDER BY metric) || '}}' AS report FROM ({_ROWS}) GROUP BY run""")
def j11_json(spark, sf):
    return M.metric_report(_chosen(spark, sf), "run")


_DRAW = "(CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE)"


def _probabilities(spark, sf):
    draw = F.conv(F.substring(hash_key(7, "doc_id"), 1, 8), 16, 10).cast("bigint")
    return ((draw + 1) / F.lit(4294967297.0)).alias("p")


@BOOK.add("J12_cross_entropy", f"SELECT lang AS run, round(sum(-ln({_DRAW})) / count(*), 6) AS loss FROM documents WHERE source <> 'src0' GROUP BY lang")
def j12(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("lang").alias("run"), F.substring("source", 4, 3).cast("int").alias("label"), _probabilities(spark, sf))
    return _r(M.cross_entropy(rows, "run", "label", "p", pad=0), "loss")


@BOOK.add("J13_log_loss", f"""
WITH x AS (SELECT CAST(toxic AS BIGINT) AS run, quality AS y, CASE WHEN quality = 1 AND toxic = 1 THEN 0.0 ELSE {_DRAW} END AS p FROM labels)
SELECT run, round(avg(CASE WHEN y = 1 THEN -CASE WHEN p > 0 THEN greatest(ln(p), -100.0) ELSE -100.0 END ELSE -greatest(ln(1 - p), -100.0) END), 6) AS loss FROM x GROUP BY run""")
def j13(spark, sf):
    rows = table(spark, sf, "labels").select(
        F.col("toxic").cast("bigint").alias("run"), "quality", "toxic", _probabilities(spark, sf))
    rows = rows.withColumn("p", F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 0.0).otherwise(F.col("p")))
    return _r(M.log_loss(rows, "run", "quality", "p"), "loss")
