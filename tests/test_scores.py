import glob
import math
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import blocks as B
from almanac.operators import metrics as M
from almanac.operators import similarity as S
from almanac.operators.postings import Postings, best
from almanac.storage import written, written_in_turn


def brute_force(texts):
    counts = [{w: t.split().count(w) for w in t.split()} for t in texts]
    vocab = sorted({w for c in counts for w in c})
    df = {w: sum(w in c for c in counts) for w in vocab}
    m = np.array([[c.get(w, 0) * np.log(len(texts) / df[w]) for w in vocab] for c in counts])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sims = m @ m.T
    np.fill_diagonal(sims, 0.0)
    return sims


@pytest.mark.parametrize("block_rows", [None, 7])
def test_similarity_equals_brute_force(spark, block_rows):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += ["the same hot text"] * 30 + ["", "solo unique words"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    sims = np.sort(brute_force(texts), axis=1)
    for x, best in ((5, False), (5, True), (200, False)):
        got = {r["k"]: r["mean_similarity"] for r in S.mean_top_similarity(df, "k", F.col("t"), x, best, block_rows).collect()}
        expected = sims[:, -x:] if best else sims[:, -(x + 1):-1]
        for k in range(len(texts)):
            assert got[k] == pytest.approx(expected[k].mean(), abs=1e-9)


def test_postings_find_all_above_the_floor():
    rng = np.random.default_rng(5)
    dense = rng.random((80, 60)) * (rng.random((80, 60)) < 0.15) * rng.choice([0.05, 1.0], 60)
    sparse = [(np.flatnonzero(r), r[r > 0]) for r in dense]
    index = Postings([t for t, _ in sparse[:50]], [w for _, w in sparse[:50]])
    whole = dense @ dense[:50].T
    stopped = 0
    for i, (t, w) in enumerate(sparse):
        for floor in (0.0, 0.1, 0.5, 1.5, 9.0):
            rows, scores = index.above(t, w, floor)
            assert rows.tolist() == np.flatnonzero(whole[i] > floor).tolist() and np.allclose(scores, whole[i][rows])
            stopped += not len(rows)
    assert stopped and not len(Postings([], []).above(np.array([1]), np.array([1.0]), 0.0)[0])
    top, floor = best(np.array([0.2, 0.9, 0.5]), np.array([1, 2, 5]), 4)
    assert top.tolist() == [1, 2] and floor == 0.5 and best(np.zeros(0), np.zeros(0, int), 3)[1] == 0.0


def test_similarity_shuffles_less_than_the_square(spark):
    """Rows that travel between blocks, for a number of distinct vectors and for ten times as many."""
    sent = []
    for n in (1000, 10_000):
        distinct = spark.range(n).select(F.concat(F.lit("s"), F.lpad("id", 8, "0")).alias("signature"), (F.col("id") % 7).alias("lead"))
        placed, blocks = S.blocked(distinct)
        assert placed.count() == n and placed.select("block").distinct().count() == blocks
        sent.append(n * (blocks - 1))
    assert sent[1] <= 40 * sent[0]


@pytest.mark.parametrize("blocks", [1, 2, 5, 6])
def test_rounds_meet_every_pair_once_and_stay_small(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "ROUND_ROWS", 1)
    inside = spark.range(blocks * 10).select((F.col("id") % blocks).alias("block"), F.array(F.lit(1)).alias("terms"), F.lit(0).alias("entries"))
    met = [r.groupBy("a", "b").agg(F.collect_set("block").alias("sides"), F.count(F.lit(1)).alias("n")).collect()
           for r in S.rounds(inside, blocks, blocks * 10)]
    assert sorted((p["a"], p["b"]) for r in met for p in r) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]
    assert all(sorted(p["sides"]) == [p["a"], p["b"]] and p["n"] == 20 for r in met for p in r)
    assert all(sum(p["n"] for p in r) <= 2 * blocks * 10 for r in met)


def test_writes_leave_no_shuffle_files(spark):
    def shuffles():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    before = shuffles()
    parts = written_in_turn((spark.range(1000 * i, 1000 * i + 1000).repartition(5, "id") for i in range(3)), "test")
    written(parts.repartition(4, "id"), "test")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert parts.count() == 3000 and parts.agg(F.sum("id")).first()[0] == sum(range(3000))


def test_corpus_similarity_is_the_mean_over_reports(spark):
    texts = ["a b c", "a b d", "b c d e", "x y", "a b c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    sims = np.sort(brute_force(texts), axis=1)
    row = S.corpus_similarity(df, "k", F.col("t"), 2).first()
    assert row["reports"] == 6 and row["mean_similarity"] == pytest.approx(sims[:, -3:-1].mean(), abs=1e-12)
    none = df.filter("k < 0")
    assert S.corpus_similarity(none, "k", F.col("t"), 2).first().asDict() == {"reports": 0, "mean_similarity": None}
    assert S.nearest_similarities(none, "k", F.col("t"), 2).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("bits", [62, 3])
def test_common_length_equals_brute_force(spark, bits):
    rng = random.Random(2)
    pairs = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcd") for _ in range(rng.randint(0, 200))]) for i in range(60)]
    pairs += [(60, ["a"] * 130, ["a"] * 190), (61, None, ["a"]), (62, ["a"], None), (63, ["a"], ["b"]), (64, list("abc") * 60, list("cba") * 70)]
    df = spark.createDataFrame(pairs, "k int, a array<string>, b array<string>")
    got = {r["k"]: r["common"] for r in M.common_length(df, "k", "a", "b", bits).collect()}
    for k, a, b in pairs:
        assert got.get(k, 0) == longest_common(a or [], b or [])


def test_rouge_l_keeps_rows_with_one_key_apart(spark):
    rows = [(1, "a b c", "a b c"), (1, "a b c", "a b c"), (1, "x", "a"), (None, "a b", "b"), (2, None, "b"), (3, "b", None)]
    df = spark.createDataFrame(rows, "k int, p string, l string")
    got = sorted((str(r["k"]), round(r["rouge_l"], 4)) for r in M.rouge_l(df, "k", "p", "l").collect())
    assert got == [("1", 0.0), ("1", 1.0), ("1", 1.0), ("2", 0.0), ("3", 0.0), ("None", 0.6667)]


def test_scorer_sees_the_context_of_its_record(spark):
    rows = [("a", 1, list(range(30)), [3, 4, 25]), ("a", 2, [7, 8], [8]), ("b", 3, [1, 1, 1], None), ("b", 4, [], [1]), ("c", 5, None, [1])]
    df = spark.createDataFrame(rows, "run string, k int, ids array<bigint>, context array<bigint>")

    def score(context, windows):
        assert windows.ndim == 2
        return np.isin(windows, context).mean(axis=1) if windows.size else np.full(len(windows), np.nan)

    def plain(ids, context):
        windows = [ids[i:i + 20] for i in range(max(1, len(ids) - 19))]
        return np.mean([np.mean([t in context for t in w]) for w in windows])

    got = {r["run"]: r["mean_score"] for r in M.context_window_score(df, "run", "k", "ids", "context", score).collect()}
    assert got["a"] == pytest.approx((plain(rows[0][2], rows[0][3]) + 0.5) / 2) and got["b"] == 0.0 and got["c"] is None


def test_rouge_and_bleu(spark):
    df = spark.createDataFrame([
        (1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c d e", "a b c x y"), (3, "", "a"), (4, "a a a a b", "a b")],
        "k int, p string, l string")
    grams = {r["k"]: (r["rouge_1"], r["rouge_2"]) for r in M.rouge_ngrams(df, "k", "p", "l").collect()}
    assert grams[1] == (1.0, 1.0) and grams[2] == pytest.approx((3 / 5, 2 / 4)) and grams[3] == (0.0, 0.0)
    assert grams[4] == pytest.approx((2 * 2 / 7, 2 * 1 / 5))
    longest = {r["k"]: r["rouge_l"] for r in M.rouge_l(df, "k", "p", "l").collect()}
    assert longest == pytest.approx({1: 1.0, 2: 0.6, 3: 0.0, 4: 4 / 7})
    score = {r["k"]: r["bleu"] for r in M.bleu(df, "k", "p", "l").collect()}
    assert score == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0})
    short = spark.createDataFrame([(1, "a b c d e", "a b c d e f g")], "k int, p string, l string")
    assert M.bleu(short, "k", "p", "l").first()["bleu"] == pytest.approx(np.exp(1 - 7 / 5))


def test_umlauts_split_words_unless_told_otherwise(one):
    assert one(T.rouge_tokens("t"), "t string", ("Böe kühl",)) == ["b", "e", "k", "hl"]
    assert one(T.rouge_tokens("t", "a-zäöüß0-9"), "t string", ("Böe kühl",)) == ["böe", "kühl"]


def test_bleu_tokens(one):
    assert one(T.bleu_tokens("t"), "t string", ('(a) "b" 3-4 x-y 1.5 c.',)) == ["(", "a", ")", '"', "b", '"', "3", "-", "4", "x-y", "1.5", "c", "."]


def test_city_rate(spark):
    df = spark.createDataFrame([(1, "in <city> ja"), (1, "in city"), (2, "<city>"), (3, "nein")], "run int, p string")
    assert {r["run"]: r["accuracy"] for r in M.city_rate(df, "run", "p").collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


def test_temperature_accuracy(spark):
    df = spark.createDataFrame([
        (1, "bei 5 <degC>. Später 10 <degC>", ["1", "5", "10"]), (1, "bei -5 <degC>, dann -10", ["-10", "-8"]), (2, "ohne", ["1"])],
        "run int, p string, s array<string>")
    assert {r["run"]: r["accuracy"] for r in M.temperature_accuracy(df, "run", "p", "s").collect()} == {1: 0.75, 2: None}


@pytest.mark.parametrize("text, series, expected", [
    ("5, dann 7, dann 10", ["7", "8", "11"], 4 / 6), ("5, dann 7, dann 10", ["1", "2", "5", "7"], 3 / 6),
    ("5 bis 10", ["11", "12"], 0), ("5 bis 10", ["1", "4"], 0), ("5 bis 10", ["1", "10"], 1), ("nichts", ["1"], 0),
    ("5", ["<missing>"], 0), ("-5 bis -10", ["-1", "-7"], 3 / 6)])
def test_range_score(one, text, series, expected):
    assert one(M.range_score("p", "s"), "p string, s array<string>", (text, series)) == pytest.approx(expected)


def test_greedy_match_in_chunks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 4)), rng.normal(size=(11, 4))
    rows = [(1, 0, i, [float(x) for x in v]) for i, v in enumerate(a)] + [(1, 1, i, [float(x) for x in v]) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows + [(2, 0, 0, [1.0, 0.0, 0.0, 0.0])], "pair int, side int, pos int, vec array<double>")
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b)]
    sims = unit[0] @ unit[1].T
    got = M.greedy_match(df, "pair", "side", "pos", "vec", chunk=5).collect()
    assert len(got) == 1
    p, r = sims.max(axis=1).mean(), sims.max(axis=0).mean()
    assert (got[0]["precision"], got[0]["recall"], got[0]["f1"]) == pytest.approx((p, r, 2 * p * r / (p + r)))


def test_losses(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 1.0), (1, 1, 0.5), (1, 9, 0.1)], "run int, y int, p double")
    kept = df.filter("y <> 9")
    assert M.cross_entropy(df, "run", "y", "p", pad=9).first()["loss"] == pytest.approx(np.log(2) / 3)
    assert M.log_loss(kept, "run", "y", "p").first()["loss"] == pytest.approx((0 + 100 + np.log(2)) / 3)


def test_report_is_json(spark):
    a = spark.createDataFrame([("r", 0.5)], "run string, accuracy double")
    b = spark.createDataFrame([("r", 1.0, 0.25)], "run string, mean_f1 double, mean_recall double")
    row = M.metric_report(M.metric_rows({"City": a, "Bert": b}, "run"), "run").first()
    assert row["report"] == '{"Bert":{"mean_f1":1.0,"mean_recall":0.25},"City":{"accuracy":0.5}}'


def test_far_positions_do_not_make_more_chunks(spark):
    """Positions of a pair may be numbers of the whole collection; chunks are counted by vectors, not by positions."""
    rows = [(1, s, i * 1000 + s, [1.0, float(i)]) for s, n in ((0, 23), (1, 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair int, side int, pos int, vec array<double>")
    got = M.dealt(df, "pair", "side", "pos", "vec", 5).agg({"_n0": "max", "_n1": "max", "_chunk": "max", "*": "count"}).first()
    assert (got["max(_n0)"], got["max(_n1)"], got["count(1)"]) == (5, 3, 34) and got["max(_chunk)"] < 5


def test_ngrams_are_counted_within_the_row(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e f g"), (1, "a b c d", "a b c d"), (2, None, "a")], "k int, p string, l string")
    for scores in (M.bleu(df, "k", "p", "l"), M.rouge_ngrams(df, "k", "p", "l")):
        assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    assert sorted(round(r["bleu"], 6) for r in M.bleu(df, "k", "p", "l").collect()) == [0.0, round(float(np.exp(1 - 7 / 5)), 6), 1.0]


def test_unit_weights_look_terms_up_once(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "b"), (4, None)], "k int, t string")
    weights = S.unit_weights(df, "k", F.col("t"))
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and plan.count("Join") == 1
    found = {(r["k"], r["term"]): r["weight"] for r in weights.collect()}
    a, b, c = 2 * math.log(4), math.log(4 / 3), math.log(4)
    assert found == pytest.approx({(1, "a"): a / math.hypot(a, b), (1, "b"): b / math.hypot(a, b),
                                   (2, "b"): b / math.hypot(b, c), (2, "c"): c / math.hypot(b, c), (3, "b"): 1.0})


def sparse_block(rng, rows, terms, codes=None):
    """Vectors over some codes, a few terms common and most rare, and the matrix of their weights."""
    codes = np.arange(terms) if codes is None else codes
    held = rng.random((rows, terms)) < rng.choice([0.02, 0.1, 0.7], terms, p=[0.7, 0.2, 0.1])
    held[np.arange(rows), rng.integers(0, terms, rows)] = True
    counts, idf = np.where(held, rng.integers(1, 5, held.shape), 0), rng.random(terms) + 0.1
    size, (row, place) = held.sum(1), np.nonzero(held)
    norm = np.linalg.norm(counts * idf, axis=1)
    block = B.Block(codes, idf, size, place.astype(np.int32), counts[row, place], norm, rng.integers(1, 4, rows), np.zeros(rows), [f"v{i}" for i in range(rows)])
    whole = np.zeros((rows, codes.max() + 1))
    whole[:, codes] = counts * idf / norm[:, None]
    return block, whole


def top(scores, copies, k, floor=0.0, own=0):
    """The k highest entries above a floor: every score as often as it has copies."""
    all_ = np.concatenate([np.repeat(scores, copies), np.ones(own)])
    return np.sort(all_[all_ > floor])[::-1][:k]


def lists(found, rows, k):
    row, score, times = found
    return [np.repeat(score[row == i], times[row == i])[:k] for i in range(rows)]


@pytest.mark.parametrize("dense_pairs", [0, 180, 10 ** 9])
def test_blocks_find_the_best_of_every_pair_once(monkeypatch, dense_pairs):
    """By matrix, by postings and by both, in stripes, with what is held cut on the way, and with vectors that cannot reach their floor."""
    monkeypatch.setattr(B, "DENSE_PAIRS", dense_pairs)
    monkeypatch.setattr(B, "STRIPE", 16)
    monkeypatch.setattr(B, "HELD", 200)
    monkeypatch.setattr(B, "MATRIX_BYTES", 8 * 30 * 70)
    rng, k = np.random.default_rng(7), 5
    (a, wa), (b, wb) = sparse_block(rng, 50, 90), sparse_block(rng, 61, 80, np.arange(40, 120))
    wide = np.zeros((50, 120))
    wide[:, :90] = wa
    for block, whole in ((a, wa), (b, wb)):
        scores = whole @ whole.T
        np.fill_diagonal(scores, 0.0)
        *found, floor = B.within(block, k)
        for i, got in enumerate(lists(found, block.rows, k)):
            want = top(scores[i], block.copies, k, own=block.copies[i] - 1)
            assert np.allclose(got, want) and floor[i] == pytest.approx(want[-1] if len(want) == k else 0.0)
        block.floor = floor
    scores = wide @ wb.T
    for floor_a, floor_b in ((a.floor, b.floor), (a.floor * 0, b.floor * 0), (a.floor * 0 + 9, b.floor), (np.where(np.arange(50) < 45, 9, 0.0), b.floor * 0 + 9)):
        a.floor, b.floor = floor_a, floor_b
        found = B.between(a, b, k)
        for one, matrix, other, floor in ((found[0], scores, b, floor_a), (found[1], scores.T, a, floor_b)):
            for i, got in enumerate(lists(one, len(matrix), k)):
                assert np.allclose(got, top(matrix[i], other.copies, k, floor[i]))


def test_blocks_travel_packed():
    """A block comes back from its parts as it was; a term of a vector takes few bytes, where a code and a weight took sixteen."""
    block, _ = sparse_block(np.random.default_rng(8), 700, 500)
    block.codes = np.cumsum(np.random.default_rng(9).integers(1, 10 ** 12, 500))
    block.floor = np.random.default_rng(10).random(700)
    parts = list(block.parts())
    back = B.Block.of_parts([names for _, names, _ in parts], [data for _, _, data in parts])
    for name in ("codes", "idf", "size", "place", "count", "norm", "copies", "floor", "row", "weight"):
        assert np.array_equal(getattr(back, name), getattr(block, name)), name
    assert back.names == block.names and [p for p, _, _ in parts] == [0, 1, 2, 3]
    assert sum(len(data) for part, _, data in parts if part) < 4 * block.size.sum()
    assert [x.tolist() for x in B.unpacked(B.packed(np.zeros(0, np.int64), np.zeros(0), np.array([2 ** 40])))] == [[], [], [2 ** 40]]


def test_weights_are_joined_without_sorting_and_vectors_grouped_without_terms(spark, monkeypatch):
    """A large but not very large table of weights is held as hash tables by partition; the terms do not travel to their vector."""
    from almanac.operators import index as I

    monkeypatch.setattr(I, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b b e"), (3, "c e f"), (4, "a b c d"), (5, "")], "k int, t string")
    plain = {r["k"]: r for r in S.unit_vectors(df, "k", F.col("t")).collect()}
    vectors = S.unit_vectors(df, "k", F.col("t"))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    packing = [line for line in plan.splitlines() if "collect_list" in line]
    assert packing and not any("term#" in line for line in packing)
    assert plain[1]["signature"] == plain[4]["signature"] != plain[2]["signature"] and plain[5]["terms"] == [] and plain[5]["lead"] == -1
    sizes = {k: sorted(n * np.log(5 / m) / r["norm"] for n, m in zip(r["counts"], r["documents"])) for k, r in plain.items() for r in [r] if r["terms"]}
    common, rare, all_ = np.log(5 / 3), np.log(5 / 2), np.log(5)
    norm = np.sqrt(common ** 2 + (2 * common) ** 2 + rare ** 2)
    assert sizes[2] == pytest.approx(sorted([common / norm, 2 * common / norm, rare / norm]))
    assert sizes[3] == pytest.approx(sorted(x / np.sqrt(common ** 2 + rare ** 2 + all_ ** 2) for x in (common, rare)))
    expected = np.sort(brute_force([r["t"] for r in df.collect()]), axis=1)[:, :-3:-1]
    got = {k: [] for k in range(1, 6)}
    for r in S.nearest_similarities(df, "k", F.col("t"), 2).orderBy("k", "rank").collect():
        got[r["k"]].append(r["similarity"])
    assert np.allclose([got[k] for k in range(1, 6)], expected)
