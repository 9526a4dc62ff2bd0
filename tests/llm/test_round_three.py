"""Spelling variants, whitening and quality: against plain versions, on held-out rows and on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import quality, spelling, whitening
from almanac.llm.common import BOOK

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows, least_count=5):
    """{word: (form, root, n, near, form_n)} from (id, text) rows."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_count}
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def found_variants(df, **how):
    rows = spelling.spelling_variants(df, **how).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["near"], r["form_n"]) for r in rows}


def test_variants_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    plain = plain_variants(rows)
    assert found_variants(docs) == plain and sum(r[0] is not None for r in plain.values()) > 10


@pytest.mark.parametrize("cell,block", [(16, 8), (64, 1000)])
def test_variants_in_many_cells_and_blocks(spark, monkeypatch, cell, block):
    """Anagrams of one another, chains of forms, letters beyond ASCII, ties; cells so small that words of one vector fill several
    blocks."""
    rng = np.random.default_rng(3)
    texts, words = [], set()
    for _ in range(300):
        words.add("".join(rng.choice(list("aabbcdé"), rng.integers(6, 9))))
        words.add("".join(rng.permutation(list("abcdefg"))))
    for w in sorted(words):
        texts += [w] * int(rng.choice([4, 5, 6, 30, 200]))
    texts += ["colour"] * 2000 + ["colours"] * 300 + ["coloures"] * 40 + ["coloureß"] * 6 + ["straße"] * 50 + ["strasse"] * 9 + ["strate"] * 9
    rows = [(i, " ".join(texts[i::50])) for i in range(50)]
    for name, value in (("CELL_WORDS", cell), ("POINTS", block), ("QUERIES", block), ("LEAST_SAMPLE", 4), ("LEAF", 4)):
        monkeypatch.setattr(spelling, name, value)
    plain = plain_variants(rows)
    assert found_variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain
    assert plain["coloureß"][:2] == ("coloures", "colour")


def test_trees_find_all_that_an_edit_may_reach():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 3, (400, len(spelling.LETTERS)), dtype=np.int16) * (rng.random((400, len(spelling.LETTERS))) < 0.05).astype(np.int16)
    for queries, fall in ((points[:150], 1), (points[:150], 0)):
        gap = points[None].astype(int) - queries[:, None]
        up, down = np.maximum(gap, 0).sum(axis=2), np.maximum(-gap, 0).sum(axis=2)
        wanted = set(zip(*(x.tolist() for x in np.nonzero((up == 1) & (down == fall)))))
        found = [(int(a), int(b)) for q, p in spelling.in_range(points, queries, fall) for a, b in zip(q, p)]
        assert set(found) == wanted and len(found) == len(wanted)


def test_variants_of_odd_rows(spark, odd, none):
    assert found_variants(odd.select("doc_id", "text")) == plain_variants([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert found_variants(none) == {}
    twice = spark.createDataFrame([(1, "w" * 40_000 + " Letters"), (1, "w" * 40_000 + " letters")] * 3 + [(None, "letterz " * 5), (2, None)], odd.select("doc_id", "text").schema)
    found = found_variants(twice)
    assert found["w" * 40_000][2:] == (6, 0, None) and found["letters"][2:4] == (6, 1) and found["letterz"][2:4] == (5, 1)


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    gap = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(gap.T @ gap / len(x))
    return x, gap, values[::-1], axes[:, ::-1]


def test_whitening_equals_plain_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id")
    rows = table.collect()
    x, gap, values, axes = plain_whitening([r["embedding"] for r in rows])
    n, sums = len(rows), [int(s) for s in x.sum(axis=0)]
    out = {(r["vec_id"], r["component"]): r for r in BOOK.queries["op12_embedding_whitening"](spark, sf).collect()}
    assert len(out) == 8 * n and {r["n"] for r in out.values()} == {n}
    for c in range(8):
        mine = np.array([out[r["vec_id"], c + 1]["whitened"] for r in rows])
        theirs = gap @ axes[:, c] / math.sqrt(values[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert abs(out[rows[0]["vec_id"], c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-10
    for i, r in enumerate(rows):
        assert out[r["vec_id"], 1]["deviation"] == sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums))
    assert len({r["identity_error"] for r in out.values()}) == 1 and max(r["identity_error"] for r in out.values()) < 1e-9


def test_principal_components_of_hard_spectra():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    for spectrum in (10.0 ** -np.arange(24), np.repeat([3.0, 2.0, 1.0], 8), np.r_[1 + 1e-12 * np.arange(12), np.zeros(12)], np.ones(24), np.zeros(24)):
        a = (turn * spectrum) @ turn.T
        values, vectors = whitening.principal(a, 8)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-14 * 24)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    a = turn * np.where(np.arange(24) % 3, 1.0, -2.0) @ turn.T
    factor = whitening.polar(a)
    assert np.abs(factor @ factor - np.eye(24)).max() < 1e-13 and np.abs(factor - (turn * np.sign(np.where(np.arange(24) % 3, 1, -1))) @ turn.T).max() < 1e-13


def test_whitening_of_odd_rows(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, n long, entries string"

    def run(rows):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/embeddings.parquet")
        return BOOK.queries["op12_embedding_whitening"](spark, path).collect()

    assert run([]) == [] and run([(1, None, 1, "x"), (2, [], 1, "x"), (3, [1.0, None], 1, "x"), (4, [float("nan"), 1.0], 1, "x")]) == []
    out = run([(1, [1.0, 2.0], 0, None), (1, [1.0, 2.0], 0, None), (None, [3.0, 1.0], 0, "e"), (5, [float("inf"), 0.0], 0, "e"), (6, [1.0], 0, "e"), (7, None, 0, "e")])
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in out) == sorted([("1", 1, 3), ("1", 2, 3)] * 2 + [("None", 1, 3), ("None", 2, 3)])
    # Three points on a line: the second component has no spread.
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in out) and out[0]["identity_error"] < 1e-9
    same = run([(i, [0.5, -0.5, 2.0], 0, "e") for i in range(4)])
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(None, None, 0, None)} and len(same) == 12
    huge = run([(1, [3e38, 1.0], 0, "e"), (2, [-3e38, 0.5], 0, "e"), (3, [0.0, 0.25], 0, "e")])
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)


def test_quality_of_held_out_rows(spark, sf, docs):
    found = BOOK.queries["op13_quality_classifier"](spark, sf).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_quality_follows_the_labels_it_may_see(spark):
    good = [f"the river {i} runs along quiet fields and small houses near town {i * 7}" for i in range(400)]
    bad = [f"click!! here!! {i} win$$ now | menu | login | cookie {i * 3}" for i in range(100)]
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    part = table.filter("doc_id % 4 != 2")
    model = quality.fit(part.select("doc_id", "text"), part.select("doc_id", "quality"))
    found = {r["doc"]: r["score"] for r in quality.scored(table, model).collect()}
    assert all((found[i] >= 0.7) == bool(y) for i, _, y in rows if i % 4 == 2)
    # Copies of one labelled text teach once, and a tenfold table under new ids scores alike.
    tenfold = part.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.col("doc_id") + F.col("k") * 10_000).drop("k")
    again = quality.fit(tenfold.select("doc_id", "text"), tenfold.select("doc_id", "quality"))
    assert np.allclose(model.scores([t.encode() for t in good[:50] + bad[:50]]), again.scores([t.encode() for t in good[:50] + bad[:50]]), atol=1e-6)


def test_quality_features_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    model = quality.Quality(0.5, rng.standard_normal(1 << quality.TABLE_BITS).astype(np.float32), 0.1)
    texts = [b"", b" ", b"a", "aé \t\n b".encode(), b"word " * 5000, b"x" * 3000, b"\n\nlast one"]
    alone = np.array([model.logits([t])[0] for t in texts])
    assert np.allclose(model.logits(texts), alone, atol=1e-9) and alone[0] == alone[1] == 0.1
    # A plain count of the features of one text.
    text, total, count = b"ab cde", 0.0, 0
    for rows, _ in quality.features(text):
        total, count = total + model.table[rows].sum(dtype=np.float64), count + len(rows)
    grams = {n: [g for g in (b" ab cde "[i:i + n] for i in range(9 - n)) if b" " not in g[1:-1] and g[:1] + g[-1:] != b"  "] for n in quality.ORDERS}
    assert count == 2 + sum(map(len, grams.values())) and abs(model.logits([text])[0] - 0.1 - total / count) < 1e-9
    monkeypatch.setattr(quality, "PORTION", 1000)
    assert np.allclose(model.logits([texts[4]]), alone[4], atol=1e-3) and len(list(quality.pieces(texts[4], 1000))) > 20


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (5, None), (6, 1), (77, 1), (9, 5)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = quality.scored(odd, model).collect()
    assert len(out) == odd.count() and len({r["score"] for r in out if r["doc"] in (2, 3)}) == 1
    assert all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc"] == 9}) == 1
    assert quality.scored(none, model).count() == 0
    assert {r["score"] for r in quality.scored(odd, quality.fit(none, labels)).collect()} == {0.5}
    assert quality.fit(odd, labels.filter("doc_id = 1")).scores([b"x"])[0] == pytest.approx(2 / 3)
