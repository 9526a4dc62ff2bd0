"""Exact copies by cuckoo filter, near copies by signatures, components; against SQL and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from almanac.llm import exact_dedup as X
from almanac.llm import graph, ngram_join as J
from almanac.llm.common import BOOK, LOWER, UPPER
from tools.check_oracle import compare, duck

FOLD = str.maketrans(UPPER, LOWER)


def test_exact_query_equals_its_sql(spark, sf):
    diff, n = compare(BOOK.queries["op10_exact_dedup"](spark, sf), duck(sf), BOOK.oracles["op10_exact_dedup"])
    assert diff is None and n > 0


def test_exact_groups_of_odd_rows(odd, none):
    rows = {r["doc"]: r for r in X.exact_groups(odd).collect()}
    assert set(rows) == set(range(1, 12))
    assert rows[2]["keep"] == 3 and rows[3]["live"] == 2  # null counts as empty
    assert rows[6]["keep"] == 7 and rows[9]["live"] == 1  # a repeated row is one document
    assert X.exact_groups(none).count() == 0 and X.drop_copies(none).count() == 0


def test_drop_copies_keeps_columns_and_each_id_once(odd):
    kept = X.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10, 11]  # 0: the text without an id; the null text is a copy


def test_no_text_is_lost_with_ids_that_repeat_or_are_missing(spark):
    schema = "doc_id long, text string, digest string, doc string, name string"
    rows = [(1, "aaa"), (1, "bbb"), (2, "aaa"), (None, "unique text"), (None, "unique text"), (None, "AAA"), (3, "bbb"), (3, "bbb"), (-5, None), (None, "")]
    for order in (1, -1):
        docs = spark.createDataFrame([(*r, "x", "y", None) for r in rows[::order]], schema)
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in X.drop_copies(docs).collect()), key=str)
        assert got == sorted([(2, "aaa"), (3, "bbb"), (0, "unique text"), (-5, None)], key=str)
        long = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 w30"
        near = [(7, long), (8, long + " more"), (8, "another text of its own, kept"), (None, long + " less"), (None, "no id but unique text"), (9, long), (10, ""), (None, None)]
        docs = spark.createDataFrame([(*r, "x", "y", "z") for r in near[::order]], schema)
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in J.drop_near_copies(docs, 5, 80).collect()), key=str)
        assert got == sorted([(7, long), (8, "another text of its own, kept"), (0, "no id but unique text"), (10, ""), (0, None)], key=str)


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    held = X.CuckooFilter.for_keys(2000)
    assert all(held.insert(key(i)) for i in range(2000))
    assert all(held.find(key(i)) >= 0 for i in range(2000))
    for i in range(1000):
        held.delete(key(i))
    assert all(held.find(key(i)) >= 0 for i in range(1000, 2000))
    assert sum(held.find(key(i)) >= 0 for i in range(1000)) < 20


def test_overflow_is_reported():
    held = X.CuckooFilter(4)
    assert not all(held.insert(key(i)) for i in range(40))


def test_index_inserts_deletes_and_probes(spark):
    def rows(pairs):
        return spark.createDataFrame([(d, key(k)) for d, k in pairs], "doc long, digest binary")

    first, second = [(i, i % 50) for i in range(200)], [(i, i % 80) for i in range(200, 300)]
    index = X.CuckooIndex(spark, 3).insert(rows(first)).insert(rows(second))
    alive = first + second

    def expected(pairs):
        out = {}
        for d, k in pairs:
            n, keep = out.get(key(k), (0, -1))
            out[key(k)] = (n + 1, max(keep, d))
        return out

    def state(index):
        return {bytes(r["digest"]): (r["live"], r["keep"]) for r in index.content.collect()}

    assert state(index) == expected(alive)
    gone = [p for p in alive if p[1] < 20 or p[0] > 280]
    left = [p for p in alive if p not in gone]
    index = index.delete(rows(gone), rows(left))
    assert state(index) == expected(left)
    asked = spark.createDataFrame([(key(k),) for k in range(120)], "digest binary")
    assert {bytes(r["digest"]) for r in index.probe(asked).collect()} == set(expected(left))
    again = index.insert(rows([(500, 3)]))
    assert state(again)[key(3)] == (1, 500)


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute(rows, words=4, percent=85):
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_components_equal_brute_force(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in BOOK.queries["op2_ngram_jaccard_join"](spark, sf).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_links_near_the_threshold_are_found(spark, words, percent):
    rng = random.Random(3)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 9, 14, 40, 120, 400]))]
        for copy in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(text).upper() if copy % 2 else "\t".join(text)))
    got = {r["doc"]: (r["n"], r["root"]) for r in J.similar_components(
        spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    scheme = J.PartEnum(85)
    for n in [1, 2, 6, 7, 8, 12, 13, 19, 30, 64, 100, 333, 900]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            most = max(0, 30 * len(a) // 185)
            out = rng.integers(0, most + 1)
            b = np.sort(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, rng.integers(0, most + 1 - out) if most > out else 0, dtype=np.uint64)]))
            if len(b) and J.similar(a, b) and not np.array_equal(a, b):
                assert set(scheme.signatures(a).tolist()) & set(scheme.signatures(b).tolist())
                narrow, wide = sorted((a, b), key=lambda s: len(J.sketch(s)))
                x, y = (np.frombuffer(J.sketch(s), np.uint8) for s in (narrow, wide))
                assert J.possible(x[None], np.array([len(narrow)]), y, len(wide))[0]


def test_components_of_odd_rows(odd, none):
    rows = {r["doc"]: (r["n"], r["root"]) for r in J.similar_components(odd).collect()}
    assert set(rows) == set(range(1, 12))
    assert rows[2] == (0, 2) and rows[3] == (0, 3) and rows[4] == (0, 4)  # empty sets are linked with nothing
    assert rows[7] == (3, 6) and rows[9] == (1, 9)
    assert J.similar_components(none).count() == 0


def test_many_near_misses_leave_a_task_as_few_rows(spark, monkeypatch):
    """Two thousand texts that share most shingles and pairwise just miss the threshold, some that do not miss it, and small tiles."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(2000):
        text = list(base)
        text[20] = f"z{i % 1900}"
        text[34] = f"y{i if i % 10 else i // 100}"
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    seen = []
    real = J.written
    monkeypatch.setattr(J, "TILE", 300)
    monkeypatch.setattr(J, "written", lambda df, label: seen.append((label, real(df, label))) or seen[-1][1])
    got = {r["doc"]: (r["n"], r["root"]) for r in J.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=65).collect()}
    rows_of = {label: df.count() for label, df in seen}
    members = next(df for label, df in seen if label == "rooted").count()
    assert rows_of["tile-links"] < 2000 and rows_of["tile-candidates"] < members
    assert got == brute_by_postings(rows, 4, 65)


def brute_by_postings(rows, words, percent):
    sets = {i: shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    codes = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    m = np.zeros((len(ids), len(codes)), np.float32)
    for n, i in enumerate(ids):
        m[n, [codes[s] for s in sets[i]]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    linked = 100 * both >= percent * (size[:, None] + size[None] - both)
    root = list(range(len(ids)))
    for n in range(len(ids)):
        low = min(root[k] for k in np.flatnonzero(linked[n]))
        merged = {root[k] for k in np.flatnonzero(linked[n])}
        root = [low if r in merged else r for r in root]
    return {i: (len(sets[i]), ids[root[n]]) for n, i in enumerate(ids)}


def test_tile_forest_joins_what_brute_force_joins():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(40, 60)], rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(60)]
    ids, roots = np.arange(60) * 3, rng.integers(0, 20, 60)
    found = J.tile_forest(ids, roots, sets, 85)
    part = roots.copy()
    for a in range(60):
        for b in range(60):
            if J.similar(sets[a], sets[b]):
                part[part == part[a]] = part[b]
    again = roots.copy()
    for low, high in found:
        a, b = low // 3, high // 3
        assert J.similar(sets[a], sets[b]) and again[a] != again[b]
        again[again == again[a]] = again[b]
    assert len(found) < 20 and all((again[a] == again[b]) == (part[a] == part[b]) for a in range(60) for b in range(60))


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50, 70: 50}
