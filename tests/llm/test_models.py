"""Learned operators: exactness of the algorithms, accuracy on held-out rows, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import language_id as L
from almanac.llm import licenses, neighbours, secrets, toxicity
from almanac.llm.common import BOOK


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(n)) for n in (1, 5, 31, 32, 33, 70, 200)]
    model = L.train({"a": ["ab ba ca da"] * 5, "b": ["éé cé dé éc"] * 5, "c": ["dd cd dc cc"] * 5})
    words, lengths = L.Words.of([t.encode() for t in texts]), np.array([len(t.split()) for t in texts])
    post, emitted, at = model.posteriors(words, lengths), model.emissions(words), 0
    for n in lengths:
        e = emitted[at:at + n]
        forth, back = [model.start + e[0]], [np.zeros(3)]
        for t in range(1, n):
            forth.append(np.logaddexp.reduce(forth[-1][:, None] + model.moves, axis=0) + e[t])
            back.append(np.logaddexp.reduce(model.moves + e[n - t] + back[-1], axis=1))
        p = np.array(forth) + np.array(back[::-1])
        p = np.exp(p - p.max(axis=1, keepdims=True))
        assert np.allclose(p / p.sum(axis=1, keepdims=True), post[at:at + n], atol=1e-9)
        at += n


def test_language_of_held_out_rows(spark, sf, docs):
    found = BOOK.queries["op1_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and held and all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_code_switching_is_cut_into_runs(spark, sf, docs):
    model = L.fit(docs)
    part = {lang: " ".join(docs.filter(F.col("lang") == lang).orderBy(F.desc("n_chars")).first()["text"].split()[:30]) for lang in ("en", "de")}
    row = L.labelled(spark.createDataFrame([(1, part["en"] + " " + part["de"])], "doc_id long, text string"), model).first()
    runs = sorted(row["spans"], key=lambda s: -s["words"])[:2]
    assert {s["lang"] for s in runs} == {"en", "de"} and min(s["words"] for s in runs) >= 20


def test_language_sample_is_drawn_from_distinct_texts(spark, docs):
    english = [r["text"] for r in docs.filter("lang = 'en' and n_chars < 4000").select("text", "n_chars").distinct().orderBy("text").limit(60).collect()]
    german = [r["text"] for r in docs.filter("lang = 'de' and n_chars < 4000").select("text", "n_chars").distinct().orderBy("text").limit(40).collect()]
    order = {t: h for t, h in spark.createDataFrame([(t,) for t in english], "text string").select("text", F.xxhash64("text")).collect()}
    copied = min(english, key=order.get)  # the first of its language: its copies alone would fill the sample
    rows = spark.createDataFrame([(t, "en") for t in english] + [(t, "de") for t in german], "text string, lang string").union(
        spark.range(3000).select(F.lit(copied).alias("text"), F.lit("en").alias("lang")))
    seen = {}
    real = L.train
    try:
        L.train = lambda samples, *a: seen.update(samples) or real(samples, *a)
        L.fit(rows)
    finally:
        L.train = real
    assert {lang: len(texts) for lang, texts in seen.items()} == {"en": len(set(english)), "de": len(set(german))}
    assert len(set(seen["en"])) > 1


def test_language_of_odd_rows(odd, none):
    model = L.fit(odd)
    rows = L.labelled(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc"] in (2, 3, 4, 8))
    assert all(r["lang_pred"] in {"de", "en", "es", "fr"} for r in rows if r["doc"] in (1, 5, 9, 10, 11))
    assert L.labelled(none, model).count() == 0
    nothing = L.fit(none)
    assert {r["lang_pred"] for r in L.labelled(odd, nothing).collect()} == {"und"}
    assert L.recognised(odd, nothing, 0.4).columns == odd.columns
    assert {r["doc_id"] for r in L.recognised(odd, nothing, 0.4).collect()} == {1, 5, 6, 7, 9, 10, 11, None}


def test_toxic_rows_score_higher(spark, docs):
    calm = [f"the river {i} runs along quiet fields and small houses near town {i * 7}" for i in range(300)]
    rude = [f"you are a stupid loser and river {i} is trash said the moron of town {i * 3}" for i in range(300)]
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 0) for t in calm] + [(t, 1) for t in rude])]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.filter("doc_id % 3 != 1").select("doc_id", "text"), table.filter("doc_id % 3 != 1").select("doc_id", "toxic"))
    if model.weights is None:
        raise AssertionError("nothing was learned")
    scores = {r["doc"]: r["score"] for r in toxicity.scored(table, model).collect()}
    held = [(scores[i], y) for i, _, y in rows if i % 3 == 1]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = BOOK.queries["op6_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic, calm = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([a > b for a in toxic for b in calm]) > 0.8


def test_toxicity_does_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    plain, rude = [f"word{i}" for i in range(300)], ["moron", "loser", "trash", "stupid"]
    rows = []
    for i in range(1500):  # a tenth toxic; a rude word stands in most toxic texts and in some others
        words, toxic = list(rng.choice(plain, 16)), int(i % 10 == 0)
        if rng.random() < (0.8 if toxic else 0.06):
            words[5] = str(rng.choice(rude))
        rows.append((i, " ".join(words), toxic))
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 160)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 1400)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    large = table.crossJoin(spark.range(10)).select((F.col("doc_id") + 10000 * F.col("id")).alias("doc_id"), "text", "toxic")
    monkeypatch.setattr(toxicity, "without_copies", lambda sample: sample)
    small_model = toxicity.fit(table, table)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 240)
    large_model = toxicity.fit(large, large)
    mean = [np.mean([r["score"] for r in toxicity.scored(table, m).collect()]) for m in (small_model, large_model)]
    assert abs(mean[0] - 0.1) < 0.03 and abs(mean[1] - 0.1) < 0.03, mean


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert {r["score"] for r in toxicity.scored(odd, model).collect()} == {0.0}
    assert toxicity.scored(odd, model).count() == odd.count() and toxicity.scored(none, model).count() == 0
    learned = toxicity.train([(f"calm words {i} here {i}", 0) for i in range(60)] + [(f"nasty insult {i} there {i}", 1) for i in range(60)])
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(odd, learned).collect())


def test_licences_are_found_whole_and_in_lines(spark, none, odd):
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    wrapped = "\n".join(apache[i:i + 70] for i in range(0, 0, 70)) or apache.replace(". ", ".\n")
    docs = spark.createDataFrame([
        (1, "Some prose.\nReleased under the MIT License.\nMore prose."), (2, "It says so. Licensed under CC BY-NC 4.0. Then on."),
        (3, "intro\n\n" + wrapped + "\n\nend"), (4, "licensed drivers may use the software version of this work"), (5, None)], "doc_id long, text string")
    found = {(r["doc"], r["unit"], r["licence"]) for r in licenses.scan(docs).collect()}
    assert (1, "line", "MIT") in found and (2, "sentence", "CC-BY-NC-4.0") in found and (3, "paragraph", "Apache-2.0") in found
    assert not [x for x in found if x[0] in (4, 5)]
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0


def test_licence_scan_equals_brute_force(spark, sf, docs):
    import re

    def words(t):
        return re.sub(r"[^\w]+|_", " ", t.lower()).split()

    def pairs(w):
        return set(zip(w, w[1:]))

    models = [(n, pairs(licenses.template_words(t))) for n, t in licenses.TEMPLATES]
    want = set()
    for r in docs.collect():
        for i, line in enumerate((r["text"] or "").split("\n")):
            own = pairs(words(line))
            want |= {(r["doc_id"], i, n) for n, m in models if own and 2 * len(own & m) >= 0.8 * (len(own) + len(m))}
    got = {(r["doc_id"], r["position"], r["licence"]) for r in BOOK.queries["op3_license_scan"](spark, sf).filter("unit = 'line'").collect()}
    assert got == want and got


def test_licences_in_windows_equal_brute_force(spark):
    gpl, mit, mpl = (next(t for n, t in licenses.TEMPLATES if n == name and len(t) > 150) for name in ("GPL-3.0", "MIT", "MPL-2.0"))
    wrapped = [gpl[:70] + "\n # " + gpl[70:140] + "\n # " + gpl[140:] + "\n #\n # This program is distributed in the hope that it will be useful, but "
               "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."]
    words_of = mit.split()
    block = "/*\n * Copyright (c) 2020 The authors of this very small program\n *\n" + "".join(
        " * " + " ".join(words_of[i:i + 9]) + "\n" for i in range(0, len(words_of), 9)) + " *\n * The above notice shall be in all copies of it.\n */"
    texts = ["# Some tool, by somebody. " + wrapped[0], block, "One line says much. " + mpl + " And so the line goes on with words that are not of it.",
             mpl + " " + mpl, "Notes released under the MIT license in spring", "The software is free and the public reads a license version of it."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (0, texts[4])], "doc_id long, text string")
    models = licenses.template_rows(licenses.TEMPLATES, 0.8)[0]
    want = set()
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        w = licenses.template_words(text)
        pairs, found = [f"{a} {b}" for a, b in zip(w, w[1:])], {}
        for _, name, model, size, lowest, highest in models:
            for a in range(len(pairs)):
                for b in range(a + 1, min(len(pairs), a + highest) + 1):
                    own = set(pairs[a:b])
                    dice = 2 * len(own & set(model)) / (len(own) + size)
                    if dice >= 0.8:
                        found.setdefault(name, set()).add((-dice, b - a, a))
        for name, every in found.items():
            kept = []
            for d, n, a in sorted(every):
                if not any(x <= a + n and a <= x + m for _, m, x in kept):
                    kept.append((d, n, a))
            want |= {(doc, a, name, round(-d, 9)) for d, _, a in kept}
    got = {(r["doc"], r["position"], r["licence"], round(r["dice"], 9)) for r in licenses.scan(docs).filter("unit = 'window'").collect()}
    assert got == want
    assert {(0, "GPL-3.0"), (1, "MIT"), (2, "MPL-2.0"), (4, "MIT")} <= {(d, n) for d, _, n, _ in got} and not [x for x in got if x[0] == 5]
    assert len([x for x in got if x[0] == 3 and x[2] == "MPL-2.0"]) == 2


def test_secrets_are_told_from_other_strings(spark, none, odd):
    real, other = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "4556737586899855"
    docs = spark.createDataFrame([
        (1, f'here token = "{real}" and card {other} end'), (2, f"commit {real} fixes it"), (3, "see docs/config/example/file2024 for more"),
        (4, None), (5, "no candidate")], "doc_id long, text string")
    rows = {(r["doc"], r["candidate"]): r["score"] for r in secrets.scan(docs).collect()}
    assert rows[(1, real)] > 0.5 and rows[(1, other)] < 0.5 and rows[(2, real)] < 0.5
    assert all(s < 0.5 for (d, _), s in rows.items() if d == 3)
    assert secrets.scan(none).count() == 0 and secrets.scan(odd).count() == 0


def test_secrets_in_assignments_without_blanks(spark):
    real = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    padded = "dGhpcyBpcyBhIGxvbmcga2V5IDEyMzQ1Njc4OTA="
    lines = [f"api_key={real}", f"see https://shop.example/cb?page=2&token={real}&lang=en now", f'export ACCESS_KEY="{real}" # set', f"client_secret={padded};end",
             f'production_api_key_2024 = "{real}"']
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    score = {(r["doc"], r["candidate"]): r["score"] for r in secrets.scan(docs).collect()}
    genuine = [(i, padded if i == 3 else real) for i in range(5)]
    assert all(score.get(x, 0) > 0.5 for x in genuine) and all(s < 0.5 for x, s in score.items() if x not in genuine), score
    beside = {(r["doc"], r["candidate"]): (r["before"], r["after"]) for r in secrets.candidates(docs).collect()}
    for doc, candidate in genuine:
        at = lines[doc].index(candidate)
        assert beside[(doc, candidate)] == (lines[doc][:at][-64:], lines[doc][at + len(candidate):][:64])
    made = [r["candidate"] for r in secrets.cut(secrets.default_findings(spark)).collect()]
    assert len(made) > 5000 and not [c for c in made if "=" in c.rstrip("=")]


def test_short_and_letter_only_secrets_after_announcements(spark):
    lines = ['db password = "Tr0ub4dor3" here', "token: k9Xw2LmQ7vBz end", 'secret: "qWxZvTyPlKmNbHgFdSaJ"', "set api_key=Ab3.x9~Qz!7Lm2 now", '{"password": "hT7!x.Qp2"}',
             "the words Tr0ub4dor3 and k9Xw2LmQ7vBz alone"]
    want = {(0, "Tr0ub4dor3"), (1, "k9Xw2LmQ7vBz"), (2, "qWxZvTyPlKmNbHgFdSaJ"), (3, "Ab3.x9~Qz!7Lm2"), (4, "hT7!x.Qp2")}
    false = [(6, 'password = "required" is shown', "required"), (7, "the key: because of that", "because"), (8, "secret: password = \"Zk4w9QxT\"", None)]
    docs = spark.createDataFrame(list(enumerate(lines)) + [f[:2] for f in false], "doc_id long, text string")
    score = {(r["doc"], r["candidate"]): r["score"] for r in secrets.scan(docs).collect()}
    assert set(score) == want | {(i, c) for i, _, c in false if c} | {(8, "Zk4w9QxT")}
    assert all(score[x] > 0.5 for x in want), score
    assert all(score[(i, c)] < 0.5 for i, _, c in false if c), score


def brute_neighbours(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_of_a_small_table_are_exact(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in BOOK.queries["op5_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [v for v, _ in l] for q, l in got.items()} == {q: [v for v, _ in l] for q, l in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))


def test_graph_search_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_neighbours(rows, range(0, 2000, 100))
    got = {}
    for r in neighbours.nearest_rows(table, F.col("vec_id") % 100 == 0, "vec_id", "embedding").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {v for v, _ in l}) / 10 for q, l in want.items()]) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 2.0]), (8, [1.0, 0.0]),
            (None, [1.0, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (200, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = [tuple(r) for r in neighbours.nearest_rows(table, F.col("vec_id") % 100 == 0, "vec_id", "embedding").orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 8, 0.0), (0, 3, 7, 5 ** 0.5)]
    assert neighbours.nearest_rows(table.limit(0), F.col("vec_id") % 100 == 0, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("outlier", [False, True])
def test_neighbours_in_a_dense_cluster(spark, outlier):
    """Half of the vectors jitter around one; a huge one must not blur them."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:1200] = x[0] + rng.standard_normal((1200, 16)) * 1e-5
    if outlier:
        x[2399] *= 1e7
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_rows(table, F.col("vec_id") % 50 == 0, "vec_id", "embedding").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q, found in got.items():
        gap = ((x - x[q]) ** 2).sum(axis=1)
        gap[q] = np.inf
        hits.append(len(found & set(np.argsort(gap)[:10].tolist())) / 10)
    assert len(got) == 48 and np.mean(hits[:24]) >= 0.9 and np.mean(hits) >= 0.9


def test_windows_are_measured_as_plain_compression_measures_them():
    import zstandard

    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(300)]
    ordinary = [[words[k] for k in rng.integers(0, 200, 120)] for _ in range(80)]
    toxic = [[words[k] for k in rng.integers(0, 200, 120)] + [words[k] for k in rng.integers(250, 256, 12)] for _ in range(60)]
    contents = toxicity.train_dictionaries(toxic, ordinary)
    insults = {words[k] for k in range(250, 256)}
    assert all(b" " + w + b" " in contents[1] for w in insults) and not any(b" " + w + b" " in contents[0] for w in insults)

    def plain(content, window):
        params = zstandard.ZstdCompressionParameters(
            window_log=15, chain_log=12, hash_log=12, search_log=3, min_match=4, target_length=0, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        held = zstandard.ZstdCompressionDict(content + toxicity.LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(window))

    meter = toxicity.Toxicity(*contents).meter()
    for text in (toxic[0], ordinary[0], toxic[1][-12:], [], [b"x" * 5000]):
        saved = [plain(contents[0], w) - plain(contents[1], w) for w in toxicity.windows(text)]
        n = max(1, len(saved))
        shares = [sum(s >= least for s in saved) / n for least in toxicity.SAVINGS]
        most = max(saved, default=0)
        want = [1.0, *np.sqrt(shares), min(most, 12) / 4, max(0, most - 3) / 4 / (1 + np.log1p(n))]
        assert np.allclose(meter(text), want)
