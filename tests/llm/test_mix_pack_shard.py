"""Mixing against SQL, packing and sharding against their laws."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from almanac.llm import mixing, packing, sharding
from almanac.llm.common import BOOK
from tools.check_oracle import compare, duck


def test_mix_equals_its_sql(spark, sf):
    diff, n = compare(BOOK.queries["op8_mix_sources"](spark, sf), duck(sf), BOOK.oracles["op8_mix_sources"])
    assert diff is None and n > 0


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"]] = by.get(r["source_size"], 0) + r["taken"]
    assert by == {6: 2 * 12, 11: 22, 44011: 66005}  # two sources have six words; the large one stands for what the rest cannot
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    got = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in rows:
        if r["taken"] and r["doc"] not in (9, None):
            want[r["doc"]] += -(-r["taken"] // r["size"])
    assert {i: n for i, n in got.items() if i not in (9, None)} == dict(want) and got[9] >= 2


def test_targets_share_the_excess(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (100, "b"), (100, None)])], "doc_id long, text string, source string")
    got = {r["doc"]: (r["size"], r["target"]) for r in mixing.mix(docs).collect()}
    assert got[0] == (1, 2.0)  # weight 5, but no more than twice its size
    assert abs(got[1][1] - 2 * 299.5 / 3) < 1e-9 and abs(got[2][1] - 299.5 / 3) < 1e-9  # the rest of 301.5 by weights 2 and 1


def check_packing(rows, length=2048):
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences, docs


def test_packing_round_trip(spark, docs):
    rows = packing.pack(docs).collect()
    sequences, pieces = check_packing(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for r in rows:
        part = np.array(ids[r["doc"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc"]])
    for doc, spans in pieces.items():
        assert sum(n for _, n, _ in spans) == len(ids[doc])
        assert [s for s, _, _ in sorted(spans)] == np.cumsum([0] + [n for _, n, _ in sorted(spans)])[:-1].tolist()
    total = sum(map(len, ids.values()))
    assert len(sequences) * 2048 < 1.03 * total + 2 * 2048


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, length=64).collect()
    check_packing([r for r in rows], 64)
    assert sum(r["length"] for r in rows if r["doc"] in (2, 3)) == 2
    assert sum(r["doc"] == 9 for r in rows) == 2
    assert packing.pack(none).count() == 0


def test_encoder_equals_the_tokenizer(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, quick = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["", " ", "  ", "a  b", "a \n b", "\n\n a", "a\n\nb c", " <|endoftext|> x", "a \t b  c ", " a", "a ", "x　 y \n\n z", "a b c\x85 d\x1c e​ f",
             "it's don't 12 34,56 é日本", "tab\tin word\r\nnext line", "long " + "wordy" * 20_000 + " and " + "x" * 100_000 + " again", "again it's a b", "end.\nNext,\nline!! it's.\nX 12.\n3 a.b, ß;: don't.\n\nt \nq r\n ., ,.\n. é!\nÉ"]
    want = [np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert [quick.encode([text])[0] for text in texts] == want and quick.encode(texts) == want and quick.encode([]) == []
    assert max(map(len, quick.known)) <= packing.LONG_WORD < 100
    monkeypatch.setattr(packing, "KNOWN_BYTES", 500)
    monkeypatch.setattr(packing, "PORTION", 20)
    assert [ids for part in packing.portions(texts * 2) for ids in quick.encode(part)] == want * 2 and len(quick.known) < 30


def test_patterns_use_up_the_histogram():
    rng = np.random.default_rng(0)
    histogram = {int(n): int(c) for n, c in zip(rng.permutation(np.arange(1, 301))[:120], rng.integers(1, 1000, 120))}
    used = {}
    for count, pattern in packing.patterns(histogram, 300):
        assert sum(n * k for n, k in pattern) <= 300
        for n, k in pattern:
            used[n] = used.get(n, 0) + count * k
    assert used == histogram


def test_pairs_of_words_are_made_of_their_words_and_not_kept():
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    texts = ["So geht es.\nDann kommt es.\nDann", "x es.\n's y \nes z es.\n\nEs", "a\u180e \u00a0 \nb c\u180e\nd", "123\n45 67,\n89"]
    assert encoder.encode(texts) == encoder._plain(texts) and encoder.encode(texts[:1]) == encoder._plain(texts[:1])
    assert "es." in encoder.known and "es.\nDann" not in encoder.known


def test_shards_keep_their_law(spark, sf):
    rows = BOOK.queries["op9_shards"](spark, sf).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_balance_bytes_tokens_and_rows(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one hot text of many copies' ELSE repeat(concat('w', id, ' '), 1 + id % 40) END AS text")
    out = sharding.shard(rows, shards=8).groupBy("shard").agg({"size": "sum", "tokens": "sum", "slot": "count"}).collect()
    for column in ("sum(size)", "sum(tokens)", "count(slot)"):
        loads = [r[column] for r in out]
        assert len(loads) == 8 and max(loads) < 1.03 * min(loads)


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc"] in (2, 3)} == {8}
    assert {r["text_crc32"] for r in rows if r["doc"] == 6} == {zlib.crc32(b"THE Cat sat on the mat")}
    assert sharding.shard(none).count() == 0


def test_placing_takes_the_roomiest_shard():
    loads = np.array([[5, 1, 1], [1, 5, 1], [1, 1, 5], [5, 1, 1], [1, 5, 1], [1, 1, 5]], float)
    shard = sharding.place(loads, 2)
    assert np.allclose(loads[shard == 0].sum(axis=0), loads[shard == 1].sum(axis=0))
