"""The pipeline against a brute-force version of its stages, and on odd rows."""

import corpus_pipeline as P
from almanac.llm import language_id, mixing
from almanac.storage import written
from tests.llm.test_dedup import FOLD, brute
from tests.llm.test_mix_pack_shard import check_packing


def test_stages_are_in_order():
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark, sf, docs):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = language_id.fit(docs.filter(language_id.learning_part(docs["doc_id"], 4) != 2))
    found = {r["doc"]: (r["lang_pred"], r["score"]) for r in language_id.labelled(docs, model).collect()}
    rows = {i: t for i, t in rows.items() if found[i][0] != "und" and found[i][1] >= P.LEAST_SHARE}
    last = {t.translate(FOLD): i for i, t in sorted(rows.items())}
    rows = {i: rows[i] for i in last.values()}
    kept = [i for i, (_, root) in brute(list(rows.items()), 5, 80).items() if i == root]
    left = docs.filter(docs["doc_id"].isin(kept))
    taken = {r["doc"]: -(-r["taken"] // r["size"]) for r in mixing.mix(left).collect() if r["taken"]}
    out = P.run(spark, sf).collect()
    check_packing([{**r.asDict(), "doc": r["doc_id"]} for r in out])
    tokens = {}
    for r in out:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"] / r["doc_tokens"]
    assert {i: round(n, 6) for i, n in tokens.items()} == {i: float(n) for i, n in taken.items()}


def test_stages_take_odd_rows_and_empty_tables(spark, sf, odd, none):
    for table in (odd, none):
        docs = table
        for name, stage in P.STAGES:
            out = written(stage(spark, docs, sf), "odd")  # as run does: a stage reads what the one before wrote
            if stage is not P.packed:
                assert out.columns == table.columns, name
            docs = out
        assert (docs.count() > 0) == (table is odd)
