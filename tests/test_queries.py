"""Registered queries: every inventory id is there, and one query per module equals its DuckDB text."""

import re

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
IDS = ([f"A{i}" for i in range(1, 15)] + [f"B{i}" for i in range(1, 17)] + [f"C{i}" for i in range(1, 12)]
       + [f"D{i}" for i in range(1, 12)] + [f"E{i}" for i in range(1, 23)] + ["E4a", "E4b"] + [f"F{i}" for i in range(1, 22)]
       + [f"G{i}" for i in range(1, 17)] + [f"H{i}" for i in range(1, 11)] + [f"I{i}" for i in range(1, 18)]
       + [f"J{i}" for i in range(1, 14)] + ["K1", "K2", "K3", "L1", "L2", "L3", "M1", "M2"])
SAMPLE = ["A5_tolerant_scan", "B9_assemble_record", "C3_temperatures_agree", "D8_negative_pairs", "E4_clean_rewritten", "E9_tagged_text",
          "F17_standardize_by_batch", "G1_corpus_stats", "H8_early_stop", "I7_decode_ids", "I14_random_batches", "J3_mean_top_similarity",
          "J5_bleu", "J11_metric_report", "K2_shared_tokens", "L3_complete_days", "M2_user_transform"]


def inventory(names):
    """Without the operators for training data, which have tests of their own and may be absent."""
    return {name for name in names if not re.match(r"op\d+_|pipeline$", name)}


def test_every_inventory_id_has_a_query():
    have = {name.split("_")[0] for name in inventory(entry.queries())}
    assert have == set(IDS)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert inventory(entry.queries()) <= set(entry.oracle_sql())
    assert all(re.fullmatch(r"[A-M][0-9]+[ab]?_[a-z0-9_]+", name) for name in inventory(entry.queries()))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    diff, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert diff is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "ids"]
