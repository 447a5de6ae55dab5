"""Plans are those wanted: filters and columns reach the scan, nothing pairs everything with everything."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: A query of each kind, with the columns that its scans may read.
READS = {
    "p3_found": {"file_id", "start", "end"},
    "ag10_speaker_stats": {"file_id", "seq", "speaker", "text"},
    "seq4_runs": {"file_id", "seq", "speaker"},
    "st_sessions": {"file_id", "received_at"},
    "m14_confidence": {"row_id", "confidence", "start", "end"},
    "s8_best_results": {"result_id", "model_key", "cer"},
    "pf3_categories": {"category"},
}


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READS)
def test_scans_read_what_is_needed(spark, name):
    text = plan(spark, name)
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",") if c}
    assert read and read <= READS[name]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(file_id), IsNotNull(seq)]" in plan(spark, "seq4_runs")
    assert "IsNotNull(cer)" in plan(spark, "s8_best_results")


@pytest.mark.parametrize("name", ["j1_interval_speaker", "j2_similar_words", "c8_misheard_words", "c13_rule_matches", "s4_mentioned_terms", "r5_full_analysis", "j17_recovered", "m16_bigram_scores", "s9_best_candidate", "h2_evaluation", "seq12_context", "seq11_note_categories"])
def test_no_product_of_tables(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ordered_work_shares_the_shuffle_of_the_copies(spark):
    assert plan(spark, "seq2_without_repeats").count("Exchange hashpartitioning") <= 3
