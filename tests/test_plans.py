import os

import pytest

from lotwise.plans import catalog_queries as Q
from lotwise.plans import field_queries, record_queries  # noqa: F401 - they add to the queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
JVM_ONLY = [q for q in Q.QUERIES if q not in {"q01_vector_topk", "q02_multi_index_topk", "q03_minmax_rerank", "q04_code_boost", "q05_group_boost", "q06_ambiguity_selection", "q22_html_fields", "q26_token_overlap", "q27_alias_containment", "q32_lookup_cascade", "q36_top1_frequency", "q37_reading_order", "q38_stream_append", "q62_folded_keys", "q63_json_search", "q71_alias_table", "q92_visual_blend", "q93_recognize"}]

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


def plan(spark, name):
    return Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_the_plan(spark, name):
    p = plan(spark, name)
    assert "EvalPython" not in p and "MapIn" not in p and "CartesianProduct" not in p and "BroadcastNestedLoop" not in p


@pytest.mark.parametrize("name,columns", [("q16_hash_dedup", {"doc_id", "text"}), ("q09_daily_trend", {"ts", "event_type", "value"}), ("q19_mode_first_seen", {"p_partkey", "p_brand", "p_type"}), ("q08_iqr_summary", {"event_id", "ts", "event_type", "value"})])
def test_scans_read_what_they_need(spark, name, columns):
    schemas = [s.split(">")[0] for s in plan(spark, name).split("ReadSchema: struct<")[1:]]
    assert schemas and all({f.split(":")[0] for f in s.split(",")} <= columns for s in schemas)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(event_type,purchase)" in plan(spark, "q42_grade_table")
    assert "GreaterThan(label,1)" in plan(spark, "q35_incremental_diff") and "LessThan(label,8)" in plan(spark, "q35_incremental_diff")


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(spark, "q41_top_prizes") and "WindowGroupLimit" in plan(spark, "q07_hamming_neighbours")
