"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bwt_merge, byte_cnn, license_scan, packing, positional_index, quality_rules, sharding, simhash_dedup, suffix_trees, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_license_scan": license_scan.query,
    "op3_quality_rules": quality_rules.query,
    "op4_suffix_trees": suffix_trees.query,
    "op5_bwt_merge": bwt_merge.query,
    "op6_sharding": sharding.query,
    "op7_url_filter": url_filter.query,
    "op8_byte_cnn": byte_cnn.query,
    "op9_positional_index": positional_index.query,
    "op10_simhash_dedup": simhash_dedup.query,
}
#: The other operators learn, iterate, align or search; tests/llm hold them against brute force.
SQL: dict[str, str] = {"op7_url_filter": url_filter.SQL}
