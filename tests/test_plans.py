"""The plans are the ones wanted: pushed filters, pruned columns, partial aggregates, bounded top-k."""

import os
import re

import pytest

from trellis.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_range_reaches_the_scan(spark):
    p = plan(spark, "range_scan")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(created_time", p)
    assert re.search(r"ReadSchema: struct<entry_no:bigint,created_time:timestamp_ntz>", p)


def test_projection_prunes_columns(spark):
    assert "description" not in re.search(r"ReadSchema: \S+", plan(spark, "open_href")).group()


@pytest.mark.parametrize("name", ["open_href", "tokenize", "parse_tags", "asset_projection", "soft_delete", "active_rows", "entry_projection"])
def test_maps_shuffle_nothing(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(archived,false\)|PushedFilters: \[[^\]]*Not\(archived|PushedFilters: \[[^\]]*archived", plan(spark, "active_rows"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(plain_id", plan(spark, "point_lookup"))


def test_top_k_is_partial(spark):
    assert "TakeOrderedAndProject" in plan(spark, "cosine_topk")
    assert "TakeOrderedAndProject" in plan(spark, "hybrid_search")


def test_best_row_is_combined_before_the_shuffle(spark):
    assert "partial_max_by" in plan(spark, "dedupe_argmax")


@pytest.mark.parametrize("name", ["near_dup_pairs", "near_dup_topk", "exact_dup_split", "ingest_batch", "collection_items"])
def test_joins_are_equi_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["overlay_merge", "keyword_search", "haystack", "direct_hit_of_rows", "near_dup_topk"])
def test_no_python_in_hot_paths(spark, name):
    assert not re.search("Python|MapInArrow|MapInPandas", plan(spark, name))


@pytest.mark.parametrize("name", ["near_dup_pairs", "near_dup_topk", "ingest_batch"])
def test_block_tables_are_not_broadcast(spark, name):
    p = plan(spark, name)
    blocks = [line for line in p.splitlines() if re.search(r"Join.*\[block#", line)]
    assert blocks and all("SortMergeJoin" in line for line in blocks)


@pytest.mark.parametrize("name", ["near_dup_pairs", "ingest_batch", "exact_dup_split"])
def test_nothing_that_grows_is_broadcast(spark, name):
    assert "Broadcast" not in plan(spark, name)
