"""Plans must keep the shape they were written for."""

import re

import pytest

from marketloom.plans import QUERIES

from conftest import SF


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e1_search_products", "f4_source_price_comparison", "f19_run_summary", "g1_source_registry", "g11_keyword_rules", "a12_category_rules", "g12_url_prefix", "h2_newest_per_domain", "k3_drift_warnings", "c7_extracted_products", "j2_work_list", "l1_retention"])
def test_no_product_joins(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(spark, "h5_monthly_change")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) <= {"l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"}
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text or "GreaterThanOrEqual(l_shipdate" in text


def test_limits_are_top_k_and_groups_are_pruned(spark):
    assert "TakeOrderedAndProject" in plan(spark, "e1_search_products")
    assert plan(spark, "h2_newest_per_domain").count("WindowGroupLimit") == 2


def test_extraction_reads_pages_once_without_moving_rows_after(spark):
    text = plan(spark, "c13_provenance")
    assert text.count("MapInArrow") == 1
    above = text[: text.index("MapInArrow")]
    assert "Exchange" not in above


def test_rows_are_filtered_by_what_is_computed_already(spark):
    """No filter holds the making of product rows, names or prices, which would be computed again for each of its uses."""
    plan = QUERIES["c10_price_observations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    own = plan[:plan.index("MapInArrow")]
    filters = [line for line in own.split("\n") if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("regexp" in line or "transform(" in line for line in filters)
