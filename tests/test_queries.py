"""Registered queries against their SQL on the smallest data set.

A selection runs by default; ALL_QUERIES=1 runs every query.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketloom.plans import ORACLES, QUERIES
from marketloom.plans.tables import BASE
from tools.check import rows_of

from conftest import SF

CHOSEN = [
    "a6_source_import", "a8_price_list", "a14_upsert", "b4_resolve_url", "b7_page_class", "b10_links", "b12_seed_urls", "b13_frontier", "c2_listing_rows",
    "c9_offers", "c12_store_enrichment", "c19_page_text", "d4_category", "d22_canonical_key", "d28_row_checks", "d36_response_items", "e2_product_view", "f5_monthly_price_history",
    "f10_writer_metrics", "f12_target_metrics", "f18_daily_prices", "f20_dashboard", "g1_source_registry", "h3_validation_samples", "h5_monthly_change", "h6_previous_run",
    "h8_writer_pages", "i1_same_names", "i4_match_scores", "i5_components", "j4_promotion", "k3_drift_warnings", "k5_synthetic_checks", "l1_retention", "m2_daily_prices", "m5_drift_state",
]


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("ALL_QUERIES") else CHOSEN)
def test_query_matches_sql(spark, engine, name):
    got, want = QUERIES[name](spark, SF).toPandas(), engine.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.to_dict("records"), got.columns) == rows_of(want.to_dict("records"), want.columns)


def test_items_of_one_name_in_a_shop(spark, tmp_path):
    connection = duckdb.connect()
    connection.execute(f"COPY (SELECT p_partkey + 700 * k AS p_partkey, * EXCLUDE (p_partkey, k) FROM '{SF}/part.parquet', range(2) r(k)) TO '{tmp_path}/part.parquet'")
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path if name == 'part' else SF}/{name}.parquet'")
    got, want = QUERIES["f12_target_metrics"](spark, str(tmp_path)).toPandas(), connection.execute(ORACLES["f12_target_metrics"]).fetchdf()
    assert (got["unique_items"] < got["valid_rows"]).any()
    assert rows_of(got.to_dict("records"), got.columns) == rows_of(want.to_dict("records"), want.columns)


def test_rule_files_lie_in_one_folder(spark, engine, tmp_path, monkeypatch):
    from marketloom.plans import pages_

    monkeypatch.setattr(pages_, "work_folder", lambda session, name: str(tmp_path / name))
    got, want = QUERIES["a11_rule_files"](spark, SF).toPandas(), engine.execute(ORACLES["a11_rule_files"]).fetchdf()
    assert rows_of(got.to_dict("records"), got.columns) == rows_of(want.to_dict("records"), want.columns)
    assert not [f for f in (tmp_path / "rules").iterdir() if f.is_dir()]


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
