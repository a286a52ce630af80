"""Every registered query equals its oracle on the smallest tables (the slow ones run apart)."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "scan_named_ways", "resolve_search_box", "plan_tiles", "join_features_in_box", "score_way_evidence", "route_measures",
    "terrain_metrics_model", "census_by_grade", "sample_cap_per_class", "connected_components", "condition_status",
    "recommend_gear", "rolling_rain", "topk_names", "clean_result_urls", "stream_request_rates",
]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    for table in TABLES:
        made.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return made


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("key", CHOSEN)
def test_equals_oracle(spark, connection, key):
    status, _, _, note = compare(spark, key, FOLDER, connection)
    assert status == "ok", note
