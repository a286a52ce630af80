"""Registered queries do the whole job: no bound below the feature's own."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairnway.plans import all_plans, p02_boxes, p07_names
from cairnway.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")
def test_route_vote_of_25_members(spark):
    """Members past the sixth vote, in the query and in its SQL."""
    import duckdb

    from __spark_entry__ import oracle_sql
    from tests.check import TABLES, rows_of

    made = duckdb.connect()
    for table in TABLES:
        made.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = made.sql(oracle_sql()["route_tier_vote"])
    got = all_plans().queries["route_tier_vote"](spark, FOLDER)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(result.columns, result.fetchall())
    assert got.agg({"scored_members": "max"}).first()[0] > 6


def test_dense_tiles_split_down_to_the_feature(spark):
    """Two close spots share a tile of 0.078 degrees and not one of 0.039; a third stays above the cap."""
    spots = [(0.01, 0.01)] * 30 + [(0.05, 0.01)] * 30 + [(1.01, 1.01)] * 50
    ways = spark.createDataFrame(spots, "longitude double, latitude double")
    got = {tuple(r) for r in p02_boxes._dense(SimpleNamespace(ways=lambda: ways)).collect()}
    assert {r for r in got if r[1] < 2} == {(7, 0, 0, 30, False), (7, 1, 0, 30, False)}
    assert [r[3:] for r in got if r[4]] == [(50, True)]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")
def test_a_common_name_keeps_every_relation(spark, monkeypatch):
    one = Tables(spark, FOLDER).relations().where("route = 'hiking'").limit(1)
    blank = [F.lit(None).cast("string").alias(c) for c in one.columns if c.endswith("name") or c.startswith("name")]
    kept = [F.col(c) for c in one.columns if c != "relation_id" and not (c.endswith("name") or c.startswith("name"))]
    many = one.drop("relation_id").crossJoin(spark.range(1200).toDF("relation_id")).select("relation_id", *kept, *blank).withColumn("name", F.lit("Ridge Trail"))
    asked = spark.createDataFrame([("Ridge Trail", None), ("Lake Path", None)], "name string, alias string")
    t = SimpleNamespace(spark=spark, view=lambda name: asked, relations=lambda: many)
    for by_ranges in (False, True):
        if by_ranges:
            monkeypatch.setattr(p07_names.names.skew, "narrow", lambda df, keys, bound=None: False)
        rows = p07_names._by_name(t).collect()
        assert sorted(r["relation_id"] for r in rows) == list(range(1200)) and {r["asked"] for r in rows} == {"Ridge Trail"}
        assert sorted(r["place"] for r in rows) == list(range(1, 1201))
        assert [r["relation_id"] for r in sorted(rows, key=lambda r: r["place"])] == list(range(1200))
