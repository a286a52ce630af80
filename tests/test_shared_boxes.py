"""Searches shared by places, lines carried in one row, and the views' rounding."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from cairnway.operators import boxes, discovery
from cairnway.sources.tables import Tables

PLACE = "place_id long, latitude double, longitude double, is_peak boolean, west double, south double, east double, north double"
VERTEX = "feature_id long, part int, pos long, lon double, lat double"


def places(spark):
    same = (46.0, 8.0, True, 7.5, 45.5, 8.5, 46.5)
    return spark.createDataFrame([(7, *same), (3, *same), (9, 46.0, 8.0, True, 8.4, 45.5, 8.6, 46.5)], PLACE)


def vertices(spark):
    rows = [
        (1, 0, 1, 8.0, 46.0), (1, 0, 2, 8.01, 46.0),  # inside
        (2, 0, 1, 7.0, 46.0), (2, 0, 2, 9.0, 46.1),  # no vertex inside, crosses both boxes
        (3, 0, 1, 7.0, 46.0), (3, 1, 1, 9.0, 46.0),  # two parts: the gap is no segment
        (4, 0, 1, 8.5, 45.5),  # one point on the border of both
    ]
    rows += [(5, 0, i + 1, 8.0 + i / 1000, 46.2) for i in range(boxes.LINE_VERTICES + 1)]
    return spark.createDataFrame(rows, VERTEX)


def test_equal_searches_are_one(spark):
    got = {r.box_id: list(r.places) for r in boxes.shared_boxes(places(spark)).collect()}
    assert got == {3: [3, 7], 9: [9]}


def test_lines_in_rows_meet_what_segments_meet(spark):
    shared = boxes.shared_boxes(places(spark))
    lines, wide = boxes.split_lines(vertices(spark))
    assert [r.feature_id for r in wide.collect()] == [5]
    met = discovery.reach_lines(boxes.lines_in_boxes(shared, lines), ["box_id", "feature_id"])
    got = {(r.box_id, r.feature_id): (round(r.km, 9), round(r.closest_km, 9)) for r in met.collect()}
    assert met.count() == len(got)

    plain = vertices(spark).where("feature_id <> 5")
    after = plain.select("feature_id", "part", (F.col("pos") - 1).alias("pos"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    segments = plain.join(after, ["feature_id", "part", "pos"])
    asked = shared.withColumn("place_id", F.col("box_id"))
    pairs = boxes.join_segments_in_box(asked, segments, plain)
    want = {
        (r.place_id, r.feature_id): (round(r.km, 9), round(r.closest_km, 9))
        for r in discovery.reach(pairs, asked, plain).collect()
    }
    assert got == want and set(got) == {(3, 1), (3, 2), (3, 4), (9, 2), (9, 4)}


def test_first_box_is_the_least_place(spark):
    points = spark.createDataFrame([(8.45, 46.0), (8.55, 46.0), (1.0, 1.0)], "lon double, lat double")
    got = {(r.lon, r.lat): r.place_id for r in boxes.first_box(places(spark), points).collect()}
    assert got == {(8.45, 46.0): 3, (8.55, 46.0): 9}


def test_views_round_as_the_oracle(spark, tmp_path):
    balances = [6672.5, 3810.5, 7884.5, 100.0]
    for name, sql in {
        "customer": f"SELECT i::BIGINT AS c_custkey, b AS c_acctbal FROM (SELECT unnest(range(1, 5)) AS i, unnest({balances}) AS b)",
    }.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = [r.length_km for r in Tables(spark, str(tmp_path)).view("v_relations").orderBy("relation_id").collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT round(abs(b) / 100e0, 2) FROM (SELECT unnest({balances}::DOUBLE[]) AS b)").fetchall()]
    assert got == want
