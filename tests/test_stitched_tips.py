"""Lines come with their tips from one pass over the pieces of many features."""

import random

from pyspark.sql import functions as F

from cairnway.operators import discovery


def test_tips_turn_lines_as_their_pieces_do(spark):
    rng = random.Random(9)
    spots = [(7 + rng.random(), 46 + rng.random()) for _ in range(9)]
    rows = [(f, p, *rng.choice(spots), *rng.choice(spots)) for f in range(60) for p in range(f % 12 + 1)]
    pieces = spark.createDataFrame(rows, "feature_id long, piece long, lon1 double, lat1 double, lon2 double, lat2 double").cache()
    points = spark.createDataFrame([(f, *rng.choice(spots)) for f in range(0, 60, 2)], "feature_id long, lon double, lat double").cache()
    lines = discovery.stitched_tips(pieces)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInPandas" not in plan
    known = points.select("feature_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    got = sorted(map(tuple, discovery.turned(lines.join(known, "feature_id", "left")).collect()))
    want = sorted(map(tuple, discovery.oriented(discovery.stitched(pieces), pieces, points).collect()))
    assert got == want and len(got) == len(rows) and len({r[4] for r in got}) == 2
