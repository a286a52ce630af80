"""What several branches of a query read is made once."""

from pyspark.sql import functions as F

from cairnway.operators import discovery


def test_trails_are_made_once_for_their_cards(spark):
    rows = [(i, f"Path {i // 2}", 1.0, 50.0, "hiking" if i % 2 else None) for i in range(6)]
    made = spark.createDataFrame(rows, "osm_id long, name string, length_km double, relevance_score double, source_difficulty string")
    trails = made.withColumn("name", F.concat(F.lit("costly "), "name"))
    ends = spark.createDataFrame([(i, float(i // 2), 1.0) for i in range(6)], "feature_id long, lon double, lat double")
    cards, sections = discovery.collapse(trails, ends)
    assert sorted((r["first_way_id"], r["ways"], r["grades"]) for r in cards.collect()) == [(0, 2, "hiking"), (2, 2, "hiking"), (4, 2, "hiking")]
    assert "costly" not in cards._jdf.queryExecution().optimizedPlan().toString() and sections.count() == 6
