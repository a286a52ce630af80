"""Numbers in passages are rounded as their SQL rounds them."""

from cairnway.operators import retrieval


def test_ties_are_rounded_as_printf_rounds_them(spark):
    assessed = spark.createDataFrame(
        [(7, 12.25, 2.5, 0.15), (8, 0.75, 3.5, 41.65), (9, 1234567.25, 1234.5, None)],
        "feature_id long, distance_km double, gain_m double, max_slope_pct double",
    ).selectExpr(
        "*", "'rock' AS surface", "string(null) AS sac_scale", "string(null) AS estimate_tier", "'dry' AS condition_status",
        "90L AS condition_score", "'fit' AS suitability", "array() :: array<string> AS missing",
    )
    gear = spark.createDataFrame([], "feature_id long, item string, priority string")
    got = retrieval.passages(assessed, gear).where("topic = 'terrain' AND source = 'measured'").collect()
    # As DuckDB's printf writes them.
    assert sorted((r["trail_id"], r["text"]) for r in got) == sorted([
        (7, "The route is 12.2 km long."), (7, "The sampled ascent is 2 m."), (7, "The steepest sampled section is 0.1 percent."),
        (8, "The route is 0.8 km long."), (8, "The sampled ascent is 4 m."), (8, "The steepest sampled section is 41.6 percent."),
        (9, "The route is 1234567.2 km long."), (9, "The sampled ascent is 1234 m."),
    ])
