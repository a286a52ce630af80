"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from cairnway.functions import geo, text
from cairnway.operators import boxes, discovery, evidence, graph, names, quality, rules, terrain, weather


def line(*points, feature=1, part=0):
    return [(feature, part, i + 1, float(x), float(y)) for i, (x, y) in enumerate(points)]


LINE = "feature_id long, part int, pos long, lon double, lat double"


@pytest.mark.parametrize(
    "km, gain, hours",
    [(10.0, 600.0, 3.0), (20.0, 0.0, 4.0), (10.0, None, 2.0), (0.1, None, 1.0), (166.0, 9000.0, 24.0), (None, 100.0, None), (0.0, 100.0, None)],
)
def test_walking_hours(spark, km, gain, hours):
    row = spark.createDataFrame([(km, gain)], "km double, gain double")
    assert row.select(weather.walking_hours(F.col("km"), F.col("gain"))).first()[0] == hours


def pieces(spark, *spans):
    rows = [(1, i, a, 46.0, b, 46.0, (b - a) * 77.0) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "feature_id long, piece long, lon1 double, lat1 double, lon2 double, lat2 double, km double")


def degrees(km):
    return km / (111.195 * math.cos(math.radians(46.0)))


def test_continuity(spark):
    one = discovery.continuity(pieces(spark, (8.0, 8.1))).first()
    assert (one["status"], one["chain_count"]) == ("connected", 1)
    touching = discovery.continuity(pieces(spark, (8.0, 8.1), (8.1 + degrees(0.01), 8.2))).first()
    assert (touching["status"], touching["chain_count"]) == ("connected", 1)
    gap = discovery.continuity(pieces(spark, (8.0, 8.1), (8.1 + degrees(0.5), 8.15))).first()
    assert gap["status"] == "gaps" and abs(gap["largest_gap_km"] - 0.5) < 0.02
    far = discovery.continuity(pieces(spark, (8.0, 8.1), (8.1 + degrees(3.0), 8.3))).first()
    assert far["status"] == "separate_pieces"
    a, b = 8.1 + degrees(0.3), 8.12 + degrees(0.3)
    two = discovery.continuity(pieces(spark, (8.0, 8.1), (a, b), (b + degrees(0.4), b + degrees(0.4) + 0.01))).first()
    assert abs(two["total_gap_km"] - 0.7) < 0.02 and abs(two["largest_gap_km"] - 0.4) < 0.02
    equal = discovery.continuity(pieces(spark, *[(8.0 + i * 0.02, 8.01 + i * 0.02) for i in range(4)])).first()
    assert equal["main_chain_share"] < 0.5 and equal["status"] == "separate_pieces"


def segments(spark, points, feature):
    rows = [(feature, 0, i + 1, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(points, points[1:]))]
    return spark.createDataFrame(rows, "feature_id long, part int, pos long, lon double, lat double, lon2 double, lat2 double")


@pytest.mark.parametrize(
    "way, expected",
    [
        ([(8.01, 46.0), (8.02, 46.0)], 1.0),  # on the route
        ([(8.01, 46.0), (8.03, 46.0)], 1.0),
        ([(8.02, 46.01), (8.02, 45.99)], 0.0),  # crossing
        ([(8.01, 46.001), (8.02, 46.001)], 0.0),  # parallel, 100 m off
        ([(8.02, 46.0), (8.02, 46.0), (8.06, 46.0)], 0.5),  # longer, partly following
        ([(8.01, 46.00002), (8.02, 46.00002)], 1.0),  # two metres off
    ],
)
def test_along_share(spark, way, expected):
    route = segments(spark, [(8.0, 46.0), (8.02, 46.0), (8.04, 46.0)], 9).withColumnRenamed("feature_id", "route_id")
    pairs = spark.createDataFrame([(1, 9)], "feature_id long, route_id long")
    got = discovery.along_share(segments(spark, way, 1), route, pairs).collect()
    assert abs((got[0]["share"] if got else 0.0) - expected) < 0.02


def test_stitching_turns_pieces(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 2.0, 0.0, 1.0, 0.0), (1, 2, 5.0, 5.0, 6.0, 6.0)]
    made = discovery.stitched(spark.createDataFrame(rows, "feature_id long, piece long, lon1 double, lat1 double, lon2 double, lat2 double")).collect()
    got = {r["piece"]: (r["line"], r["at"], r["reversed"]) for r in made}
    assert got == {0: (0, 0, False), 1: (0, 1, True), 2: (1, 0, False)}



def test_stitched_lines_are_whole(spark):
    import random

    rng = random.Random(5)
    points = [(float(rng.randrange(7)), float(rng.randrange(3))) for _ in range(12)]
    rows = [(f, p, *rng.choice(points), *rng.choice(points)) for f in range(6) for p in range(15)]
    schema = "feature_id long, piece long, lon1 double, lat1 double, lon2 double, lat2 double"
    made = discovery.stitched(spark.createDataFrame(rows, schema)).collect()
    ends = {(r[0], r[1]): (r[2:4], r[4:6]) for r in rows}
    assert sorted((r["feature_id"], r["piece"]) for r in made) == sorted(ends)
    lines = {}
    for r in sorted(made, key=lambda r: (r["feature_id"], r["line"], r["at"])):
        pair = ends[r["feature_id"], r["piece"]]
        lines.setdefault((r["feature_id"], r["line"]), []).append((r["piece"], pair[::-1] if r["reversed"] else pair))
    for (feature, number), line in lines.items():
        assert all(a[1][1] == b[1][0] for a, b in zip(line, line[1:]))
        later = [p for (f, n), other in lines.items() if f == feature and n > number for p, _ in other]
        tips = {line[0][1][0], line[-1][1][1]}
        assert not any(tips & set(ends[feature, p]) for p in later)


def test_profile_points_keep_the_budget(spark):
    from cairnway.operators import terrain

    groups = {1: [1.0] * 7, 2: [5.0, 0.1, 0.1], 3: [0.0, 0.0], 4: [1.0] * 13, 5: [2.5, 2.5, 2.5, 2.5, 1.0], 6: [3.0], 7: [1.0] * 4}
    rows = [(g, i, k) for g, kms in groups.items() for i, k in enumerate(kms)]
    got = terrain.allocate_samples(spark.createDataFrame(rows, "g long, part_no long, km double"), ["g"], 10).collect()
    points = {g: [r["points"] for r in sorted(got, key=lambda r: r["part_no"]) if r["g"] == g] for g in groups}
    # 1: a share of 3/7 rounds to none. 5: shares 1.14 x 4 and 0.45. 7: shares 1.5 x 4 round to 2, two units go back.
    assert points == {
        1: [1] * 7, 2: [8, 1, 1], 3: [1, 1], 4: [1] * 10, 5: [2, 2, 2, 2, 1], 6: [10], 7: [2, 2, 3, 3],
    }


BASE = dict(
    has_weather=True, rain_24h=0.0, precip_24h=0.0, rain_72h=0.0, precip_72h=0.0, precip_now=0.0, precip_interval_s=3600.0,
    snowfall=0.0, temperature=18.0, wind=5.0, forecast_rain=0.0, forecast_prob=0.0, weather_code=0, window_hours=None,
    window_cold=None, window_wind=None, window_peak_mm=None, snow_likely=False, surface="ground", max_slope_pct=5.0,
    gain_m=100.0, distance_km=5.0,
)
WEATHER = (
    "has_weather boolean, rain_24h double, precip_24h double, rain_72h double, precip_72h double, precip_now double, "
    "precip_interval_s double, snowfall double, temperature double, wind double, forecast_rain double, forecast_prob double, "
    "weather_code int, window_hours double, window_cold double, window_wind double, window_peak_mm double, "
    "snow_likely boolean, surface string, max_slope_pct double, gain_m double, distance_km double"
)


@pytest.mark.parametrize(
    "change, status",
    [
        (dict(precip_now=0.2, weather_code=51), "favorable"),
        (dict(forecast_rain=0.3, forecast_prob=100.0), "favorable"),
        (dict(precip_now=9.0, weather_code=65, rain_24h=25.0), "adverse"),
        (dict(weather_code=95), "adverse"),
        (dict(snowfall=3.0, temperature=-2.0), "adverse"),
        (dict(wind=45.0), "caution"),
        (dict(wind=65.0), "caution"),
        (dict(), "favorable"),
        (dict(has_weather=False), "unknown"),
    ],
)
def test_condition(spark, change, status):
    row = spark.createDataFrame([tuple({**BASE, **change}.values())], WEATHER)
    assert rules.condition(row).first()["condition_status"] == status


def test_dry_ground_weighs_nothing(spark):
    row = rules.condition(spark.createDataFrame([tuple(BASE.values())], WEATHER)).first()
    assert [f["weight"] for f in row["factors"] if f["factor"] == "surface"] == [0]


def way(spark, **given):
    tags = (
        "name name_en int_name official_name alt_name loc_name short_name old_name route sac_scale trail_visibility foot "
        "footway_use highway surface tracktype incline width sport access smoothness trailblazed designation hiking"
    ).split()
    values = [given.get(t) for t in tags] + [given.get("length_km", 1.0), given.get("point_count", 5)]
    schema = ", ".join(f"{t} string" for t in tags) + ", length_km double, point_count int"
    return evidence.score_ways(spark.createDataFrame([tuple(values)], schema)).first()


@pytest.mark.parametrize(
    "tags, accepted, kind",
    [
        (dict(name="Valley Way", highway="path", sac_scale="hiking"), True, "strong"),
        (dict(name="Local Path", highway="path", surface="ground"), True, "weak"),
        (dict(name="Path to BL shed mainroad", highway="path", length_km=0.2), False, "none"),
        (dict(name="Harbour Road", highway="residential"), False, "none"),
        (dict(name="Path", highway="path", length_km=0.3), False, "none"),
        (dict(name="Dead End Track", highway="track"), False, "none"),
        (dict(name="16", highway="path"), False, "none"),
        (dict(name="16", highway="path", sac_scale="mountain_hiking"), True, "strong"),
        (dict(name="Brunswick Place", highway="pedestrian", foot="designated", surface="paving_stones"), False, "none"),
        (dict(name="Green Lonning", highway="path", foot="designated", surface="ground"), True, "strong"),
    ],
)
def test_evidence(spark, tags, accepted, kind):
    row = way(spark, **tags)
    assert (row["accepted"], row["evidence_class"]) == (accepted, kind)


def tiles(spark, west, south, east, north):
    box = spark.createDataFrame([(1, 0.0, 0.0, west, south, east, north)], "place_id long, latitude double, longitude double, west double, south double, east double, north double")
    return boxes.plan_tiles(box).orderBy("tile_no").collect()


def test_tiles_cover_the_box_exactly(spark):
    assert len(tiles(spark, 8.0, 46.0, 8.5, 46.5)) == 1
    large = tiles(spark, 5.0, 45.0, 11.0, 48.0)
    assert len(large) <= 40 and abs(sum((t["east"] - t["west"]) * (t["north"] - t["south"]) for t in large) - 18.0) < 1e-9
    assert len(tiles(spark, 0.0, 0.0, 60.0, 60.0)) == 36


def test_gaps_make_no_ascent(spark):
    points = [(*p, e) for p, e in zip(line((8.0, 46.0), (8.01, 46.0)) + line((9.0, 46.0), (9.01, 46.0), part=1), (100.0, 100.0, 900.0, 900.0))]
    profiled = terrain.profile(spark.createDataFrame(points, LINE + ", elevation_m double"))
    row = terrain.model_terrain(profiled).first()
    assert row["elevation_gain_m"] == 0.0 and row["elevation_range_m"] == 800.0
    nothing = profiled.withColumn("elevation_m", F.lit(None).cast("double"))
    assert terrain.model_terrain(nothing).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.range(1, 110).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in graph.components(edges, nodes).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100 and got[105] == 105


def test_name_scores(spark):
    pairs = [
        ("Chembra Peak", "chembra peak", 100.0), ("Chembra Peak", "ChembraPeak", 98.0), ("Chembra", "Chembra Peak Trek", 92.0),
        ("Meesapulimala Trek", "Meesapulimala Ridge", 82.0),
    ]
    frame = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a_name string, b_name string")
    got = {(r["a_name"], r["b_name"]): r["score"] for r in names.match_score(frame).collect()}
    for a, b, score in pairs:
        assert got[(a, b)] == score
    sound = names.match_score(spark.createDataFrame([("Kolukku Malai", "Koluku Malai")], "a_name string, b_name string")).first()
    assert sound["score"] == 90.0


def test_name_key_folds_latin_and_keeps_scripts(spark):
    row = spark.createDataFrame([("  Ötztal & Säntis – Großer  ", "मुन्नार ट्रेल")], "a string, b string")
    got = row.select(text.name_key("a").alias("a"), text.name_key("b").alias("b")).first()
    assert got["a"] == "otztal and santis grosser" and got["b"]


def test_route_vote(spark):
    schema = "route_id long, pos long, scored boolean, tier string, p_walking double, p_mountain double, p_alpine double"
    rows = [(1, 1, True, "walking", 0.7, 0.2, 0.1), (1, 2, True, "walking", 0.6, 0.3, 0.1), (1, 3, True, "alpine", 0.1, 0.2, 0.7), (2, 1, True, "alpine", 0.0, 0.1, 0.9), (3, 1, True, "alpine", 0.0, 0.1, 0.9), (3, 2, False, "alpine", 0.0, 0.1, 0.9)]
    got = {r["route_id"]: r for r in rules.tier_vote(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["tier"] == "walking" and got[1]["agreement"] == 0.6667 and got[1]["members_disagree"] is False
    assert got[2]["tier"] == "alpine" and got[3]["tier"] is None


def test_nearest_matches_brute_force(spark):
    points = spark.range(300).select(
        F.col("id").alias("feature_id"),
        (F.pmod(F.xxhash64("id"), F.lit(17000)) / 100.0 - 85.0).alias("lat"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(36000)) / 100.0 - 180.0).alias("lon"),
    )
    test, train = points.where("feature_id % 4 = 0"), points.where("feature_id % 4 <> 0")
    got = {r["feature_id"]: r["km"] for r in quality.nearest_km(test, train).collect()}

    def km(a, b):
        p, q = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))

    others = train.collect()
    rows = test.collect()
    assert len(got) == len(rows)
    for row in rows:
        assert abs(got[row["feature_id"]] - min(km(row, o) for o in others)) < 1e-6


def test_segment_box(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0), (0.0, 2.0, 0.4, 2.0), (1.5, 0.0, 1.5, 3.0)], "a double, b double, c double, d double")
    box = [F.lit(v) for v in (1.0, 1.0, 2.0, 2.0)]
    got = [r[0] for r in frame.select(geo.segment_meets_box(*[F.col(c) for c in "abcd"], *box)).collect()]
    assert got == [True, False, True]
