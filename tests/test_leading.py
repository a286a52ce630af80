"""Only trails that may be on a page are measured: none that is on it is missing, and the rules run once, in several tasks."""

import math
import random
from pathlib import Path

import pytest

from cairnway.operators import boxes, discovery
from cairnway.plans import p02_boxes, p05_discovery
from cairnway.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def km(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


def gap(lat, lon, lat0, lon0):
    step = (lon - lon0 + 180.0) % 360.0 - 180.0
    return (step * math.cos(math.radians(lat0))) ** 2 + (lat - lat0) ** 2


def test_no_trail_of_a_first_page_is_lost(spark):
    rng = random.Random(7)
    rows, lines = [], {}
    for i in range(600):
        area, tier, merit = i % 3, rng.choice([1, 1, 1, 2, 3]), rng.choice([80.0, 80.0, 60.0])
        for _ in range(rng.choice([1, 1, 4])):
            lat, lon = rng.uniform(-60, 80), rng.uniform(-180, 179)
            points = [(lat + rng.uniform(0, 0.5), lon + rng.uniform(0, 0.9)) for _ in range(3)]
            lines.setdefault((area, f"t{i}", tier, merit), []).extend(points)
            lats, lons = [p[0] for p in points], [p[1] for p in points]
            rows.append((area, f"t{i}", tier, merit, min(lons), min(lats), max(lons), max(lats)))
    spots = [(100 + j, j % 3, rng.uniform(-89, 89), rng.uniform(-180, 180), j % 2 == 0) for j in range(12)]
    near = next(iter(lines.items()))
    spots.append((200, near[0][0], near[1][0][0] + 0.001, near[1][0][1], True))  # on a trail
    found = spark.createDataFrame(rows, "area long, trail_id string, priority_tier long, relevance_score double, _w double, _s double, _e double, _n double")
    asked = spark.createDataFrame(spots, "box_id long, area long, latitude double, longitude double, is_peak boolean")
    got = {tuple(r) for r in discovery.leading(found, asked, 5).collect()}
    every = 0
    for box, area, lat0, lon0, peak in spots:
        merits = []
        for (a, trail, tier, merit), points in lines.items():
            if a != area:
                continue
            nearest = min(points, key=lambda p: gap(*p, lat0, lon0))
            closest = min(km(lat0, lon0, *p) for p in points)
            rank = (0 if closest <= 0.15 else 1 if closest <= 1.5 else 2) if peak else 3
            merits.append((rank, tier, -merit, round(km(lat0, lon0, *nearest), 2), trail))
        every += len(merits)
        assert {(box, m[-1]) for m in sorted(merits)[:5]} <= got
    assert 2 * len(got) < every


def test_equal_boxes_are_one_area(spark):
    rows = [(7, 46.0, 8.0, 7.5, 45.5, 8.5, 46.5), (3, 45.9, 8.1, 7.5, 45.5, 8.5, 46.5), (9, 46.0, 8.0, 7.4, 45.5, 8.5, 46.5)]
    places = spark.createDataFrame(rows, "place_id long, latitude double, longitude double, west double, south double, east double, north double")
    assert sorted(r.area for r in boxes.areas(places).collect()) == [3, 9]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")
def test_rules_run_in_several_tasks_and_once(spark):
    t = Tables(spark, FOLDER)
    assert p02_boxes.scored_ways(t).rdd.getNumPartitions() > 1
    plan = p05_discovery.box_trails(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS trailblazed" not in plan
