"""Pairs given to ``along_share`` are few, and none that it finds to lie along a route is missing."""

import random

from cairnway.operators import discovery


def test_no_line_along_a_route_is_lost(spark):
    rng = random.Random(3)
    schema = "part int, pos long, lon double, lat double, lon2 double, lat2 double, k string"

    def rows(key, points, k):
        return [(key, 0, i + 1, *a, *b, k) for i, (a, b) in enumerate(zip(points, points[1:]))]

    def walk(n, step):
        points = [(8.0 + rng.random() * 0.05, 46.0 + rng.random() * 0.05)]
        for _ in range(n):
            points.append((points[-1][0] + rng.uniform(-step, step), points[-1][1] + rng.uniform(-step, step)))
        return points

    lines, routes = [], []
    for r in range(12):
        line = walk(8, 0.4 if r == 0 else 0.02)
        routes += rows(100 + r, line, "ab"[r % 2])
        part = line[1:7]
        lines += rows(3 * r, part, "ab"[r % 2])  # a part of the route, of its name
        lines += rows(3 * r + 1, part[::-1] + walk(0, 0), "ab"[r % 2])  # the same, and a long way off at its end
        fine = [(a[0] + (b[0] - a[0]) * i / 9 + 1e-5, a[1] + (b[1] - a[1]) * i / 9) for a, b in zip(part, part[1:]) for i in range(9)]
        lines += rows(3 * r + 2, fine, "ba"[r % 2] if r % 4 == 3 else "ab"[r % 2])  # many short segments a metre off
    for i in range(60):
        lines += rows(1000 + i, walk(4, 0.02), "ab"[i % 2])  # crossing only
    a = spark.createDataFrame(lines, f"feature_id long, {schema}")
    b = spark.createDataFrame(routes, f"route_id long, {schema}")
    every = a.select("feature_id", "k").distinct().join(b.select("route_id", "k").distinct(), "k").select("feature_id", "route_id")
    want = {(x["feature_id"], x["route_id"]) for x in discovery.along_share(a.drop("k"), b.drop("k"), every).where("share >= 0.9").collect()}
    assert len(want) >= 20
    for cell in (0.02, 0.005):
        got = {tuple(x) for x in discovery.along_candidates(a, b, cell_deg=cell).select("feature_id", "route_id").collect()}
        assert want <= got and 4 * len(got) <= every.count()
