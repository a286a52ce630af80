"""The gap tree against growing one tree chain by chain."""

import math
import random

from cairnway import lexicon as lx
from cairnway.operators import gaps


def flat(p, q):
    east = (q[0] - p[0]) * math.cos(math.radians((p[1] + q[1]) / 2)) * lx.FLAT_KM_PER_DEGREE
    return math.hypot(east, (q[1] - p[1]) * lx.FLAT_KM_PER_DEGREE)


def plain_tree(chains):
    names = sorted(chains)
    best = {n: math.inf for n in names[1:]}
    last, out = names[0], []
    while best:
        for n in best:
            best[n] = min(best[n], min(flat(p, q) for p in chains[last] for q in chains[n]))
        last = min(best, key=lambda n: (best[n], n))
        out.append(best.pop(last))
    return max(out), sum(out)


def features():
    rng = random.Random(5)
    spread = {1: (0.2, 46.0), 2: (30.0, -10.0), 3: (0.01, 70.0), 4: (100.0, 5.0), 5: (0.002, 0.0), 6: (1.0, -59.9)}
    made = {}
    for f, (wide, lat) in spread.items():
        made[f] = {
            f"{f}:{k}": [(rng.uniform(0, wide) + 7, lat + rng.uniform(-wide, wide) / 4) for _ in range(rng.choice([1, 2, 2, 6]))]
            for k in range(rng.choice([2, 9, 30]))
        }
    # One dense network of very many ends, lonely chains around it, and one far away.
    dense = [(8 + i * 0.0004, 45 + j * 0.0004) for i in range(40) for j in range(40)]
    made[7] = {"7:0": dense, "7:1": [(8.1, 45.1)], "7:2": [(8.0163, 45.0)], "7:3": [(-60.0, -33.0)], "7:4": [(8.0002, 45.0002)]}
    # More chains than the feature calls a route.
    made[8] = {f"8:{k}": [(9 + k % 20 * 0.01, 47 + k // 20 * 0.013)] for k in range(300)}
    return made


def test_tree_equals_plain(spark):
    made = features()
    rows = [(f, c, *p) for f, chains in made.items() for c, ps in chains.items() for p in ps]
    rows += [(9, "9:0", 8.0, 45.0), (10, "10:0", None, 45.0), (10, "10:1", float("nan"), 45.0), rows[0]]
    got = {
        r["feature_id"]: (r["largest_gap_km"], r["total_gap_km"])
        for r in gaps.gap_tree(spark.createDataFrame(rows, "feature_id long, chain string, lon double, lat double")).collect()
    }
    assert set(got) == set(made)
    for f, chains in made.items():
        for a, b in zip(got[f], plain_tree(chains), strict=True):
            assert math.isclose(a, b, rel_tol=1e-9), f


def test_lines_turn_towards_their_point(spark):
    from cairnway.operators import discovery

    # Two lines of feature 1: pieces 0-2-1 (the last one reversed) and piece 3; feature 2 is a ring.
    pieces = spark.createDataFrame(
        [(1, 0, 7.0, 46.0, 7.1, 46.0, 1.0), (1, 1, 7.3, 46.0, 7.2, 46.0, 1.0), (1, 2, 7.1, 46.0, 7.2, 46.0, 1.0),
         (1, 3, 9.0, 46.0, 9.1, 46.0, 1.0), (2, 0, 7.0, 46.0, 7.0, 46.0, 1.0), (3, 0, 7.0, 46.0, 7.1, 46.0, 1.0)],
        "feature_id long, piece long, lon1 double, lat1 double, lon2 double, lat2 double, km double",
    )
    lines = discovery.stitched(pieces).cache()

    def seen(lon, lat):
        points = spark.createDataFrame([(1, lon, lat), (2, lon, lat)], "feature_id long, lon double, lat double")
        rows = discovery.oriented(lines, pieces, points).collect()
        return sorted((r["feature_id"], r["line"], r["at"], r["piece"], r["reversed"]) for r in rows)

    still = [(1, 0, 0, 0, False), (1, 0, 1, 2, False), (1, 0, 2, 1, True), (1, 1, 0, 3, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False)]
    assert seen(7.0, 46.1) == still
    assert seen(7.4, 46.0) == [(1, 0, 0, 1, False), (1, 0, 1, 2, True), (1, 0, 2, 0, True), *still[3:]]
    assert seen(20.0, 46.0)[3] == (1, 1, 0, 3, True)
