"""The adaptive grid: no close pair is lost, and crowded places make few pairs."""

import math
import random

from cairnway.operators import adaptive

COLUMNS = "key long, k string, lon double, lat double, lon2 double, lat2 double"


def frame(spark, rows, key):
    return spark.createDataFrame(rows, COLUMNS).withColumnRenamed("key", key)


def apart(p, q):
    """Distance of two segments' boxes, which close segments cannot exceed."""
    def gap(i, j):
        a, b = sorted((p[i], p[j])), sorted((q[i], q[j]))
        return max(0.0, a[0] - b[1], b[0] - a[1])

    return max(gap(2, 4), gap(3, 5))


def test_no_close_pair_is_lost(spark):
    rng = random.Random(2)

    def made(n):
        out = []
        for i in range(n):
            x, y = rng.choice([(7.0, 46.0), (7.8, 46.4), (-0.001, -0.001)])
            x, y = x + rng.gauss(0, 0.02), y + rng.gauss(0, 0.02)
            size = rng.choice([0.0001, 0.001, 0.5])
            out.append((i % (n // 2), rng.choice("ab"), x, y, x + rng.uniform(-size, size), y + rng.uniform(-size, size)))
        return out

    left, right = made(160), made(120)
    # Along a border of cells at every size, on either side of it.
    left.append((900, "a", 7.99998, 46.0, 7.99998, 46.01))
    right.append((901, "a", 8.00001, 46.0, 8.00001, 46.01))
    left += [(902, "a", None, 46.0, 7.0, 46.0), (903, "a", math.nan, 46.0, 7.0, 46.0)]
    margin = 0.00005
    for within, crowd, cuts in (([], 20, 8), (["k"], 4, 3)):
        got = {tuple(r) for r in adaptive.meeting_pairs(frame(spark, left, "l"), frame(spark, right, "r"), "l", "r", margin, within, crowd, cuts).collect()}
        want = {(p[0], q[0]) for p in left if p[0] < 902 for q in right if apart(p, q) <= margin * 0.99 and (not within or p[1] == q[1])}
        assert (900, 901) in want and want <= got
        assert not {line for line, _ in got} & {902, 903}


def test_crowded_places_make_few_pairs(spark):
    rng = random.Random(3)

    def made(n):
        spots = [(7 + rng.random() * 0.01, 46 + rng.random() * 0.01) for _ in range(n)]
        return [(i, "a", x, y, x + 0.00002, y + 0.00002) for i, (x, y) in enumerate(spots)]

    sizes = {}
    for n in (200, 800):
        a, b = frame(spark, made(n), "l"), frame(spark, made(n), "r")
        sizes[n] = adaptive.meeting_pairs(a, b, "l", "r", 0.00005, crowd=16).count()
    assert sizes[800] < 8 * sizes[200] and sizes[800] < 800 * 800 / 30
