"""The shortest links that would join the chains of each feature: a spanning tree, scale by scale."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo
from cairnway.operators import graph
from cairnway.session import cut

#: First and next cell height. Chains stand more than the join tolerance apart, and after a scale
#: every group of chains stands more than its cell apart, so a cell meets few groups at any scale.
FIRST_KM, STEP = 0.1, 16
#: Cells are looked at in so many strips each way before their points are.
STRIPS = 8
#: Pieces of a feature whose ends one task compares pair by pair, and pairs it looks at together.
FEW_PIECES, PAIRS = 500, 1 << 20
FEW = "feature_id long, part_count long, chain_count long, longest_km double, km double, largest_gap_km double, total_gap_km double"


def _celled(points: DataFrame, km: float) -> DataFrame:
    """Row and column of each point's cell, and of the strip in it.

    Columns are wide enough for ``km`` one row further from the equator than the row itself, since
    a distance counts at the mean latitude of its ends.
    """
    height = km / lx.FLAT_KM_PER_DEGREE
    rows = points.withColumn("cy", F.floor(F.col("lat") / height).cast("long"))
    wide = _width(F.col("cy"), height)
    return rows.withColumns({
        "cx": F.floor(F.col("lon") / wide).cast("long"),
        "sy": F.floor(F.col("lat") / (height / STRIPS)).cast("long"), "sx": F.floor(F.col("lon") / (wide / STRIPS)).cast("long"),
    })


def _width(row: Column, height: float) -> Column:
    edge = F.least(F.lit(89.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * height)
    return F.lit(height) / F.cos(F.radians(edge))


def _box_span(near: bool) -> Column:
    """The least or the greatest distance that points of two boxes can have."""
    def axis(c: str) -> Column:
        if near:
            return F.greatest(F.lit(0.0), F.col(f"b_{c}1") - F.col(f"a_{c}2"), F.col(f"a_{c}1") - F.col(f"b_{c}2"))
        return F.greatest(F.col(f"b_{c}2") - F.col(f"a_{c}1"), F.col(f"a_{c}2") - F.col(f"b_{c}1"))

    ends = [F.abs(F.col(f"{s}_lat{i}")) for s in "ab" for i in (1, 2)]
    one_side = F.signum("a_lat1") * F.signum("b_lat2") > 0
    lowest = F.when((F.signum("a_lat1") == F.signum("a_lat2")) & one_side & (F.signum("b_lat1") == F.signum("b_lat2")), F.least(*ends)).otherwise(0.0)
    scale = F.cos(F.radians(F.greatest(*ends) if near else lowest))
    return F.hypot(axis("lon") * scale, axis("lat")) * lx.FLAT_KM_PER_DEGREE


def close_groups(points: DataFrame, km: float) -> DataFrame:
    """(feature_id, a, b, km): the distance of every two groups of a feature that come within ``km``.

    ``points`` holds (feature_id, grp, lon, lat). Strips of cells meet first: what their boxes
    leave possible bounds the distance of two groups, and only the points of strips that can hold
    the nearest two are compared.
    """
    celled = _celled(points, km)
    height = km / lx.FLAT_KM_PER_DEGREE
    boxes = celled.groupBy("feature_id", "grp", "cy", "cx", "sy", "sx").agg(
        F.min("lon").alias("lon1"), F.max("lon").alias("lon2"), F.min("lat").alias("lat1"), F.max("lat").alias("lat2")
    )
    wide = _width(F.col("row"), height)
    probe = boxes.withColumn("row", F.explode(F.array(*[F.col("cy") + d for d in (-1, 0, 1)]))).withColumn(
        "column", F.explode(F.sequence(F.floor(F.col("lon1") / wide) - 1, F.floor(F.col("lon2") / wide) + 1))
    )
    names = ["grp", "sy", "sx", "lon1", "lon2", "lat1", "lat2"]
    a = probe.select("feature_id", F.col("row").alias("cy"), F.col("column").alias("cx"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = boxes.select("feature_id", "cy", "cx", *[F.col(n).alias(f"b_{n}") for n in names])
    # A cell that one group alone comes near has no pair; most of a dense group falls away here.
    shared = a.groupBy("feature_id", "cy", "cx").agg(F.min("a_grp").alias("x"), F.max("a_grp").alias("y")).where("x <> y")
    a = a.join(shared.drop("x", "y"), ["feature_id", "cy", "cx"], "left_semi")
    met = a.join(b, ["feature_id", "cy", "cx"]).where("a_grp < b_grp").withColumns({"low": _box_span(True), "high": _box_span(False)})
    met = met.where(F.col("low") <= km).select("feature_id", "a_grp", "b_grp", "a_sy", "a_sx", "b_sy", "b_sx", "low", "high").distinct()
    bound = met.groupBy("feature_id", "a_grp", "b_grp").agg(F.min("high").alias("most"))
    kept = met.join(bound, ["feature_id", "a_grp", "b_grp"]).where(F.col("low") <= F.col("most") + 1e-9)
    spots = celled.select("feature_id", "grp", "sy", "sx", "lon", "lat")

    def side(s: str) -> DataFrame:
        return spots.select("feature_id", *[F.col(c).alias(f"{s}_{c}") for c in ("grp", "sy", "sx", "lon", "lat")])

    pairs = kept.join(side("a"), ["feature_id", "a_grp", "a_sy", "a_sx"]).join(side("b"), ["feature_id", "b_grp", "b_sy", "b_sx"])
    apart = geo.flat_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return (
        pairs.groupBy("feature_id", F.col("a_grp").alias("a"), F.col("b_grp").alias("b")).agg(F.min(apart).alias("km"))
        .where(F.col("km") <= km)
    )


def forest(links: DataFrame) -> DataFrame:
    """(feature_id, km) of the links (feature_id, a, b, km) of a least spanning forest.

    Every round each tree takes its shortest link; links are ordered by length and ends, so no
    round closes a circle and the number of trees at least halves.
    """
    taken, rest = [], links
    while not rest.isEmpty():
        ends = rest.withColumn("t", F.explode(F.array("a", "b")))
        chosen = cut(
            ends.groupBy("t").agg(F.min(F.struct("km", "a", "b", "feature_id")).alias("l")).select("l.*").distinct()
        )
        taken.append(chosen.select("feature_id", "km"))
        merged = graph.components(chosen.select("a", "b"), rest.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        for end in "ab":
            rest = rest.join(merged.select(F.col("node").alias(end), F.col("component").alias(f"r{end}")), end)
        rest = cut(
            rest.where("ra <> rb").groupBy("feature_id", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .agg(F.min("km").alias("km"))
        )
    return reduce(DataFrame.unionByName, taken) if taken else links.select("feature_id", "km")


def gap_tree(points: DataFrame, first_km: float = FIRST_KM) -> DataFrame:
    """(feature_id, largest_gap_km, total_gap_km) of features with two chains or more.

    ``points`` holds (feature_id, chain, lon, lat); a chain belongs to one feature. A spanning tree
    keeps a short link before any longer one. So each scale finds the links of its own length
    between groups and makes one group of what they join, and the next scale, sixteen times as
    wide, sees whole groups only. The links of all scales hold the tree. Scales end when every
    feature is one group; that takes the widest gap and not the number of chains. Points without
    coordinates are left out.
    """
    sound = points.where(F.coalesce(F.abs("lon") + F.abs("lat") < 1e9, F.lit(False)))
    state = cut(sound.select("feature_id", F.col("chain").alias("grp"), "lon", "lat").distinct())
    found, km = [], first_km
    while True:
        split = state.groupBy("feature_id").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y")
        state = cut(state.join(split.select("feature_id"), "feature_id", "left_semi"))
        if state.isEmpty():
            break
        links = cut(close_groups(state, km))
        if not links.isEmpty():
            found.append(links)
            roots = graph.components(links.select("a", "b"), state.select(F.col("grp").alias("node")).distinct())
            state = state.join(roots, F.col("grp") == F.col("node")).select("feature_id", F.col("component").alias("grp"), "lon", "lat")
        km = min(km * STEP, 8 * math.pi * lx.EARTH_KM)
    if not found:
        return points.select("feature_id", F.lit(0.0).alias("largest_gap_km"), F.lit(0.0).alias("total_gap_km")).limit(0)
    return forest(reduce(DataFrame.unionByName, found)).groupBy("feature_id").agg(
        F.max("km").alias("largest_gap_km"), F.sum("km").alias("total_gap_km")
    )


def _merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` nodes that each is linked to by the links (a, b)."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _tree(n: int, a: np.ndarray, b: np.ndarray, km: np.ndarray) -> np.ndarray:
    """Which links (a, b, km) a least spanning forest takes; ``forest`` for links in one task."""
    order = np.lexsort((b, a, km))
    label, taken = np.arange(n), np.zeros(len(km), bool)
    while len(order := order[label[a[order]] != label[b[order]]]):
        best = np.full(n, len(order))
        for end in (a, b):
            np.minimum.at(best, label[end[order]], np.arange(len(order)))
        taken[order[np.unique(best[best < len(order)])]] = True
        label = _merged(n, a[taken], b[taken])
    return taken


def _measured(rows: pa.Table) -> list[np.ndarray]:
    """The columns of ``FEW`` for whole features, sorted by feature."""
    names, feature, counts = np.unique(rows["feature_id"].to_numpy(), return_inverse=True, return_counts=True)
    n = rows.num_rows
    # Ends 2i and 2i + 1 belong to piece i; each end meets the later ones of its feature.
    lon, lat = (np.column_stack([rows[f"{c}{i}"].to_numpy() for i in (1, 2)]).ravel() for c in ("lon", "lat"))
    later = np.repeat(2 * np.cumsum(counts)[feature], 2) - np.arange(2 * n) - 1
    a = np.repeat(np.arange(2 * n), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    east = (lon[b] - lon[a]) * np.cos(np.radians((lat[a] + lat[b]) / 2)) * lx.FLAT_KM_PER_DEGREE
    apart = np.sqrt(east**2 + ((lat[b] - lat[a]) * lx.FLAT_KM_PER_DEGREE) ** 2)
    near = (apart <= lx.JOIN_TOLERANCE_KM) & (a // 2 != b // 2)
    chain = _merged(n, a[near] // 2, b[near] // 2)
    held = np.zeros(2 * n, bool)
    held[a[near]] = held[b[near]] = True
    ends = np.repeat(chain, 2)
    closed = np.bincount(ends, ~held, n) == 0
    usable = (~held | closed[ends]) & (np.abs(lon) + np.abs(lat) < 1e9)
    link = usable[a] & usable[b] & (ends[a] != ends[b])
    x, y, gap = ends[a[link]], ends[b[link]], apart[link]
    taken = _tree(n, x, y, gap)
    home, gap = feature[x[taken]], gap[taken]
    largest, longest = np.zeros(len(names)), np.zeros(len(names))
    np.maximum.at(largest, home, gap)
    km, roots = rows["km"].to_numpy(), np.flatnonzero(chain == np.arange(n))
    np.maximum.at(longest, feature[roots], np.bincount(chain, km, n)[roots])
    found = np.bincount(home, minlength=len(names)) > 0
    # Without any link the sums would be whole numbers.
    total = np.bincount(home, gap, len(names)).astype(float)
    return [
        names, counts, np.bincount(feature[roots], minlength=len(names)), longest, np.bincount(feature, km, len(names)),
        pa.array(largest, mask=~found), pa.array(total, mask=~found),
    ]


def few_measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``FEW`` from pieces sorted by feature: chains, their lengths and the gap tree between them."""
    columns = [c.split()[0] for c in FEW.split(", ")]
    for table in skew.whole_groups(batches, "feature_id"):
        keys = table["feature_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        pairs = np.cumsum((2 * np.diff(np.r_[starts, len(keys)])) ** 2 // 2)
        parts = starts[np.r_[True, np.diff(pairs // PAIRS) > 0]]
        for start, stop in zip(parts, np.r_[parts[1:], len(keys)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _measured(table.slice(start, stop - start))], columns)
