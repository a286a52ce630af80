"""Pairs of segments that may meet, from a grid whose cells follow the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.session import cut

#: Height and width of the widest cells, in degrees, and how often a cell may be cut in four.
WIDEST_DEG, CUTS = 0.8, 10
#: Segments of one cell beyond which it is cut.
CROWD = 128


def _spans(segments: DataFrame, key: str, margin: float, within: list[str]) -> DataFrame:
    sound = F.abs("lon") + F.abs("lon2") + F.abs("lat") + F.abs("lat2") < 1e9
    return segments.where(F.coalesce(sound, F.lit(False))).select(
        *within, F.col(key).alias("key"), (F.least("lon", "lon2") - margin).alias("x1"), (F.greatest("lon", "lon2") + margin).alias("x2"),
        (F.least("lat", "lat2") - margin).alias("y1"), (F.greatest("lat", "lat2") + margin).alias("y2"),
    )


def _dealt(rows: DataFrame, size: float, of_cell: bool) -> DataFrame:
    """Rows of every cell of ``size`` that their span touches, or of the quarters of their cell."""
    for axis in "xy":
        low, high = F.floor(F.col(f"{axis}1") / size), F.floor(F.col(f"{axis}2") / size)
        if of_cell:
            low, high = F.greatest(low, 2 * F.col(f"c{axis}")), F.least(high, 2 * F.col(f"c{axis}") + 1)
        cells = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        rows = rows.withColumn(f"c{axis}", F.explode(cells))
    return rows


def meeting_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, margin: float,
    within: list[str] | None = None, crowd: int = CROWD, cuts: int = CUTS,
) -> DataFrame:
    """(left_key, right_key) of lines with segments in one cell, ``margin`` around the right ones.

    Both sides hold segments (lon, lat, lon2, lat2), and the columns ``within``, which must agree. A
    cell with more than ``crowd`` segments is cut in four, up to ``cuts`` times, so a crowded place
    has small cells and an empty one a wide one; cells that only one side reaches fall away at
    every step. Segments without coordinates meet nothing.
    """
    keys = within or []
    rows = _spans(left, left_key, 0.0, keys).withColumn("side", F.lit(0)).unionByName(
        _spans(right, right_key, margin, keys).withColumn("side", F.lit(1))
    )
    rows, leaves, size = _dealt(rows, WIDEST_DEG, False), [], WIDEST_DEG
    for level in range(cuts + 1):
        rows = cut(rows)
        cells = rows.groupBy(*keys, "cx", "cy").agg(
            F.count(F.lit(1)).alias("n"), F.min("side").alias("least"), F.max("side").alias("most")
        ).where("least <> most").select(*keys, "cx", "cy", (F.col("n") > crowd).alias("full"))
        # Written once: it is read for the cells that stay and for those that are cut.
        kept = cut(rows.join(cells, [*keys, "cx", "cy"]))
        done = ~F.col("full") if level < cuts else F.lit(True)
        leaves.append(kept.where(done).select(*keys, "side", "key", F.lit(level).alias("level"), "cx", "cy").distinct())
        if level == cuts:
            break
        size /= 2
        rows = _dealt(kept.where("full").drop("full"), size, True)
        if rows.isEmpty():
            break
    every = reduce(DataFrame.unionByName, leaves)
    a = every.where("side = 0").drop("side").withColumnRenamed("key", left_key)
    b = every.where("side = 1").drop("side").withColumnRenamed("key", right_key)
    return cut(a.join(b, [*keys, "level", "cx", "cy"]).select(left_key, right_key).distinct())
