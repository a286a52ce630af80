"""Connected groups by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.session import cut


def components(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the smallest node each node is connected to.

    ``edges`` has columns a, b of any orderable type. Each round rewires every edge towards
    the smallest neighbour, first for larger neighbours and then for smaller ones, until only
    stars are left; the number of rounds grows with the logarithm of the longest chain. A node
    is never gathered with its neighbours: the smallest one comes from a partial aggregate and
    goes back by a join that AQE splits when a star centre is crowded. The edges are
    checkpointed every round.
    """
    current = cut(
        edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    )
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a")
            .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        downward = large.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
        lowest = downward.groupBy("a").agg(F.min("b").alias("m"))
        linked = downward.join(lowest, "a")
        small = (
            linked.where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        current = cut(small)
        after = _state(current)
        if after == state:
            break
        state = after
    stars = current.select(F.col("a").alias(node), F.col("b").alias("component"))
    return nodes.select(node).join(stars, node, "left").select(
        node, F.coalesce("component", F.col(node)).alias("component")
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def line_ends(vertices: DataFrame) -> DataFrame:
    """First point of the first part and last point of the last part of each feature."""
    place = F.struct("part", "pos")
    point = F.struct("lon", "lat")
    ends = vertices.groupBy("feature_id").agg(
        F.min_by(point, place).alias("s"), F.max_by(point, place).alias("e")
    )
    return ends.select("feature_id", F.explode(F.array("s", "e")).alias("p")).select(
        "feature_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")
    )


def endpoint_edges(ends: DataFrame, node: str, digits: int, within: list[str] | None = None) -> DataFrame:
    """Edges between nodes that share an end point: each to the smallest one there.

    A shared point gives one edge per node, not one per pair.
    """
    keys = [*(within or []), "x", "y"]
    placed = ends.withColumns({"x": F.bround("lon", digits), "y": F.bround("lat", digits)})
    held = placed.select(*keys, node).distinct()
    first = held.groupBy(*keys).agg(F.min(node).alias("b"))
    return held.join(first, keys).select(F.col(node).alias("a"), "b").where(F.col("a") != F.col("b"))


def cell_groups(ways: DataFrame, ends: DataFrame) -> DataFrame:
    """The split group of every way: its cell, merged with cells that share an end point.

    Labels are ``x:y`` and the smallest is taken in string order.
    """
    celled = ways.withColumn("node", F.concat_ws(":", "grid_x", "grid_y"))
    placed = ends.join(celled.select("feature_id", "node"), "feature_id")
    edges = endpoint_edges(placed, "node", 6)
    labels = components(edges, celled.select("node").distinct())
    return celled.join(labels, "node").select(
        "feature_id", F.col("node").alias("cell"), F.col("component").alias("split_group")
    )


def cell_clusters(cells: DataFrame, keep: int = 6) -> DataFrame:
    """Four-neighbour clusters of cells; the largest few with their envelope."""
    keyed = cells.select("grid_x", "grid_y").distinct().withColumn(
        "node", F.struct("grid_x", "grid_y")
    )
    step = F.explode(
        F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")),
                F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    )
    wanted = keyed.select(F.col("node").alias("a"), "grid_x", "grid_y", step.alias("s")).select(
        "a",
        (F.col("grid_x") + F.col("s.dx")).alias("grid_x"),
        (F.col("grid_y") + F.col("s.dy")).alias("grid_y"),
    )
    edges = wanted.join(keyed.withColumnRenamed("node", "b"), ["grid_x", "grid_y"]).select("a", "b")
    labels = components(edges, keyed)
    return (
        labels.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.min("node.grid_x").cast("double").alias("west"),
            F.min("node.grid_y").cast("double").alias("south"),
            (F.max("node.grid_x") + 1).cast("double").alias("east"),
            (F.max("node.grid_y") + 1).cast("double").alias("north"),
        )
        .orderBy(F.col("cells").desc(), "component")
        .limit(keep)
        .select(
            F.col("component.grid_x").alias("seed_x"), F.col("component.grid_y").alias("seed_y"),
            "cells", "west", "south", "east", "north",
        )
    )
