"""Search boxes, tiles and box joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo, text
from cairnway.session import cut

BOX = ["west", "south", "east", "north"]
# A line of more vertices, or over more grid cells, is not carried in one row.
LINE_VERTICES, LINE_CELLS = 256, 64
# Places with the same search that one row may list.
BOX_PLACES = 1024


def is_peak_kind(kind: str) -> Column:
    """A summit rather than an area: the marker may be any part of the kind."""
    key = text.name_key(kind)
    return F.coalesce(key.rlike("|".join(lx.PEAK_MARKERS)), F.lit(False))


def names_one_trail(query: str) -> Column:
    """An explicit route word next to a word that is neither that nor generic."""
    words = text.tokens(text.name_key(query))
    rest = F.array_except(words, text.listed(lx.EXPLICIT_ROUTE_WORDS + lx.GENERIC_TRAIL_WORDS))
    return F.arrays_overlap(words, text.listed(lx.EXPLICIT_ROUTE_WORDS)) & (F.size(rest) > 0)


def search_boxes(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, rejects): every place with the box its search covers and why, or a reject row."""
    asked = F.trim("bbox")
    numbers = [F.expr(f"try_cast(trim(get(split(bbox, ','), {i})) AS DOUBLE)") for i in range(4)]
    given = places.withColumns(
        {
            "_asked": F.coalesce(F.length(asked) > 0, F.lit(False)),
            "_n": F.size(F.split("bbox", ",")),
            **{f"_{name}": value for name, value in zip(BOX, numbers)},
        }
    )
    w, s, e, n = (F.col(f"_{name}") for name in BOX)
    finite = F.lit(True)
    for value in (w, s, e, n):
        finite = finite & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(1e300))
    ordered = (w >= -180) & (w < e) & (e <= 180) & (s >= -90) & (s < n) & (n <= 90)
    located = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    problem = (
        F.when(~F.coalesce(located, F.lit(False)), "point out of range")
        .when(~F.col("_asked"), None)
        .when(F.col("_n") != 4, "box needs four values")
        .when(~F.coalesce(finite, F.lit(False)), "box values must be finite numbers")
        .when(~F.coalesce(ordered, F.lit(False)), "box bounds out of order")
    )
    checked = given.withColumn("reason", problem)
    rejects = checked.where(F.col("reason").isNotNull()).select("place_id", "reason")

    peak = is_peak_kind("place_kind")
    mid_lat, mid_lon = (s + n) / 2.0, (w + e) / 2.0
    least_km = F.when(peak, lx.PEAK_BOX_KM).otherwise(lx.MIN_BOX_KM)
    high = (n - s) * lx.BOX_KM_PER_DEGREE
    wide = (e - w) * lx.BOX_KM_PER_DEGREE * F.greatest(
        F.lit(0.15), F.abs(F.cos(F.radians(mid_lat)))
    )
    big_enough = (high >= least_km) & (wide >= least_km)
    radius = (
        F.when(peak, lx.PEAK_BOX_KM)
        .when(F.col("scope") == "area", lx.AREA_RADIUS_KM)
        .when(names_one_trail("query"), lx.LOCAL_RADIUS_KM)
        .otherwise(lx.PLACE_RADIUS_KM)
    )
    grown = geo.box_around(mid_lat, mid_lon, least_km)
    around = geo.box_around(F.col("latitude"), F.col("longitude"), radius)
    pick = {"west": F.least, "south": F.least, "east": F.greatest, "north": F.greatest}
    asked_for = F.col("_asked")
    box = {
        name: F.when(asked_for & big_enough, F.col(f"_{name}"))
        .when(asked_for, pick[name](F.col(f"_{name}"), grown[name]))
        .otherwise(around[name])
        for name in BOX
    }
    source = (
        F.when(asked_for & big_enough, "requested_bbox")
        .when(asked_for, "expanded_requested_bbox")
        .when(peak, "peak_radius")
        .when(F.col("scope") == "area", "area_radius")
        .when(names_one_trail("query"), "local_radius")
        .otherwise("place_association_radius")
    )
    boxes = checked.where(F.col("reason").isNull()).select(
        "place_id", "name", "query", "latitude", "longitude", "place_kind", "scope",
        peak.alias("is_peak"), source.alias("box_source"), *[box[c].alias(c) for c in BOX],
    )
    return boxes, rejects


def plan_tiles(boxes: DataFrame) -> DataFrame:
    """A complete grid per box, at most 0.75 degrees and 40 tiles; else a square 6 x 6 grid.

    The square grid is the largest one within the bound once the side of ceil(sqrt(40)) = 7
    is coarsened until it fits.
    """
    high = F.greatest(F.col("north") - F.col("south"), F.lit(1e-6))
    wide = F.greatest(F.col("east") - F.col("west"), F.lit(1e-6))
    rows = F.greatest(F.lit(1), F.ceil(high / lx.MAX_TILE_SPAN_DEG))
    cols = F.greatest(F.lit(1), F.ceil(wide / lx.MAX_TILE_SPAN_DEG))
    side = int(lx.MAX_TILES**0.5)
    fits = rows * cols <= lx.MAX_TILES
    sized = boxes.withColumns(
        {
            "rows": F.when(fits, rows).otherwise(F.lit(side)).cast("long"),
            "cols": F.when(fits, cols).otherwise(F.lit(side)).cast("long"),
            "_high": high,
            "_wide": wide,
        }
    )
    each = sized.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))
    )
    return each.select(
        "place_id", "latitude", "longitude", "rows", "cols", "row", "col",
        (F.col("row") * F.col("cols") + F.col("col")).alias("tile_no"),
        (F.col("west") + F.col("_wide") * F.col("col") / F.col("cols")).alias("west"),
        (F.col("south") + F.col("_high") * F.col("row") / F.col("rows")).alias("south"),
        (F.col("west") + F.col("_wide") * (F.col("col") + 1) / F.col("cols")).alias("east"),
        (F.col("south") + F.col("_high") * (F.col("row") + 1) / F.col("rows")).alias("north"),
    )


def outward_key() -> Column:
    """How far a tile's middle lies from its place, in cos-scaled degrees."""
    x = ((F.col("west") + F.col("east")) / 2 - F.col("longitude")) * F.cos(
        F.radians("latitude")
    )
    y = (F.col("south") + F.col("north")) / 2 - F.col("latitude")
    return F.sqrt(x * x + y * y)


def join_segments_in_box(
    boxes: DataFrame, segments: DataFrame, vertices: DataFrame, cell_deg: float = 0.25
) -> DataFrame:
    """(place_id, feature_id) pairs where the line meets the place's box.

    Boxes are spread over the grid cells they cover and segments over the cells they cross, so
    the range join becomes an equi-join on the cell. A long line costs only the cells of its
    own segments. A crowded cell is an ordinary skewed join key, which AQE splits.
    """
    spread = boxes.select(
        "place_id", *BOX,
        F.explode(geo.cells_of_span(F.col("west"), F.col("east"), cell_deg)).alias("cx"),
        F.col("south").alias("_s"), F.col("north").alias("_n"),
    ).withColumn("cy", F.explode(geo.cells_of_span(F.col("_s"), F.col("_n"), cell_deg)))
    edges = segments.select(
        "feature_id", "lon", "lat", "lon2", "lat2",
        F.explode(
            geo.cells_of_span(F.least("lon", "lon2"), F.greatest("lon", "lon2"), cell_deg)
        ).alias("cx"),
    ).withColumn(
        "cy",
        F.explode(geo.cells_of_span(F.least("lat", "lat2"), F.greatest("lat", "lat2"), cell_deg)),
    )
    # A vertex is a segment of no length, so parts of one point still count.
    dots = vertices.select(
        "feature_id", "lon", "lat", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"),
        geo.cell(F.col("lon"), cell_deg).alias("cx"), geo.cell(F.col("lat"), cell_deg).alias("cy"),
    )
    meets = geo.segment_meets_box(
        *[F.col(c) for c in ("lon", "lat", "lon2", "lat2")], *[F.col(c) for c in BOX]
    )
    return (
        spread.drop("_s", "_n")
        .join(edges.unionByName(dots), ["cx", "cy"])
        .where(meets)
        .select("place_id", "feature_id")
        .distinct()
    )


def first_box(boxes: DataFrame, points: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """(lon, lat, place_id): the least place whose box holds the point; points without one are left out."""
    c = F.col
    spread = boxes.withColumn("cx", F.explode(geo.cells_of_span(c("west"), c("east"), cell_deg))).withColumn(
        "cy", F.explode(geo.cells_of_span(c("south"), c("north"), cell_deg))
    )
    placed = points.withColumns({"cx": geo.cell(c("lon"), cell_deg), "cy": geo.cell(c("lat"), cell_deg)})
    holds = c("lon").between(c("west"), c("east")) & c("lat").between(c("south"), c("north"))
    return spread.join(placed, ["cx", "cy"]).where(holds).groupBy("lon", "lat").agg(F.min("place_id").alias("place_id"))


def shared_boxes(places: DataFrame) -> DataFrame:
    """One row per search: box, point and kind of place, with the places that ask it.

    Many places ask the same; the search runs once and its rows are given to each of them.
    """
    same = ["latitude", "longitude", "is_peak", *BOX]
    turns = skew.position(places.select("place_id", *same), same, [F.col("place_id")], "_turn")
    return (
        turns.groupBy(*same, F.floor((F.col("_turn") - 1) / BOX_PLACES).alias("_slice"))
        .agg(F.min("place_id").alias("box_id"), F.sort_array(F.collect_list("place_id")).alias("places"))
        .drop("_slice")
    )


def areas(places: DataFrame) -> DataFrame:
    """One row per box, whatever points and kinds of place ask for it, under its least place."""
    return places.groupBy(*BOX).agg(F.min("place_id").alias("area"))


def split_lines(vertices: DataFrame, cell_deg: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(lines, wide): short lines as one row with their vertices, and the ids of all others.

    A vertex of a line also holds the next one of its part, so it stands for that segment.
    """
    known = vertices.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    side = lambda c: geo.cell(F.max(c), cell_deg) - geo.cell(F.min(c), cell_deg) + 1
    wide = (
        known.groupBy("feature_id")
        .agg(F.count(F.lit(1)).alias("n"), (side("lon") * side("lat")).alias("cells"))
        .where((F.col("n") > LINE_VERTICES) | (F.col("cells") > LINE_CELLS))
        .select("feature_id")
    )
    # Few ids, asked for again by every reader of the lines.
    wide = cut(wide)
    rows = known if wide.isEmpty() else known.join(wide, "feature_id", "left_anti")
    lines = rows.groupBy("feature_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "pos", "lon", "lat"))).alias("_v"),
        *[f(c).alias(f"_{name}") for name, f, c in
          (("w", F.min, "lon"), ("s", F.min, "lat"), ("e", F.max, "lon"), ("n", F.max, "lat"))],
    )

    def with_next(v: Column, i: Column) -> Column:
        after = F.get("_v", i + 1)
        joined = (after["part"] == v["part"]) & (after["pos"] == v["pos"] + 1)
        return F.struct(
            v["lon"].alias("lon"), v["lat"].alias("lat"),
            F.when(joined, after["lon"]).alias("lon2"), F.when(joined, after["lat"]).alias("lat2"),
        )

    return lines.select("feature_id", "_w", "_s", "_e", "_n", F.transform("_v", with_next).alias("line")), wide


def lines_in_boxes(shared: DataFrame, lines: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """Every (box, line) that meet, once, with all columns of both.

    Both are spread over the cells they cover. A pair is kept only in the first cell that both
    cover, so no row has to travel again to be told apart from its copies.
    """
    c = F.col
    spread = shared.withColumn("cx", F.explode(geo.cells_of_span(c("west"), c("east"), cell_deg))).withColumn(
        "cy", F.explode(geo.cells_of_span(c("south"), c("north"), cell_deg))
    )
    placed = lines.withColumn("cx", F.explode(geo.cells_of_span(c("_w"), c("_e"), cell_deg))).withColumn(
        "cy", F.explode(geo.cells_of_span(c("_s"), c("_n"), cell_deg))
    )
    first = (c("cx") == F.greatest(geo.cell(c("_w"), cell_deg), geo.cell(c("west"), cell_deg))) & (
        c("cy") == F.greatest(geo.cell(c("_s"), cell_deg), geo.cell(c("south"), cell_deg))
    )
    near = (c("_w") <= c("east")) & (c("_e") >= c("west")) & (c("_s") <= c("north")) & (c("_n") >= c("south"))
    inside = (c("_w") >= c("west")) & (c("_e") <= c("east")) & (c("_s") >= c("south")) & (c("_n") <= c("north"))
    box = [c(name) for name in BOX]

    def touches(v: Column) -> Column:
        dot = v["lon"].between(c("west"), c("east")) & v["lat"].between(c("south"), c("north"))
        return dot | (
            v["lon2"].isNotNull() & geo.segment_meets_box(v["lon"], v["lat"], v["lon2"], v["lat2"], *box)
        )

    return (
        spread.join(placed, ["cx", "cy"])
        .where(first & near & (inside | F.exists("line", touches)))
        .drop("cx", "cy", "_w", "_s", "_e", "_n")
    )


def dense_tiles(
    points: DataFrame, cap: int, root_deg: float, min_half_deg: float = lx.MIN_SPLIT_SPAN_DEG
) -> DataFrame:
    """Quadtree leaves over points: a tile with more rows than the cap becomes four.

    Level by level, each step counts only the children of tiles that were over the cap; the
    rows that travel are one count per tile. Tiles that may not be split further are reported
    as truncated.
    """
    levels = 0
    while root_deg / (2 ** (levels + 1)) >= min_half_deg:
        levels += 1
    # Counts at the finest level once; coarser levels are sums of those counts.
    fine = root_deg / 2**levels
    counts = (
        points.groupBy(
            geo.cell(F.col("lon"), fine).alias("fx"), geo.cell(F.col("lat"), fine).alias("fy")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ladder = counts.select(
        "n", "fx", "fy", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    )
    step = F.pow(F.lit(2), F.lit(levels) - F.col("level")).cast("long")
    tiles = ladder.groupBy(
        "level",
        F.floor(F.col("fx") / step).alias("tx"),
        F.floor(F.col("fy") / step).alias("ty"),
    ).agg(F.sum("n").alias("n"))
    parent = tiles.select(
        (F.col("level") + 1).alias("level"),
        F.col("tx").alias("px"), F.col("ty").alias("py"), F.col("n").alias("parent_n"),
    )
    linked = tiles.withColumns(
        {"px": F.floor(F.col("tx") / 2), "py": F.floor(F.col("ty") / 2)}
    ).join(parent, ["level", "px", "py"], "left")
    read = linked.where(F.col("parent_n").isNull() | (F.col("parent_n") > cap))
    return read.where((F.col("n") <= cap) | (F.col("level") == levels)).select(
        F.col("level").cast("long").alias("level"), "tx", "ty", "n",
        (F.col("n") > cap).alias("truncated"),
    )
