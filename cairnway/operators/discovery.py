"""From rows inside a search box to a ranked, paged list of trails."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo, text
from cairnway.operators import graph, scans
from cairnway.operators.gaps import FEW, FEW_PIECES, few_measured, gap_tree
from cairnway.session import cut, stored

# Searches that are sent to the lines; more of them meet the lines in a shuffle.
SENT_SEARCHES = 200_000
TRAIL = [
    "trail_id", "osm_type", "osm_id", "name", "candidate_type", "priority_tier",
    "relevance_score", "length_km", "source_difficulty", "evidence_class", "map_ready",
]


def way_trails(scored: DataFrame) -> DataFrame:
    """Accepted ways in the common result schema; other columns pass through."""
    relevance = F.round(F.greatest("relevance_score", F.lit(1.0)), 2)
    kind = F.when(F.col("evidence_class") == "weak", "named_local_path").otherwise("named_hiking_way")
    return scored.where("accepted").select(
        F.concat(F.lit("way:"), F.col("way_id")).alias("trail_id"),
        F.lit("way").alias("osm_type"),
        F.col("way_id").alias("osm_id"),
        "name",
        kind.alias("candidate_type"),
        F.when(relevance >= 80.0, 2).otherwise(3).cast("long").alias("priority_tier"),
        relevance.alias("relevance_score"),
        F.round("length_km", 3).alias("length_km"),
        F.lower(F.trim("sac_scale")).alias("source_difficulty"),
        "evidence_class",
        F.lit(True).alias("map_ready"),
    )


def relation_trails(relations: DataFrame, match_score: Column | None = None) -> DataFrame:
    score = F.lit(80.0) if match_score is None else match_score
    return relations.select(
        F.concat(F.lit("relation:"), F.col("relation_id")).alias("trail_id"),
        F.lit("relation").alias("osm_type"),
        F.col("relation_id").alias("osm_id"),
        F.col("display_name").alias("name"),
        F.when(F.col("route") == "hiking", "hiking_route").otherwise("walking_route").alias("candidate_type"),
        F.lit(1).cast("long").alias("priority_tier"),
        F.round(F.greatest(F.lit(70.0), score), 2).alias("relevance_score"),
        F.round("length_km", 3).alias("length_km"),
        F.lower(F.trim("sac_scale")).alias("source_difficulty"),
        F.lit(None).cast("string").alias("evidence_class"),
        F.lit(True).alias("map_ready"),
    )


def candidate_id(name: str) -> Column:
    """A stable id from the comparison form of the name."""
    document = F.concat(F.lit('["'), text.name_key(name), F.lit('"]'))
    return F.concat(F.lit("discovered:"), F.substring(F.sha2(document, 256), 1, 20))


def unmapped_trails(candidates: DataFrame) -> DataFrame:
    """Text candidates without geometry stay visible; equal names of a place are one card."""
    cards = candidates.withColumn("trail_id", candidate_id("name"))
    first = skew.top_per_group(cards, ["place_id", "trail_id"], [F.col("candidate_id")], 1)
    none = F.lit(None)
    return first.select(
        "place_id", "trail_id",
        none.cast("string").alias("osm_type"), none.cast("long").alias("osm_id"), "name",
        F.lit("discovered_trail").alias("candidate_type"),
        F.lit(0).cast("long").alias("priority_tier"), F.lit(0.0).alias("relevance_score"),
        none.cast("double").alias("length_km"), none.cast("string").alias("source_difficulty"),
        none.cast("string").alias("evidence_class"), F.lit(False).alias("map_ready"),
    )


def reach(pairs: DataFrame, places: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per (place, feature): distance to the planar-nearest vertex and the closest approach."""
    gap = geo.planar_gap(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    km = geo.great_circle_km(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    return (
        pairs.join(places.select("place_id", "latitude", "longitude", "is_peak"), "place_id")
        .join(vertices.select("feature_id", "lon", "lat"), "feature_id")
        .groupBy("place_id", "feature_id", "is_peak")
        .agg(F.min(gap).alias("gap"), F.min_by(km, gap).alias("km"), F.min(km).alias("closest_km"))
    )


def reach_lines(met: DataFrame, keep: list[str]) -> DataFrame:
    """The same for the rows of ``boxes.lines_in_boxes``, inside each row; of equal gaps the first vertex's.

    Only the nearest vertex pays for a great circle; the closest approach is that of summits.
    """
    c = F.col
    km = lambda v: geo.great_circle_km(c("latitude"), c("longitude"), v["lat"], v["lon"])

    def gap_at(v: Column, i: Column) -> Column:
        step = v["lon"] - c("longitude")
        x = F.when(F.abs(step) <= 180.0, step).otherwise(F.pmod(step + 180.0, F.lit(360.0)) - 180.0) * c("_shrink")
        y = v["lat"] - c("latitude")
        return F.struct((x * x + y * y).alias("gap"), i.alias("i"))

    seen = met.withColumn("_shrink", F.cos(F.radians("latitude"))).withColumn(
        "_near", F.array_min(F.transform("line", gap_at))
    )
    return seen.select(
        *keep, c("_near")["gap"].alias("gap"), km(F.get("line", c("_near")["i"])).alias("km"),
        F.when(c("is_peak"), F.array_min(F.transform("line", km))).alias("closest_km"),
    )


def reach_of_relations(near: DataFrame, members: DataFrame) -> DataFrame:
    """The same for relations, through their member ways."""
    ways = members.where(F.col("member_type") == "W").select("relation_id", "ref")
    return (
        near.join(ways, near["feature_id"] == ways["ref"])
        .groupBy("place_id", "relation_id", "is_peak")
        .agg(F.min_by("km", "gap").alias("km"), F.min("closest_km").alias("closest_km"))
    )


def association() -> Column:
    metres = F.col("closest_km") * 1000.0
    return F.when(
        F.col("is_peak"),
        F.when(metres <= lx.SUMMIT_BAND_M, "summit_route")
        .when(metres <= lx.APPROACH_BAND_M, "peak_approach")
        .otherwise("nearby_route"),
    )


def order_of_merit(name_key: Column | None = None) -> list[Column]:
    """The total order of results; missing values have fixed stand-ins.

    ``name_key`` is the comparison form of the name where the rows carry it already.
    """
    c = F.col
    by_association = F.lit(3)
    for name, place in lx.ASSOCIATION_RANK.items():
        by_association = F.when(c("peak_association") == name, place).otherwise(by_association)
    return [
        by_association,
        F.coalesce(c("priority_tier"), F.lit(99)),
        -F.coalesce(c("relevance_score"), F.lit(0.0)),
        F.coalesce(c("distance_km"), F.lit(1e9)),
        -F.coalesce(c("length_km"), F.lit(0.0)),
        text.name_key("name") if name_key is None else name_key,
        F.coalesce(c("trail_id"), F.lit("")),
    ]


def grade_index(column: str = "source_difficulty") -> Column:
    known = F.array(*[F.lit(g) for g in lx.GRADES])
    return F.nullif(F.array_position(known, F.lower(F.trim(F.col(column)))), F.lit(0)) - 1


def rank(trails: DataFrame, name: str = "rank") -> DataFrame:
    return skew.position(trails, ["place_id"], order_of_merit(), name)


def view_order(sort: str, merit: list[Column] | None = None) -> list[Column]:
    """Explicit sort first, unknown last, ties by merit."""
    first = {
        "nearest": [F.coalesce("distance_km", F.lit(1e9))],
        "longest": [F.col("length_km").isNull(), -F.coalesce("length_km", F.lit(0.0))],
        "shortest": [F.col("length_km").isNull(), F.coalesce("length_km", F.lit(0.0))],
        "easiest": [grade_index().isNull(), F.coalesce(grade_index(), F.lit(0))],
    }
    return [*first.get(sort, []), *(order_of_merit() if merit is None else merit)]


def narrowed(
    trails: DataFrame,
    grades: list[str] | None = None,
    min_km: float | None = None,
    max_km: float | None = None,
) -> DataFrame:
    """Keep listed grades and an inclusive length range; any filter hides unmapped trails."""
    if not grades and min_km is None and max_km is None:
        return trails
    out = trails.where("map_ready")
    if grades:
        out = out.where(F.lower(F.trim("source_difficulty")).isin(grades))
    if min_km is not None:
        out = out.where(F.col("length_km") >= min_km)
    if max_km is not None:
        out = out.where(F.col("length_km") <= max_km)
    return out


def pages(ranked: DataFrame, size: int, page: int) -> DataFrame:
    """One page per place with what is left behind it."""
    totals = ranked.groupBy("place_id").agg(F.count(F.lit(1)).alias("total_ranked"))
    first, last = (page - 1) * size + 1, page * size
    return (
        ranked.where(F.col("rank").between(first, last))
        .join(totals, "place_id")
        .withColumn("has_more", F.col("total_ranked") > last)
        .withColumn(
            "held_back",
            F.col("total_ranked")
            - F.greatest(F.lit(0), F.least(F.col("total_ranked"), F.lit(last)) - (first - 1)),
        )
    )


def farthest_km(lat: Column, shift_lat: Column, shift_lon: Column) -> Column:
    """No vertex that is planar-nearest of some is further away than this, if one lies within the shifts.

    A great circle is h = sin(a/2)^2 + cos(lat) cos(there) sin(b/2)^2 <= (a^2 + (b cos(lat))^2 cos(there) / cos(lat)) / 4, and
    cos(there) <= cos(lat) + a. The planar-nearest vertex is no further on the plane than the one within the shifts.
    """
    shrink = F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    plane = F.radians(F.hypot(shift_lat, shift_lon * shrink))
    half = plane / 2.0 * F.sqrt(1.0 + plane / shrink)
    return 2.0 * lx.EARTH_KM * F.asin(F.least(F.lit(1.0), half)) * (1.0 + 1e-9)


def km_bounds() -> tuple[Column, Column]:
    """(least, most) distance of a place (latitude, longitude) from a line within _w, _s, _e, _n."""
    c = F.col
    lon_far = F.greatest(F.abs(c("_w") - c("longitude")), F.abs(c("_e") - c("longitude")))
    lat_far = F.greatest(F.abs(c("_s") - c("latitude")), F.abs(c("_n") - c("latitude")))
    lat_gap = F.greatest(c("_s") - c("latitude"), c("latitude") - c("_n"), F.lit(0.0))
    lon_gap = F.greatest(c("_w") - c("longitude"), c("longitude") - c("_e"), F.lit(0.0))
    # The other way around the globe may be shorter.
    lon_gap = F.least(lon_gap, F.greatest(F.lit(0.0), 360.0 - lon_far))
    shrink = F.cos(F.radians("latitude")) * F.least(F.cos(F.radians("_s")), F.cos(F.radians("_n")))
    up, across = F.sin(F.radians(lat_gap) / 2), F.sin(F.radians(lon_gap) / 2)
    h = up * up + F.greatest(shrink, F.lit(0.0)) * across * across
    least = 2.0 * lx.EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (1.0 - 1e-9)
    return least, farthest_km(c("latitude"), lat_far, F.least(F.lit(180.0), lon_far))


def leading(found: DataFrame, searches: DataFrame, first: int) -> DataFrame:
    """(box_id, trail_id) of every trail that may be among the ``first`` of a search by ``order_of_merit``.

    ``found`` has a row per line of a trail that meets a box: area, trail_id, priority_tier, relevance_score and the line's
    bounds; ``searches`` box_id, area, latitude, longitude and is_peak. Tier and relevance go before distance, so only the
    leading classes of a box count, and of the class that fills the list only trails near enough. Each line bounds its
    trail's distance; that many lines within a distance hold enough trails. A summit's own trails come first, so those near
    enough to be are kept as well.
    """
    c = F.col
    ranked = found.withColumns({
        "_tier": F.coalesce("priority_tier", F.lit(99)).cast("long"), "_merit": -F.coalesce("relevance_score", F.lit(0.0)),
    }).select("area", "trail_id", "_tier", "_merit", "_w", "_s", "_e", "_n")
    klass = ["area", "_tier", "_merit"]
    trails = ranked.groupBy(*klass, "trail_id").agg(F.count(F.lit(1)).alias("_lines"))
    sizes = trails.groupBy(*klass).agg(F.count(F.lit(1)).alias("_n"), F.max("_lines").alias("_most"))
    before = Window.partitionBy("area").orderBy("_tier", "_merit").rowsBetween(Window.unboundedPreceding, -1)
    classes = cut(
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_state", F.when(c("_before") + c("_n") <= first, "all").when(c("_before") < first, "last").otherwise("none"))
        .select(*klass, "_state", (c("_most") * first).alias("_need"))
    )
    least, most = km_bounds()
    asked = searches.select("box_id", "area", "latitude", "longitude", "is_peak")
    few = asked.limit(SENT_SEARCHES + 1).count() <= SENT_SEARCHES
    # A class that comes too late matters where a summit asks only.
    summits = asked.where("is_peak").select("area", F.lit(True).alias("_summit")).distinct()
    rows = stored(
        ranked.join(F.broadcast(classes), klass).join(F.broadcast(summits) if few else summits, "area", "left")
        .where((c("_state") != "none") | c("_summit")).drop("_tier", "_merit", "_summit"), "leading",
    )
    met = rows.join(F.broadcast(asked) if few else asked, "area").where((c("_state") != "none") | c("is_peak")).withColumn("_least", least)
    # Distances are told apart by quarters of a power of two: a few counts for each search.
    met = met.withColumn("_far", most)
    last = met.where("_state = 'last'")
    step = F.ceil(4.0 * F.log2(F.greatest("_far", F.lit(0.01))))
    steps = last.groupBy("box_id", "_need", step.alias("_step")).agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy("box_id").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    enough = steps.withColumn("_k", F.sum("_k").over(upto)).where("_k >= _need")
    wide = cut(enough.groupBy("box_id").agg((F.pow(F.lit(2.0), F.min("_step") / 4.0) * (1.0 + 1e-9)).alias("_reach")))
    # Trails of many lines make that too wide, so the trails within it are told apart.
    close = last.join(F.broadcast(wide) if few else wide, "box_id").where("_far <= _reach").groupBy("box_id", "trail_id").agg(F.min("_far").alias("_far"))
    nth = skew.top_per_group(close, ["box_id"], [c("_far")], first, "_at").where(c("_at") == first)
    reach = cut(nth.select("box_id", c("_far").alias("_reach")))
    # Distances are compared by hundredths of a kilometre.
    kept = (c("_state") == "all") | ((c("_state") == "last") & (c("_least") <= F.coalesce("_reach", F.lit(1e9)) + 0.02))
    near = c("is_peak") & (c("_least") * 1000.0 <= lx.APPROACH_BAND_M + 1.0)
    return met.join(F.broadcast(reach) if few else reach, "box_id", "left").where(kept | near).select("box_id", "trail_id").distinct()


def paged(trails: DataFrame, by: str, order: list[Column], totals: DataFrame, size: int, page: int) -> DataFrame:
    """``pages`` of the trails that may be on them; ``totals`` counts all trails of each ``by``."""
    last = page * size
    first = skew.top_per_group(trails, [by], order, last, "rank")
    left = F.col("total_ranked") - F.greatest(
        F.lit(0), F.least(F.col("total_ranked"), F.lit(last)) - (last - size)
    )
    return (
        first.where(F.col("rank") > last - size)
        .join(totals, by)
        .withColumns({"has_more": F.col("total_ranked") > last, "held_back": left})
    )


def prioritised(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each tile in provider order, flagged when the tile held more."""
    kept = skew.top_per_group(rows, keys, order, limit, "place_in_tile")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tile_rows"))
    return kept.join(counts, keys).withColumn("truncated", F.col("tile_rows") > limit)


def provider_order() -> list[Column]:
    strength = (
        F.when(F.col("route") == "hiking", 0)
        .when(F.col("route").isin("foot", "walking"), 1)
        .when(F.col("sac_scale").isNotNull(), 2)
        .when(F.col("trail_visibility").isNotNull(), 3)
        .when(F.col("highway").isin("path", "bridleway", "steps"), 4)
        .when(F.col("highway").isin("footway", "track"), 5)
        .otherwise(6)
    )
    return [strength, F.col("length_m").desc_nulls_last(), F.lower("name"), F.col("way_id")]


def first_of(*sets: DataFrame, keys: list[str]) -> DataFrame:
    """Union in order of precedence; an identity already present is not added again."""
    union = None
    for i, frame in enumerate(sets):
        part = frame.withColumn("precedence", F.lit(i).cast("long"))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return skew.top_per_group(union, keys, [F.col("precedence")], 1)


def without_members(ways: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """Drop ways that a returned relation lists as its section."""
    listed = members.where(F.col("member_type") == "W").join(
        relations.select("relation_id"), "relation_id", "left_semi"
    )
    return ways.join(listed, ways["way_id"] == listed["ref"], "left_anti")


def _spans(met: DataFrame, tolerance: float) -> tuple[DataFrame, Column, Column]:
    """Where a segment (lon ... lat2) enters and leaves the strip around a route segment (r_lon ... r_lat2).

    Both are shares of the segment's length, not yet cut to 0 and 1, and null where it stays outside.
    """
    c = F.col
    # In steps, so that each quantity is computed once per pair: the segment's direction, the
    # route segment's direction, then the segment seen in the route segment's own axes.
    met = met.withColumns(
        {
            "dx": c("lon2") - c("lon"), "dy": c("lat2") - c("lat"),
            "ex": c("r_lon2") - c("r_lon"), "ey": c("r_lat2") - c("r_lat"),
        }
    )
    met = met.withColumns(
        {"dd": c("dx") * c("dx") + c("dy") * c("dy"), "len": F.hypot("ex", "ey")}
    ).where(c("dd") > 0)
    unit_x, unit_y = c("ex") / F.nullif("len", F.lit(0.0)), c("ey") / F.nullif("len", F.lit(0.0))
    met = met.withColumns({"ux": unit_x, "uy": unit_y})
    px, py = c("lon") - c("r_lon"), c("lat") - c("r_lat")
    met = met.withColumns(
        {
            "at": px * c("ux") + py * c("uy"), "at_step": c("dx") * c("ux") + c("dy") * c("uy"),
            "off": py * c("ux") - px * c("uy"), "off_step": c("dy") * c("ux") - c("dx") * c("uy"),
            "from1": (px * c("dx") + py * c("dy")) / c("dd"),
            "near1": (px * px + py * py - tolerance * tolerance) / c("dd"),
            "from2": ((px - c("ex")) * c("dx") + (py - c("ey")) * c("dy")) / c("dd"),
            "near2": ((px - c("ex")) * (px - c("ex")) + (py - c("ey")) * (py - c("ey")) - tolerance * tolerance)
            / c("dd"),
        }
    )
    met = met.withColumns(
        {
            "rest1": c("from1") * c("from1") - c("near1"),
            "rest2": c("from2") * c("from2") - c("near2"),
        }
    )

    def axis(start: str, step: str, low: Column, high: Column) -> tuple[Column, Column]:
        moving = F.abs(c(step)) > 1e-18
        s, e = (low - c(start)) / c(step), (high - c(start)) / c(step)
        inside = c(start).between(low, high)
        enter = F.when(moving, F.least(s, e)).when(inside, F.lit(-1e18)).otherwise(F.lit(1e18))
        leave = F.when(moving, F.greatest(s, e)).when(inside, F.lit(1e18)).otherwise(F.lit(-1e18))
        return enter, leave

    along_in, along_out = axis("at", "at_step", F.lit(0.0), c("len"))
    off_in, off_out = axis("off", "off_step", F.lit(-tolerance), F.lit(tolerance))
    met = met.withColumns(
        {
            "s_in": F.when(c("len") > 0, F.greatest(along_in, off_in)),
            "s_out": F.when(c("len") > 0, F.least(along_out, off_out)),
            "root1": F.when(c("rest1") >= 0, F.sqrt(F.abs("rest1"))),
            "root2": F.when(c("rest2") >= 0, F.sqrt(F.abs("rest2"))),
        }
    )
    crossing = c("s_in") <= c("s_out")
    low = F.least(F.when(crossing, c("s_in")), -c("from1") - c("root1"), -c("from2") - c("root2"))
    high = F.greatest(F.when(crossing, c("s_out")), -c("from1") + c("root1"), -c("from2") + c("root2"))
    return met, low, high


def along_candidates(
    lines: DataFrame, routes: DataFrame, share: float = lx.ALONG_SHARE, tolerance: float = lx.ALONG_TOLERANCE_DEG,
    cell_deg: float = 0.02, width: int | None = None,
) -> DataFrame:
    """(feature_id, route_id) of one name ``k`` that ``along_share`` can find to share ``share`` or more.

    ``lines`` and ``routes`` hold segments with ``k``. A line that leaves out less than ``1 - share`` of its length
    has at least the rest of its longest segments on the route. Spans are added up without merging those that
    overlap, so no pair is lost. Segments are cut to the size of a cell; a route's piece lies in the cell of its
    lower corner only, and a line's piece looks into all cells from which one can reach it, so two pieces meet once.
    ``width`` is the number of segments of the longest line, or more, where the caller knows it.
    """
    c = F.col
    keys = ["feature_id"]
    sized = lines.withColumn("_deg", F.hypot(c("lon2") - c("lon"), c("lat2") - c("lat")))
    sized = skew.with_group(sized, keys, {"_all": F.sum("_deg"), "_n": F.count(F.lit(1)), "_top": F.max("_deg")}, width=width)
    left_out = (1.0 - share) * c("_all")
    long = F.when(c("_top") >= 2 * left_out, c("_deg") == c("_top")).otherwise(c("_deg") * c("_n") * 2 >= c("_all"))
    anchors = sized.where(long & (c("_deg") > 0))
    anchors = skew.with_group(anchors, keys, {"_long": F.sum("_deg")}, width=width).withColumn("_need", c("_long") - left_out)

    def pieces(segments: DataFrame, size: Column) -> DataFrame:
        """Segments in equal pieces no wider and no higher than a cell."""
        far = F.greatest(F.abs(c("lon2") - c("lon")), F.abs(c("lat2") - c("lat")))
        out = segments.where(F.abs("lon") + F.abs("lon2") + F.abs("lat") + F.abs("lat2") < 1e9).withColumn(
            "_of", F.greatest(F.lit(1), F.ceil(far / cell_deg))
        ).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), c("_of") - 1)))

        def at(axis: str, i: Column) -> Column:
            whole = F.when(i == c("_of"), c(f"{axis}2")).otherwise(c(axis) + (c(f"{axis}2") - c(axis)) * (i / c("_of")))
            return F.when(i == 0, c(axis)).otherwise(whole)

        return out.select(
            *[n for n in ("feature_id", "route_id") if n in out.columns], "k", (size / c("_of")).alias("_size"),
            *[at(axis, c("_i") + d).alias(f"{axis}{'2' if d else ''}") for d in (0, 1) for axis in ("lon", "lat")],
        )

    wide = tolerance * 1.001
    a = pieces(anchors, c("_deg") / c("_need"))
    for axis, cell in (("lon", "cx"), ("lat", "cy")):
        least, most = F.least(axis, f"{axis}2") - 2 * tolerance - cell_deg, F.greatest(axis, f"{axis}2") + 2 * tolerance
        a = a.withColumn(cell, F.explode(F.sequence(F.floor(least / cell_deg), F.floor(most / cell_deg))))
    # The name and the cell travel as one number; names are compared once more for the few pairs that stay.
    cell = F.xxhash64("k", "cx", "cy").alias("cell")
    a = a.select(cell, "feature_id", "_size", "lon", "lat", "lon2", "lat2")
    b = pieces(routes, F.lit(1.0)).withColumns(
        {"cx": F.floor(F.least("lon", "lon2") / cell_deg), "cy": F.floor(F.least("lat", "lat2") / cell_deg)}
    ).select(cell, "route_id", *[c(n).alias(f"r_{n}") for n in ("lon", "lat", "lon2", "lat2")])
    apart = F.lit(False)
    for axis in ("lon", "lat"):
        apart = apart | (F.greatest(axis, f"{axis}2") + wide < F.least(f"r_{axis}", f"r_{axis}2"))
        apart = apart | (F.greatest(f"r_{axis}", f"r_{axis}2") + wide < F.least(axis, f"{axis}2"))
    met, low, high = _spans(a.join(b, "cell").where(~apart), wide)
    span = F.array(F.struct(F.greatest(F.lit(0.0), low).alias("l"), F.least(F.lit(1.0), high).alias("h")))
    covered = met.select("feature_id", "route_id", "_size", F.inline(span)).where(c("l") < c("h"))
    enough = covered.groupBy("feature_id", "route_id").agg(F.sum((c("h") - c("l")) * c("_size")).alias("_held"))
    found = cut(enough.where(c("_held") >= 1.0 - 1e-6).select("feature_id", "route_id"))
    named = found.join(lines.select("feature_id", "k").distinct(), "feature_id")
    return cut(named.join(routes.select("route_id", "k").distinct(), ["route_id", "k"], "left_semi").select("feature_id", "route_id"))


def along_share(
    lines: DataFrame, routes: DataFrame, pairs: DataFrame, tolerance: float = lx.ALONG_TOLERANCE_DEG
) -> DataFrame:
    """(feature_id, route_id, share): how much of a line lies within tolerance of a route.

    ``lines`` and ``routes`` hold segments. A segment meets the strip around one route segment
    in a single span of its own length, found in closed form; spans that overlap are merged
    before they are summed. Segments meet through the grid cells they cross.
    """
    cell_deg = 0.01

    def spread(segments: DataFrame, margin: float) -> DataFrame:
        return segments.withColumn(
            "cx",
            F.explode(
                geo.cells_of_span(
                    F.least("lon", "lon2") - margin, F.greatest("lon", "lon2") + margin, cell_deg
                )
            ),
        ).withColumn(
            "cy",
            F.explode(
                geo.cells_of_span(
                    F.least("lat", "lat2") - margin, F.greatest("lat", "lat2") + margin, cell_deg
                )
            ),
        )

    wanted = lines.join(pairs, "feature_id")
    a = spread(wanted.select("feature_id", "route_id", "part", "pos", "lon", "lat", "lon2", "lat2"), 0.0)
    b = spread(
        routes.join(pairs.select("route_id").distinct(), "route_id", "left_semi").select(
            "route_id", "lon", "lat", "lon2", "lat2"
        ),
        tolerance,
    ).select(
        "route_id", "cx", "cy",
        *[F.col(c).alias(f"r_{c}") for c in ("lon", "lat", "lon2", "lat2")],
    )
    met = a.join(b, ["route_id", "cx", "cy"]).drop("cx", "cy").distinct()
    c = F.col
    met, low, high = _spans(met, tolerance)
    # The generator keeps the filter on the span from being pushed into, and so repeated over,
    # the arithmetic above.
    span = F.array(F.struct(low.alias("l"), high.alias("h")))
    covered = (
        met.select("feature_id", "route_id", "part", "pos", F.inline(span))
        .where(c("l").isNotNull())
        .select(
            "feature_id", "route_id", "part", "pos",
            F.greatest(F.lit(0.0), "l").alias("low"), F.least(F.lit(1.0), "h").alias("high"),
        )
        .where(c("low") < c("high"))
    )
    keys = ["feature_id", "route_id", "part", "pos"]
    # Written once: it is counted before it is placed.
    covered = cut(covered)
    placed = skew.position(covered, keys, [c("low"), c("high")], "_n")
    placed = skew.running_max(placed, keys, "_n", "high", "_reached")
    fresh = F.greatest(F.lit(0.0), c("high") - F.greatest(c("low"), F.coalesce("_reached", F.lit(0.0))))
    parts = placed.groupBy(*keys).agg(F.sum(fresh).alias("part_share"))
    sizes = lines.withColumn("deg", F.hypot(c("lon2") - c("lon"), c("lat2") - c("lat")))
    total = sizes.groupBy("feature_id").agg(F.sum("deg").alias("total"))
    return (
        parts.join(sizes.select("feature_id", "part", "pos", "deg"), ["feature_id", "part", "pos"])
        .groupBy("feature_id", "route_id")
        .agg(F.sum(c("part_share") * c("deg")).alias("on_route"))
        .join(total, "feature_id")
        .select("feature_id", "route_id", (c("on_route") / c("total")).alias("share"))
    )


def way_keys(ways: DataFrame) -> DataFrame:
    """(feature_id, k): the comparison form of each way's name."""
    return ways.select(F.col("way_id").alias("feature_id"), text.name_key("name").alias("k")).where(F.col("k") != "")


def relation_keys(relations: DataFrame) -> DataFrame:
    """(route_id, k): the comparison forms of each relation's name and aliases."""
    spelled = F.concat(F.array("display_name"), scans.aliases(lx.ALIAS_TAGS, False))
    named = relations.select(F.col("relation_id").alias("route_id"), F.explode(spelled).alias("_n"))
    return named.select("route_id", text.name_key("_n").alias("k")).where(F.col("k") != "").distinct()


def collapse(trails: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same-named ways that share an end point become one component.

    Returns (cards, sections). Sections list each component's ways in id order, one row each,
    so a component of any size stays a table.
    """
    # Written once: trails are read for the edges, the nodes, the cards and their grades.
    named = stored(
        trails.select("osm_id", "name", "length_km", "relevance_score", "source_difficulty", text.name_key("name").alias("k")), "trails"
    )
    placed = ends.join(
        named.select(F.col("osm_id").alias("feature_id"), "k"), "feature_id"
    )
    edges = graph.endpoint_edges(placed, "feature_id", 7, within=["k"])
    labels = graph.components(edges, named.select(F.col("osm_id").alias("node")))
    joined = stored(named.join(labels, named["osm_id"] == labels["node"]).drop("node", "k"), "components")
    grades = (
        joined.where(F.col("source_difficulty").isNotNull())
        .groupBy("component", "source_difficulty")
        .agg(F.min("osm_id").alias("first"))
        .groupBy("component")
        .agg(F.array_sort(F.collect_list(F.struct("first", "source_difficulty"))).alias("g"))
        .select("component", F.col("g.source_difficulty").alias("grades"))
    )
    document = F.concat_ws(":", F.min("osm_id"), F.count(F.lit(1)), F.sum("osm_id"))
    cards = (
        joined.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("ways"),
            F.min_by("name", "osm_id").alias("name"),
            F.sum("length_km").alias("length_km"),
            F.max("relevance_score").alias("relevance_score"),
            F.sha2(document, 256).alias("_digest"),
        )
        .join(grades, "component", "left")
        .select(
            F.when(F.col("ways") > 1, F.concat(F.lit("component:"), F.substring("_digest", 1, 20)))
            .otherwise(F.concat(F.lit("way:"), "component")).alias("trail_id"),
            F.when(F.col("ways") > 1, "component").otherwise("way").alias("osm_type"),
            F.col("component").alias("first_way_id"),
            "name", "ways",
            F.round("length_km", 3).alias("length_km"),
            "relevance_score",
            F.when(F.size("grades") == 1, F.element_at("grades", 1)).alias("source_difficulty"),
            F.coalesce(F.array_join("grades", "|"), F.lit("")).alias("grades"),
        )
    )
    return cards, joined.select("component", "osm_id")


def relation_state(relations: DataFrame, members: DataFrame) -> DataFrame:
    """How a relation's membership describes it; membership never proves completeness."""
    counts = members.where(F.col("member_type") == "W").groupBy("relation_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = relations.join(counts, "relation_id", "left")
    n = F.coalesce("n", F.lit(0))
    network = F.coalesce(F.length(text.name_key("network")) > 0, F.lit(False))
    state = (
        F.when(~F.coalesce(F.col("route").isin(lx.HIKING_ROUTE_TYPES), F.lit(False)), "not_a_route_relation")
        .when((n <= 1) & network, "single_member_within_a_named_network")
        .when(n <= 1, "single_member_route")
        .otherwise("multi_member")
    )
    return joined.select(
        "relation_id", n.alias("member_count"), state.alias("state"),
        F.lit(False).alias("establishes_complete_route"),
    )


def pieces_of(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Ends and length of every piece: the rows the continuity functions work on."""
    return measured.groupBy(*keys).agg(
        F.min_by(F.struct("lon", "lat"), "pos").alias("s"),
        F.max_by(F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")), "pos").alias("e"),
        F.sum("km").alias("km"),
    ).select(
        *keys, F.col("s.lon").alias("lon1"), F.col("s.lat").alias("lat1"),
        F.col("e.lon").alias("lon2"), F.col("e.lat").alias("lat2"), "km",
    )


def continuity(pieces: DataFrame, width: int | None = None, few: int = FEW_PIECES) -> DataFrame:
    """How continuous each feature is: chains, gaps between them and the main chain's share.

    ``pieces`` has feature_id, piece, its two ends and km. Features of up to ``few`` pieces travel
    once, to a task that compares their ends; larger ones are chained and measured by ``_spread``.
    ``width``, where the caller knows that no feature has more pieces, saves the count. More than
    250 chains are always called separate pieces.
    """
    c = F.col
    pieces = pieces.where(c("feature_id").isNotNull())
    large = None
    if width is None or width > few:
        # Counted, and read again by one side or both.
        pieces = stored(pieces, "pieces")
        counts = pieces.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
        found = cut(counts.where(c("n") > few).select("feature_id"))
        if not found.isEmpty():
            large = pieces.join(found, "feature_id", "left_semi")
            pieces = pieces.join(found, "feature_id", "left_anti")
    ends = pieces.select(c("feature_id").cast("long"), "piece", "lon1", "lat1", "lon2", "lat2", "km")
    measured = ends.repartition("feature_id").sortWithinPartitions("feature_id", "piece").drop("piece").mapInArrow(few_measured, FEW)
    share = F.bround(c("longest_km") / F.coalesce(F.nullif(c("km"), F.lit(0.0)), F.lit(1.0)), 3)
    out = measured.withColumn("share", share).drop("longest_km", "km")
    if large is not None:
        out = out.unionByName(_spread(large))
    one = c("chain_count") == 1
    largest = F.bround("largest_gap_km", 3)
    return out.select(
        "feature_id",
        F.when(one, "connected")
        .when(
            (c("chain_count") > lx.MAX_MEASURED_CHAINS)
            | (largest > lx.SEPARATE_GAP_KM)
            | (c("share") < lx.DOMINANT_CHAIN_SHARE),
            "separate_pieces",
        )
        .otherwise("gaps")
        .alias("status"),
        "part_count",
        "chain_count",
        F.when(one, 0.0).otherwise(largest).alias("largest_gap_km"),
        F.when(one, 0.0).otherwise(F.bround("total_gap_km", 3)).alias("total_gap_km"),
        F.when(one, 1.0).otherwise(c("share")).alias("main_chain_share"),
    )


def _spread(pieces: DataFrame) -> DataFrame:
    """Chains, share and gaps of features of any number of pieces.

    Pieces are chained by a component job over ends that nearly touch; the free ends of features
    with two chains or more go to the gap tree, whatever their number.
    """
    c = F.col
    ends = pieces.select(
        "feature_id", "piece",
        F.inline(F.array(
            F.struct(F.lit(0).alias("side"), c("lon1").alias("lon"), c("lat1").alias("lat")),
            F.struct(F.lit(1).alias("side"), c("lon2").alias("lon"), c("lat2").alias("lat")),
        )),
    )
    # Ends at the very same point are one place; only distinct places are compared with their
    # neighbours, and every piece at a place is linked to the first one there.
    places = ends.groupBy("feature_id", "lon", "lat").agg(
        F.min("piece").alias("first"), F.max("piece").alias("last")
    )
    # Cells are 0.0005 degrees of latitude high; their width follows the whole-degree band, so
    # a cell is never narrower than the tolerance.
    row = F.floor(c("lat") / 0.0005)

    def celled(df: DataFrame, cy: Column, step: Column) -> DataFrame:
        out = df.withColumn("cy", cy).withColumn("_band", F.floor(c("cy") * 0.0005 + 1e-12))
        edge = F.least(F.lit(89.0), F.greatest(F.abs("_band"), F.abs(c("_band") + 1)))
        wide = 0.0005 / F.cos(F.radians(edge))
        return out.withColumn("cx", F.floor(c("lon") / wide) + step).drop("_band")

    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probe = places.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
    probe = celled(probe, row + c("_dy"), c("_dx")).drop("_dx", "_dy")
    other = celled(places, row, F.lit(0)).select(
        "feature_id", "cx", "cy",
        *[c(n).alias(f"o_{n}") for n in ("lon", "lat", "first", "last")],
    )
    alone = (c("first") == c("last")) & (c("o_first") == c("o_last")) & (c("first") == c("o_first"))
    near = (
        probe.join(other, ["feature_id", "cx", "cy"])
        .where((c("lon") != c("o_lon")) | (c("lat") != c("o_lat")))
        .where(~alone)
        .where(geo.flat_km(c("lat"), c("lon"), c("o_lat"), c("o_lon")) <= lx.JOIN_TOLERANCE_KM)
    )

    def node(piece: str) -> Column:
        return F.concat_ws(":", "feature_id", piece)

    same_place = ends.join(places, ["feature_id", "lon", "lat"]).where(c("piece") != c("first"))
    edges = same_place.select(node("piece").alias("a"), node("first").alias("b")).unionByName(
        near.select(node("first").alias("a"), node("o_first").alias("b"))
    )
    labels = graph.components(edges, pieces.select(node("piece").alias("node"))).select(
        F.split("node", ":")[0].cast("long").alias("feature_id"),
        F.split("node", ":")[1].cast("long").alias("piece"),
        c("component").alias("chain"),
    )
    touching = (
        near.select("feature_id", "lon", "lat")
        .unionByName(places.where(c("first") != c("last")).select("feature_id", "lon", "lat"))
        .distinct()
        .withColumn("_t", F.lit(True))
    )
    chained = pieces.join(labels, ["feature_id", "piece"])
    lengths = chained.groupBy("feature_id", "chain").agg(
        F.sum("km").alias("km"), F.count(F.lit(1)).alias("pieces")
    )
    summary = lengths.groupBy("feature_id").agg(
        F.sum("pieces").alias("part_count"),
        F.count(F.lit(1)).alias("chain_count"),
        F.bround(F.max("km") / F.coalesce(F.nullif(F.sum("km"), F.lit(0.0)), F.lit(1.0)), 3).alias("share"),
    )
    gapped = summary.where(c("chain_count") > 1).select("feature_id")
    marked = (
        ends.join(gapped, "feature_id", "left_semi")
        .join(labels, ["feature_id", "piece"])
        .join(touching, ["feature_id", "lon", "lat"], "left")
    )
    marked = skew.with_group(marked, ["feature_id", "chain"], {"_free": F.count_if(c("_t").isNull())})
    usable = marked.where(c("_t").isNull() | (c("_free") == 0)).select("feature_id", "chain", "lon", "lat").distinct()
    return summary.join(gap_tree(usable), "feature_id", "left")


def _stitch(ends: list[tuple]) -> list[tuple]:
    """(line, at, piece, reversed, last, start and end of the line) of the pieces of one feature.

    ``ends`` are the two end points of every piece, in order. A line begins with the first free
    piece and takes the first free piece that touches either of its tips, the far tip before the
    near one. Each piece enters two queues and leaves each once, so the work is linear.
    """
    waiting: dict[tuple, deque[int]] = defaultdict(deque)
    for i, pair in enumerate(ends):
        for point in set(pair):
            waiting[point].append(i)
    free = [True] * len(ends)

    def first_free(point: tuple) -> int:
        queue = waiting[point]
        while queue and not free[queue[0]]:
            queue.popleft()
        return queue[0] if queue else len(ends)

    lines = []
    for seed, (near, far) in enumerate(ends):
        if not free[seed]:
            continue
        free[seed], line = False, deque([(seed, False)])
        while (pick := min(first_free(far), first_free(near))) < len(ends):
            forward = pick == first_free(far)
            joint, along = (far, ends[pick]) if forward else (near, ends[pick][::-1])
            turned = along[0] != joint
            free[pick] = False
            if forward:
                line.append((pick, turned))
                far = along[not turned]
            else:
                line.appendleft((pick, turned))
                near = along[not turned]
        lines.append((line, *near, *far))
    return [(number, at, i, turned, len(line) - 1, *tips) for number, (line, *tips) in enumerate(lines) for at, (i, turned) in enumerate(line)]


STITCHED = "feature_id long, line long, at long, piece long, reversed boolean, last long, lon1 double, lat1 double, lon2 double, lat2 double"


def _stitch_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``STITCHED`` from pieces sorted by feature and piece, many features to a batch."""
    names, whole = [c.split()[0] for c in STITCHED.split(", ")], [pa.int64()] * 4 + [pa.bool_(), pa.int64()] + [pa.float64()] * 4
    for table in skew.whole_groups(batches, "feature_id"):
        keys, pieces = table["feature_id"].to_numpy(), table["piece"].to_numpy()
        lon1, lat1, lon2, lat2 = (table[c].to_pylist() for c in ("lon1", "lat1", "lon2", "lat2"))
        ends = list(zip(zip(lon1, lat1), zip(lon2, lat2)))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
        made = [(start + i, line, at, *rest) for start, stop in zip(starts, [*starts[1:], len(ends)]) for line, at, i, *rest in _stitch(ends[start:stop])]
        row, line, at, *rest = zip(*made)
        row = np.array(row)
        columns = [keys[row], line, at, pieces[row], *rest]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, whole, strict=True)], names)


def stitched_tips(pieces: DataFrame) -> DataFrame:
    """Rows of ``STITCHED``: pieces joined end to end where ends coincide, with their line's last place and tips.

    Only the ends travel, once; a task takes many features after one another.
    """
    c = F.col
    ends = pieces.where(c("feature_id").isNotNull()).select(
        c("feature_id").cast("long"), c("piece").cast("long"), *[c(x).cast("double") for x in ("lon1", "lat1", "lon2", "lat2")]
    )
    return ends.repartition("feature_id").sortWithinPartitions("feature_id", "piece").mapInArrow(_stitch_all, STITCHED)


def stitched(pieces: DataFrame) -> DataFrame:
    """(feature_id, line, at, piece, reversed) of ``stitched_tips``; the vertices are ordered by a join on (feature_id, piece)."""
    return stitched_tips(pieces).select("feature_id", "line", "at", "piece", "reversed")


def oriented(lines: DataFrame, pieces: DataFrame, points: DataFrame) -> DataFrame:
    """``lines`` of ``stitched``, each turned round where its end lies nearer to its feature's point.

    ``points`` holds (feature_id, lon, lat), one row a feature at most; without a point, or at equal
    distance, a line stays as it is. Only the tips of a line are measured.
    """
    c = F.col
    start, end = F.struct(c("lon1").alias("lon"), c("lat1").alias("lat")), F.struct(c("lon2").alias("lon"), c("lat2").alias("lat"))
    tips = (
        lines.join(pieces, ["feature_id", "piece"])
        .groupBy("feature_id", "line")
        .agg(
            F.min_by(F.when(c("reversed"), end).otherwise(start), "at").alias("s"),
            F.max_by(F.when(c("reversed"), start).otherwise(end), "at").alias("e"),
            F.max("at").alias("last"),
        )
        .select("feature_id", "line", "last", c("s.lon").alias("lon1"), c("s.lat").alias("lat1"), c("e.lon").alias("lon2"), c("e.lat").alias("lat2"))
    )
    known = points.select("feature_id", c("lon").alias("plon"), c("lat").alias("plat"))
    return turned(lines.join(tips, ["feature_id", "line"]).join(known, "feature_id", "left"))


def turned(lines: DataFrame) -> DataFrame:
    """Rows of ``STITCHED`` with the point (plon, plat) of their feature, if any: lines turned as ``oriented`` says."""
    c = F.col

    def away(tip: int) -> Column:
        return geo.great_circle_km(c(f"lat{tip}"), c(f"lon{tip}"), c("plat"), c("plon"))

    return lines.withColumn("_turn", F.coalesce(away(2) < away(1), F.lit(False))).select(
        "feature_id", "line", F.when(c("_turn"), c("last") - c("at")).otherwise(c("at")).alias("at"), "piece",
        (c("reversed") != c("_turn")).alias("reversed"),
    )
