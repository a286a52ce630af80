"""Scans, identity lookups and row-level validity of the mapped features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo, text


def _given(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def display_name() -> Column:
    """The first non-empty of the seven name tags."""
    return F.coalesce(*[_given(tag) for tag in lx.NAME_TAGS])


def has_trail_tags() -> Column:
    tagged = [
        F.col(c).isNotNull()
        for c in ("sac_scale", "trail_visibility", "trailblazed", "designation", "hiking")
    ]
    out = F.col("route").isin(lx.HIKING_ROUTE_TYPES) | F.col("sport").isin(lx.TRAIL_SPORTS)
    out = out | F.col("highway").isin(lx.SCAN_HIGHWAYS)
    for test in tagged:
        out = out | test
    return out


def named_ways(ways: DataFrame) -> DataFrame:
    """Ways with a name tag that could be walked as a trail."""
    return ways.where(F.col("name").isNotNull() & F.coalesce(has_trail_tags(), F.lit(False)))


def not_road_named(name: Column) -> Column:
    return (F.col("route") == "hiking") | ~F.lower(name).rlike(lx.ROAD_RELATION_NAME)


def route_relations(relations: DataFrame) -> DataFrame:
    """Named hiking, foot and walking relations that are not named like a road."""
    named = relations.withColumn("display_name", display_name())
    return named.where(
        F.col("display_name").isNotNull()
        & F.col("route").isin(lx.HIKING_ROUTE_TYPES)
        & not_road_named(F.col("display_name"))
    )


def with_drawn_line(relations: DataFrame, lines: DataFrame) -> DataFrame:
    """Relations joined to their own line; the relation filter runs on both sides first."""
    drawn = lines.where(F.col("osm_type") == "R").drop("osm_type")
    return relations.join(drawn, relations["relation_id"] == drawn["osm_id"]).drop("osm_id")


def relation_vertices(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Relation geometry from its member ways, in member order, never stitched.

    The result stays one row per vertex, ordered by (pos, part, vertex): a relation of any
    size is never gathered into one value.
    """
    ways = members.where(F.col("member_type") == "W").select("relation_id", "pos", "ref")
    lines = vertices.select("feature_id", "part", F.col("pos").alias("vertex"), "lon", "lat")
    return ways.join(lines, ways["ref"] == lines["feature_id"]).drop("feature_id")


def with_fallback(first: DataFrame, second: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of the second source only for tiles where the first one failed.

    A tile the first source answered with nothing stays empty.
    """
    failed = status.where(F.col("failed")).select("tile_x", "tile_y")
    keys = ["tile_x", "tile_y"]
    served = first.join(failed, keys, "left_anti").withColumn("served_by", F.lit("primary"))
    spare = second.join(failed, keys, "left_semi").withColumn("served_by", F.lit("fallback"))
    return served.unionByName(spare)


def features_by_id(ids: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Bulk lookup; ids that do not exist are simply missing from the result."""
    wanted = ids.where(F.col("ref") > 0).select("ref")
    return features.join(wanted, features[key] == wanted["ref"], "left_semi")


def usable_features(points: DataFrame) -> DataFrame:
    """Features whose every part has two or more points, all of them on the globe."""
    valid = geo.in_world(F.col("lon"), F.col("lat"))
    parts = points.groupBy("feature_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~valid).alias("bad")
    )
    return (
        parts.groupBy("feature_id")
        .agg(
            F.min("n").alias("shortest"),
            F.sum("bad").alias("bad"),
            F.count(F.lit(1)).alias("part_count"),
            F.sum("n").alias("point_count"),
        )
        .where((F.col("shortest") >= 2) & (F.col("bad") == 0))
        .select("feature_id", "part_count", "point_count")
    )


def clean_lines(points: DataFrame) -> DataFrame:
    """The lenient form: bad points, repeated points and one-point parts are dropped."""
    keys = ["feature_id", "part"]
    good = points.where(geo.in_world(F.col("lon"), F.col("lat")))
    moved = skew.with_neighbours(
        good, keys, "pos", preceding={"lon": "_lon", "lat": "_lat"}, dense=False
    ).where(
        F.col("_lon").isNull() | (F.col("_lon") != F.col("lon")) | (F.col("_lat") != F.col("lat"))
    )
    kept = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return moved.join(kept.select(*keys), keys, "left_semi").select(
        *keys, "pos", "lon", "lat"
    )


def in_box(
    segments: DataFrame, vertices: DataFrame, box: tuple[float, float, float, float]
) -> DataFrame:
    """Features whose line, not only its bounding box, meets the box."""
    west, south, east, north = (F.lit(float(v)) for v in box)
    overlap = (
        (F.greatest("lon", "lon2") >= west)
        & (F.least("lon", "lon2") <= east)
        & (F.greatest("lat", "lat2") >= south)
        & (F.least("lat", "lat2") <= north)
    )
    crossing = segments.where(overlap).where(
        geo.segment_meets_box(
            F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), west, south, east, north
        )
    )
    inside = vertices.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return crossing.select("feature_id").union(inside.select("feature_id")).distinct()


def aliases(tags: list[str], exclude_own_name: bool) -> Column:
    """Other names in tag order without repeats; ways leave out spellings of the name itself."""
    given = ", ".join(f"nullif(trim({tag}), '')" for tag in tags)
    values = f"array_compact(array({given}))"
    if exclude_own_name:
        own = text.squeeze_sql("coalesce(name, '')")
        values = f"filter({values}, v -> {text.squeeze_sql('v')} <> {own})"
    return F.expr(f"array_distinct({values})")


def members_from_json(payload: DataFrame) -> DataFrame:
    """One row per relation member, in order; members without a usable ref are dropped."""
    parsed = F.from_json("members", "array<struct<type:string,ref:string,role:string>>")
    return (
        payload.select("relation_id", F.posexplode(parsed).alias("at", "m"))
        .select(
            "relation_id",
            (F.col("at") + 1).cast("long").alias("pos"),
            F.upper(F.trim("m.type")).alias("member_type"),
            F.expr("try_cast(m.ref AS BIGINT)").alias("ref"),
            F.lower(F.trim(F.coalesce("m.role", F.lit("")))).alias("role"),
        )
        .where((F.col("ref") > 0) & (F.length("member_type") > 0))
    )


def normalise_places(rows: DataFrame) -> DataFrame:
    """Geocoder rows in range, box in west, south, east, north order, first row per identity."""
    parts = F.split("bbox", ",")

    def number(i: int) -> Column:
        return F.expr(f"try_cast(get(split(bbox, ','), {i}) AS DOUBLE)")

    clean = rows.where(
        F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    ).select(
        "osm_type",
        "osm_id",
        "rank",
        F.coalesce(
            F.nullif(F.trim("name"), F.lit("")), F.trim(F.get(F.split("display_name", ","), F.lit(0)))
        ).alias("name"),
        "latitude",
        "longitude",
        F.when(F.size(parts) == 4, number(2)).alias("west"),
        F.when(F.size(parts) == 4, number(0)).alias("south"),
        F.when(F.size(parts) == 4, number(3)).alias("east"),
        F.when(F.size(parts) == 4, number(1)).alias("north"),
    )
    return skew.top_per_group(clean, ["osm_type", "osm_id"], [F.col("rank")], 1)


def flatten_hourly(payload: DataFrame, fields: list[str]) -> DataFrame:
    """Parallel hourly arrays to one row per hour; a missing value stays NULL."""
    return payload.select("point_id", F.inline(F.arrays_zip("time", *fields))).withColumnRenamed(
        "time", "ts"
    )


def dem_lookup(samples: DataFrame, dem: DataFrame, cell_deg: float = 0.001) -> DataFrame:
    """Elevation of each sample from the cell it lies in, one lookup per distinct coordinate.

    Tile columns come first in the join key so a tiled table prunes to the tiles in use.
    """
    keyed = samples.withColumns({"lon7": F.bround("lon", 7), "lat7": F.bround("lat", 7)})
    places = (
        keyed.select("lon7", "lat7")
        .distinct()
        .withColumns(
            {
                "tile_x": geo.cell(F.col("lon7"), 1.0),
                "tile_y": geo.cell(F.col("lat7"), 1.0),
                "cell_x": F.round(F.col("lon7") / cell_deg).cast("long"),
                "cell_y": F.round(F.col("lat7") / cell_deg).cast("long"),
            }
        )
    )
    found = places.join(dem, ["tile_x", "tile_y", "cell_x", "cell_y"], "left").select(
        "lon7", "lat7", "tile_x", "tile_y", "dem_m"
    )
    return keyed.join(found, ["lon7", "lat7"]).drop("lon7", "lat7")
