"""Sources, scans and validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnway import skew
from cairnway.functions import geo
from cairnway.operators import boxes, scans
from cairnway.plans.registry import query
from cairnway.session import scratch
from cairnway.sources.tables import Tables

HIKE = "('hiking', 'foot', 'walking')"
NAMED_WAYS = f"""SELECT * FROM v_ways WHERE way_id > 0 AND name IS NOT NULL AND (
  coalesce(route IN {HIKE}, false) OR sac_scale IS NOT NULL OR trail_visibility IS NOT NULL OR trailblazed IS NOT NULL
  OR designation IS NOT NULL OR hiking IS NOT NULL OR coalesce(sport IN ('hiking', 'walking', 'trail_running'), false)
  OR coalesce(highway IN ('path', 'track', 'footway', 'steps', 'bridleway', 'pedestrian'), false))"""
DISPLAY = (
    "coalesce(nullif(name, ''), nullif(name_en, ''), nullif(int_name, ''), nullif(official_name, ''), "
    "nullif(alt_name, ''), nullif(loc_name, ''), nullif(short_name, ''))"
)
ROAD = "(^| )(residential road|service road|access road|main road|road)( |$)"
RELATIONS = f"""SELECT *, {DISPLAY} AS display_name FROM v_relations WHERE relation_id > 0 AND route IN {HIKE}
  AND {DISPLAY} IS NOT NULL AND (route = 'hiking' OR NOT regexp_matches(lower({DISPLAY}), '{ROAD}'))"""
SCAN_COLUMNS = ["way_id", "name", "route", "highway", "sac_scale", "surface", "length_km", "source"]
BAD_POINTS = """SELECT feature_id, part, pos,
  CASE WHEN feature_id % 31 = 0 AND pos = 2 THEN 400e0 WHEN feature_id % 37 = 0 AND pos = 1 THEN NULL
       WHEN feature_id % 7 = 0 THEN floor(lon * 50e0) / 50e0 ELSE lon END AS lon,
  CASE WHEN feature_id % 7 = 0 THEN floor(lat * 50e0) / 50e0 ELSE lat END AS lat FROM v_vertices"""
TILE = "CAST(floor(longitude / 5.0) AS BIGINT) AS tile_x, CAST(floor(latitude / 5.0) AS BIGINT) AS tile_y"


@query("scan_named_ways", f"SELECT {', '.join(SCAN_COLUMNS)} FROM ({NAMED_WAYS})")
def _named(t: Tables):
    return scans.named_ways(t.ways()).select(*SCAN_COLUMNS)


def relation_lines(t: Tables):
    return (
        t.raw("orders")
        .groupBy(F.col("o_custkey").alias("osm_id"))
        .agg(
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("line_cm"),
            F.count(F.lit(1)).alias("pieces"),
        )
        .withColumn("osm_type", F.lit("R"))
    )


LINES = "SELECT o_custkey AS osm_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS line_cm, count(*) AS pieces FROM orders GROUP BY o_custkey"


@query("scan_route_relations", f"""SELECT relation_id, display_name, route, network, line_cm, pieces
  FROM ({RELATIONS}) r JOIN ({LINES}) l ON l.osm_id = r.relation_id""")
def _relations(t: Tables):
    named = scans.route_relations(t.relations())
    return scans.with_drawn_line(named, relation_lines(t)).select(
        "relation_id", "display_name", "route", "network", "line_cm", "pieces"
    )


@query("join_relation_line", f"""SELECT relation_id, line_cm, pieces FROM v_relations r
  JOIN ({LINES}) l ON l.osm_id = r.relation_id WHERE relation_id > 0""")
def _line(t: Tables):
    return scans.with_drawn_line(t.relations(), relation_lines(t)).select(
        "relation_id", "line_cm", "pieces"
    )


@query("assemble_relations_from_members", """SELECT m.relation_id, m.pos, m.ref, v.part, v.pos AS vertex, v.lon, v.lat
  FROM v_members m JOIN v_vertices v ON v.feature_id = m.ref WHERE m.member_type = 'W'""")
def _assemble(t: Tables):
    return scans.relation_vertices(t.members(), t.vertices())


@query("scan_with_fallback", f"""WITH w AS (SELECT way_id, source, {TILE} FROM v_ways WHERE way_id > 0)
  SELECT way_id, tile_x, tile_y, 'primary' AS served_by FROM w WHERE source = 'primary' AND (tile_x + tile_y) % 5 <> 0
  UNION ALL SELECT way_id, tile_x, tile_y, 'fallback' FROM w WHERE (tile_x + tile_y) % 5 = 0""")
def _fallback(t: Tables):
    ways = t.ways().select(
        "way_id", "source",
        geo.cell(F.col("longitude"), 5.0).alias("tile_x"),
        geo.cell(F.col("latitude"), 5.0).alias("tile_y"),
    )
    status = ways.select("tile_x", "tile_y").distinct().withColumn(
        "failed", (F.col("tile_x") + F.col("tile_y")) % 5 == 0
    )
    first = ways.where(F.col("source") == "primary").drop("source")
    return scans.with_fallback(first, ways.drop("source"), status)


@query("load_features_by_id", """SELECT way_id, name, sac_scale, length_km FROM v_ways WHERE way_id > 0
  AND way_id IN (SELECT ref FROM v_members WHERE member_type = 'W' AND role = 'alternative')""")
def _by_id(t: Tables):
    wanted = t.view("v_member_rows").where(
        (F.col("raw_type") == "w") & (F.lower("role") == "alternative")
    )
    return scans.features_by_id(wanted, t.ways(), "way_id").select(
        "way_id", "name", "sac_scale", "length_km"
    )


PLACE_ROWS = """SELECT CASE c_nationkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
  c_custkey % 300 AS osm_id, c_custkey AS rank, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name,
  c_mktsegment || ' town, ' || c_name AS display_name, c_custkey * 7 % 200 - 95e0 AS latitude, c_custkey * 11 % 380 - 190e0 AS longitude,
  CASE WHEN c_custkey % 4 = 0 THEN '46.5,47.0,8.25,9' WHEN c_custkey % 4 = 1 THEN '1,2' END AS bbox FROM {customer}"""


@query("load_places", f"""SELECT osm_type, osm_id, rank, coalesce(nullif(trim(name), ''), trim(split_part(display_name, ',', 1))) AS name,
  latitude, longitude, CASE WHEN n = 4 THEN TRY_CAST(split_part(bbox, ',', 3) AS DOUBLE) END AS west,
  CASE WHEN n = 4 THEN TRY_CAST(split_part(bbox, ',', 1) AS DOUBLE) END AS south,
  CASE WHEN n = 4 THEN TRY_CAST(split_part(bbox, ',', 4) AS DOUBLE) END AS east,
  CASE WHEN n = 4 THEN TRY_CAST(split_part(bbox, ',', 2) AS DOUBLE) END AS north
  FROM (SELECT *, len(string_split(bbox, ',')) AS n, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY rank) AS rn
        FROM ({PLACE_ROWS.replace('{customer}', 'customer')})
        WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) WHERE rn = 1""")
def _places(t: Tables):
    rows = t.spark.sql(PLACE_ROWS, customer=t.raw("customer"))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude")})
    return scans.normalise_places(rows)


HOURLY = ["precipitation", "rain", "wind_speed", "wind_gust", "temperature", "snowfall", "snow_depth",
          "freezing_level", "probability"]


@query("flatten_hourly_weather", "SELECT point_id, ts, precipitation, wind_speed, temperature, snowfall FROM v_hourly")
def _hourly(t: Tables):
    fields = ["precipitation", "wind_speed", "temperature", "snowfall"]
    # A payload is one point and day, so it never holds more than 24 hours.
    payload = (
        t.hourly()
        .groupBy("point_id", F.to_date("ts").alias("day"))
        .agg(F.array_sort(F.collect_list(F.struct("ts", *fields))).alias("h"))
        .select("point_id", F.col("h.ts").alias("time"), *[F.col(f"h.{f}").alias(f) for f in fields])
    )
    return scans.flatten_hourly(payload, fields)


DEM = """SELECT CAST(floor(lon) AS BIGINT) AS tile_x, CAST(floor(lat) AS BIGINT) AS tile_y,
  CAST(round(lon / 0.001) AS BIGINT) AS cell_x, CAST(round(lat / 0.001) AS BIGINT) AS cell_y,
  round(min(elevation_m), 2) AS dem_m FROM v_points WHERE s1 <= 3 AND elevation_m IS NOT NULL GROUP BY 1, 2, 3, 4"""
DEM_JOIN = f"""SELECT v.feature_id, v.part, v.pos, CAST(floor(v.lon) AS BIGINT) AS tile_x, CAST(floor(v.lat) AS BIGINT) AS tile_y, d.dem_m
  FROM v_vertices v LEFT JOIN ({DEM}) d ON d.tile_x = CAST(floor(v.lon) AS BIGINT) AND d.tile_y = CAST(floor(v.lat) AS BIGINT)
  AND d.cell_x = CAST(round(v.lon / 0.001) AS BIGINT) AND d.cell_y = CAST(round(v.lat / 0.001) AS BIGINT)"""


def dem_samples(t: Tables):
    points = t.view("v_points").where((F.col("s1") <= 3) & F.col("elevation_m").isNotNull())
    dem = points.groupBy(
        geo.cell(F.bround("lon", 7), 1.0).alias("tile_x"),
        geo.cell(F.bround("lat", 7), 1.0).alias("tile_y"),
        F.round(F.bround("lon", 7) / 0.001).cast("long").alias("cell_x"),
        F.round(F.bround("lat", 7) / 0.001).cast("long").alias("cell_y"),
    ).agg(F.round(F.min("elevation_m"), 2).alias("dem_m"))
    return scans.dem_lookup(t.vertices().drop("elevation_m"), dem)


DEM_ORACLE = DEM_JOIN.replace("v.lon", "round(v.lon, 7)").replace("v.lat", "round(v.lat, 7)").replace(
    "floor(lon)", "floor(round(lon, 7))").replace("floor(lat)", "floor(round(lat, 7))").replace(
    "(lon / 0.001)", "(round(lon, 7) / 0.001)").replace("(lat / 0.001)", "(round(lat, 7) / 0.001)")


@query("join_dem_samples", DEM_ORACLE)
def _dem(t: Tables):
    return dem_samples(t).select("feature_id", "part", "pos", "tile_x", "tile_y", "dem_m")


@query("load_elevation_grid", f"SELECT tile_x, tile_y, count(*) AS samples, count(dem_m) AS resolved, "
       f"count(*) - count(dem_m) AS missing FROM ({DEM_ORACLE}) GROUP BY tile_x, tile_y")
def _grid(t: Tables):
    return dem_samples(t).groupBy("tile_x", "tile_y").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count("dem_m").alias("resolved"),
        (F.count(F.lit(1)) - F.count("dem_m")).alias("missing"),
    )


@query("write_dataset", """SELECT feature_id, sac_scale, tier, length_km, CAST(grid_x AS INT) AS grid_x, grid_y FROM v_features
  WHERE sac_scale IS NOT NULL""")
def _write(t: Tables):
    """Fixed columns, one directory per grid column, read back from the sink."""
    columns = ["feature_id", "sac_scale", "tier", "length_km", "grid_x", "grid_y"]
    path = scratch(t.spark, "dataset")
    (
        t.sample()
        .where(F.col("sac_scale").isNotNull())
        .select(*columns)
        .repartition("grid_x", F.pmod(F.xxhash64("feature_id"), F.lit(8)))
        .write.partitionBy("grid_x")
        .parquet(path)
    )
    return t.spark.read.parquet(path).select(*columns)


@query("coalesce_display_name", f"SELECT way_id, {DISPLAY} AS display_name FROM v_ways WHERE way_id > 0")
def _display(t: Tables):
    return t.ways().select("way_id", scans.display_name().alias("display_name"))


ALIAS_LIST = "[trim(name_en), trim(int_name), trim(alt_name), trim(official_name), trim(loc_name), trim(short_name), trim(old_name)]"


def _dedup_sql(items: str) -> str:
    return f"array_to_string(list_filter({items}, lambda x, i: list_position({items}, x) = i), '|')"


def _squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g'))"


@query("collect_aliases", f"""SELECT kind, id, {_dedup_sql('items')} AS aliases FROM (
  SELECT 'way' AS kind, way_id AS id, list_filter({ALIAS_LIST}, lambda x: x IS NOT NULL AND x <> ''
    AND {_squeeze_sql('x')} <> {_squeeze_sql("coalesce(name, '')")}) AS items FROM v_ways WHERE way_id > 0
  UNION ALL SELECT 'relation', relation_id, list_filter({ALIAS_LIST}, lambda x: x IS NOT NULL AND x <> '')
  FROM v_relations WHERE relation_id > 0)""")
def _aliases(t: Tables):
    from cairnway.lexicon import ALIAS_TAGS

    ways = t.ways().select(
        F.lit("way").alias("kind"), F.col("way_id").alias("id"),
        F.array_join(scans.aliases(ALIAS_TAGS, True), "|").alias("aliases"),
    )
    relations = t.relations().select(
        F.lit("relation").alias("kind"), F.col("relation_id").alias("id"),
        F.array_join(scans.aliases(ALIAS_TAGS, False), "|").alias("aliases"),
    )
    return ways.unionByName(relations)


@query("explode_members", """SELECT o_orderkey AS relation_id, p.pos, p.member_type, p.ref, p.role FROM orders,
  (VALUES (1, 'W'), (2, 'N'), (3, 'W')) s(pos0, t),
  LATERAL (SELECT CAST(pos0 AS BIGINT) AS pos, t AS member_type,
    CASE pos0 WHEN 1 THEN o_custkey WHEN 2 THEN o_orderkey % 7 ELSE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END END AS ref,
    CASE pos0 WHEN 1 THEN 'forward' ELSE '' END AS role) p WHERE p.ref > 0""")
def _members(t: Tables):
    payload = t.raw("orders").select(
        F.col("o_orderkey").alias("relation_id"),
        F.format_string(
            '[{"type":"w","ref":%d,"role":"Forward"},{"type":"n","ref":"%d"},{"type":"w","ref":"%s","role":""}]',
            F.col("o_custkey"), F.col("o_orderkey") % 7,
            F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderkey").cast("string")),
        ).alias("members"),
    )
    return scans.members_from_json(payload)


def raw_points(t: Tables):
    return t.spark.sql(BAD_POINTS.replace("v_vertices", "{v}"), v=t.vertices())


@query("filter_usable_geometry", f"""SELECT feature_id, count(*) AS part_count, CAST(sum(n) AS BIGINT) AS point_count FROM (
  SELECT feature_id, part, count(*) AS n, sum(CASE WHEN coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) THEN 0 ELSE 1 END) AS bad
  FROM ({BAD_POINTS}) GROUP BY feature_id, part) GROUP BY feature_id HAVING min(n) >= 2 AND sum(bad) = 0""")
def _usable(t: Tables):
    return scans.usable_features(raw_points(t))


@query("clean_lines", f"""WITH g AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM ({BAD_POINTS})
    WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 WINDOW w AS (PARTITION BY feature_id, part ORDER BY pos)),
  m AS (SELECT *, count(*) OVER (PARTITION BY feature_id, part) AS n FROM g WHERE plon IS NULL OR plon <> lon OR plat <> lat)
  SELECT feature_id, part, pos, lon, lat FROM m WHERE n >= 2""")
def _clean(t: Tables):
    return scans.clean_lines(raw_points(t))


BOX = (8.0, 40.0, 14.0, 47.0)


@query("filter_box", f"""SELECT DISTINCT feature_id FROM v_vertices WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}
  UNION SELECT feature_id FROM (SELECT *,
    CASE WHEN lon2 <> lon THEN least(({BOX[0]} - lon) / (lon2 - lon), ({BOX[2]} - lon) / (lon2 - lon)) WHEN lon BETWEEN {BOX[0]} AND {BOX[2]} THEN 0 ELSE 2 END AS x_in,
    CASE WHEN lon2 <> lon THEN greatest(({BOX[0]} - lon) / (lon2 - lon), ({BOX[2]} - lon) / (lon2 - lon)) WHEN lon BETWEEN {BOX[0]} AND {BOX[2]} THEN 1 ELSE -1 END AS x_out,
    CASE WHEN lat2 <> lat THEN least(({BOX[1]} - lat) / (lat2 - lat), ({BOX[3]} - lat) / (lat2 - lat)) WHEN lat BETWEEN {BOX[1]} AND {BOX[3]} THEN 0 ELSE 2 END AS y_in,
    CASE WHEN lat2 <> lat THEN greatest(({BOX[1]} - lat) / (lat2 - lat), ({BOX[3]} - lat) / (lat2 - lat)) WHEN lat BETWEEN {BOX[1]} AND {BOX[3]} THEN 1 ELSE -1 END AS y_out
    FROM v_segments) WHERE greatest(0, x_in, y_in) <= least(1, x_out, y_out)""")
def _box(t: Tables):
    return scans.in_box(t.segments(), t.vertices(), BOX)


@query("drop_road_named_relations", f"SELECT relation_id, display_name, route FROM ({RELATIONS})")
def _roads(t: Tables):
    return scans.route_relations(t.relations()).select("relation_id", "display_name", "route")
