"""Search boxes, tiles, evidence and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo
from cairnway.operators import boxes, discovery, evidence
from cairnway.plans.registry import query
from cairnway.session import stored
from cairnway.sources.tables import Tables
from cairnway.sources.views import ORACLE_ONLY


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


EXPL, GEN = sql_list(lx.EXPLICIT_ROUTE_WORDS), sql_list(lx.GENERIC_TRAIL_WORDS)
# The same boxes from SQL; every other box oracle builds on this view.
_COS = "greatest(0.15, abs(cos(radians({}))))"
ORACLE_ONLY["v_checked"] = f"""
SELECT *, TRY_CAST(trim(split_part(bbox, ',', 1)) AS DOUBLE) AS w0, TRY_CAST(trim(split_part(bbox, ',', 2)) AS DOUBLE) AS s0,
  TRY_CAST(trim(split_part(bbox, ',', 3)) AS DOUBLE) AS e0, TRY_CAST(trim(split_part(bbox, ',', 4)) AS DOUBLE) AS n0,
  coalesce(trim(bbox) <> '', false) AS asked,
  regexp_matches(lower(place_kind), '{'|'.join(lx.PEAK_MARKERS)}') AS is_peak,
  list_filter(string_split(trim(regexp_replace(strip_accents(lower(query)), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda x: len(x) >= 2) AS words
FROM v_places"""
ORACLE_ONLY["v_bad_boxes"] = """
SELECT place_id, CASE WHEN len(string_split(bbox, ',')) <> 4 THEN 'box needs four values'
  WHEN w0 IS NULL OR s0 IS NULL OR e0 IS NULL OR n0 IS NULL THEN 'box values must be finite numbers'
  WHEN NOT (w0 >= -180 AND w0 < e0 AND e0 <= 180 AND s0 >= -90 AND s0 < n0 AND n0 <= 90) THEN 'box bounds out of order' END AS reason
FROM v_checked WHERE asked"""
ORACLE_ONLY["v_boxes"] = f"""
SELECT place_id, name, query, latitude, longitude, place_kind, scope, is_peak,
  CASE WHEN asked AND fits THEN 'requested_bbox' WHEN asked THEN 'expanded_requested_bbox' WHEN is_peak THEN 'peak_radius'
       WHEN scope = 'area' THEN 'area_radius' WHEN one_trail THEN 'local_radius' ELSE 'place_association_radius' END AS box_source,
  CASE WHEN asked AND fits THEN w0 WHEN asked THEN least(w0, greatest(-180, clon - least_km / (111.32 * {_COS.format('clat')})))
       ELSE greatest(-180, longitude - r / (111.32 * {_COS.format('latitude')})) END AS west,
  CASE WHEN asked AND fits THEN s0 WHEN asked THEN least(s0, greatest(-90, clat - least_km / 111.32)) ELSE greatest(-90, latitude - r / 111.32) END AS south,
  CASE WHEN asked AND fits THEN e0 WHEN asked THEN greatest(e0, least(180, clon + least_km / (111.32 * {_COS.format('clat')})))
       ELSE least(180, longitude + r / (111.32 * {_COS.format('latitude')})) END AS east,
  CASE WHEN asked AND fits THEN n0 WHEN asked THEN greatest(n0, least(90, clat + least_km / 111.32)) ELSE least(90, latitude + r / 111.32) END AS north
FROM (SELECT *, CASE WHEN is_peak THEN 6.0 WHEN scope = 'area' THEN 60.0 WHEN one_trail THEN 25.0 ELSE 40.0 END AS r,
        (n0 - s0) * 111.32 >= least_km AND (e0 - w0) * 111.32 * {_COS.format('clat')} >= least_km AS fits
      FROM (SELECT *, (s0 + n0) / 2 AS clat, (w0 + e0) / 2 AS clon, CASE WHEN is_peak THEN 6.0 ELSE 8.0 END AS least_km,
              list_has_any(words, {EXPL}) AND len(list_filter(words, lambda x: NOT list_contains({EXPL}, x) AND NOT list_contains({GEN}, x))) > 0 AS one_trail
            FROM v_checked WHERE place_id NOT IN (SELECT place_id FROM v_bad_boxes WHERE reason IS NOT NULL)))"""
ORACLE_ONLY["v_tiles"] = """
SELECT place_id, latitude, longitude, nr, nc, r, c, r * nc + c AS tile_no,
  west + (east - west) * c / nc AS west, south + (north - south) * r / nr AS south,
  west + (east - west) * (c + 1) / nc AS east, south + (north - south) * (r + 1) / nr AS north
FROM (SELECT *, unnest(range(0, nc)) AS c FROM (SELECT *, unnest(range(0, nr)) AS r FROM (
  SELECT *, CASE WHEN a * b <= 40 THEN a ELSE 6 END AS nr, CASE WHEN a * b <= 40 THEN b ELSE 6 END AS nc FROM (
    SELECT *, CAST(ceil((north - south) / 0.75) AS BIGINT) AS a, CAST(ceil((east - west) / 0.75) AS BIGINT) AS b FROM v_boxes))))"""
ORACLE_ONLY["v_pairs"] = """
SELECT DISTINCT b.place_id, s.feature_id FROM v_boxes b JOIN (
    SELECT feature_id, lon, lat, lon2, lat2 FROM v_segments UNION ALL SELECT feature_id, lon, lat, lon, lat FROM v_vertices) s
  ON greatest(s.lon, s.lon2) >= b.west AND least(s.lon, s.lon2) <= b.east AND greatest(s.lat, s.lat2) >= b.south AND least(s.lat, s.lat2) <= b.north
WHERE greatest(0, CASE WHEN lon2 <> lon THEN least((west - lon) / (lon2 - lon), (east - lon) / (lon2 - lon)) ELSE 0 END,
               CASE WHEN lat2 <> lat THEN least((south - lat) / (lat2 - lat), (north - lat) / (lat2 - lat)) ELSE 0 END)
   <= least(1, CASE WHEN lon2 <> lon THEN greatest((west - lon) / (lon2 - lon), (east - lon) / (lon2 - lon)) ELSE 1 END,
               CASE WHEN lat2 <> lat THEN greatest((south - lat) / (lat2 - lat), (north - lat) / (lat2 - lat)) ELSE 1 END)"""
GENERIC = sql_list(sorted(set(lx.FACILITY_WORDS) | set(lx.GENERIC_WAY_NAMES)))
BARE = sql_list([w for w in lx.FACILITY_WORDS if w not in lx.GENERIC_WAY_NAMES])
ROADISH = "^(" + "|".join(lx.ROAD_WORD_PREFIXES) + ")"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), '&', ' and '), '[^a-z0-9_]+', ' ', 'g'))"


PLACE_WORD = f"""CASE WHEN list_has_any(tok, {sql_list(lx.DESTINATION_NAME_WORDS)}) THEN true WHEN list_has_any(tok, {BARE}) THEN false
  WHEN list_has_any(tok, {EXPL}) AND len(list_filter(tok, lambda x: len(x) >= 4 AND NOT list_contains({GENERIC}, x) AND NOT regexp_matches(x, '{ROADISH}'))) > 0 THEN true
  WHEN len(list_filter(tok, lambda x: regexp_matches(x, '{ROADISH}'))) > 0 THEN false
  ELSE len(list_filter(tok, lambda x: len(x) >= 3 AND NOT list_contains({GENERIC}, x)
    AND len(list_filter({GENERIC}, lambda w: len(x) = len(w) + 1 AND contains(x, w))) = 0)) > 0 END"""
ALL_NAMES = ", ".join(["name"] + lx.ALIAS_TAGS)
ORACLE_ONLY["v_signs"] = f"""
SELECT *, {PLACE_WORD} AS pl, list_has_any(tok, {sql_list(lx.OUTDOOR_NAME_WORDS)}) AS od, list_has_any(tok, {sql_list(lx.DESTINATION_NAME_WORDS)}) AS ds,
  list_has_any(tok, {EXPL}) AS ex,
  len(tok) > 0 AND len(list_filter(tok, lambda x: NOT list_contains({sql_list(lx.GENERIC_TRAIL_WORDS + lx.GENERIC_WAY_NAMES)}, x))) = 0 AS og,
  coalesce(route IN ('hiking', 'foot', 'walking'), false) AS hr, sac_scale IS NOT NULL AS sc, trail_visibility IS NOT NULL AS tv,
  coalesce(foot = 'designated', false) AND coalesce(lower(surface) NOT IN {sql_in(lx.PAVED_SURFACES)}, true) AND coalesce(highway NOT IN {sql_in(lx.URBAN_HIGHWAYS)}, true) AS fd,
  coalesce(sport = 'hiking', false) AS sp, coalesce(highway IN ('path', 'footway', 'bridleway', 'steps', 'track'), false) AS cap,
  coalesce(lower(surface) IN {sql_in(lx.PAVED_SURFACES)}, false) AS paved
FROM (SELECT *, list_distinct(list_filter(string_split(array_to_string(nm, ' '), ' '), lambda x: len(x) >= 2)) AS tok
  FROM (SELECT *, {key_sql('name')} AS k, 2 + way_id % 9 AS point_count,
          list_filter(list_transform([{ALL_NAMES}], lambda n: {key_sql('n')}), lambda n: n <> '') AS nm FROM v_ways WHERE way_id > 0))"""
ORACLE_ONLY["v_evidence"] = f"""
SELECT way_id, name, length_km, sac_scale, k,
  CASE WHEN why IS NOT NULL THEN 0.0 WHEN kind IN ('weak', 'corr') THEN least(greatest(pts, 55.0), 100.0) ELSE least(pts, 100.0) END::DOUBLE AS relevance_score,
  why IS NULL AND kind IN ('strong', 'weak', 'corr') AS accepted,
  CASE WHEN why IS NOT NULL THEN 'none' WHEN kind = 'strong' THEN 'strong' WHEN kind IN ('weak', 'corr') THEN 'weak' ELSE 'none' END AS evidence_class,
  coalesce(why, CASE kind WHEN 'strong' THEN rs WHEN 'weak' THEN concat_ws('; ', nullif(rs, ''), 'named local path; no route or trail-scale tags recorded')
    WHEN 'corr' THEN concat_ws('; ', nullif(rs, ''), 'named local trail corroborated by independent evidence; no route or trail-scale tags recorded')
    WHEN 'short' THEN 'too short to be a route in its own right' WHEN 'paved' THEN 'built-up surface without hiking metadata' ELSE 'insufficient hiking evidence' END) AS reasons
FROM (SELECT *, CASE
    WHEN NOT cap AND NOT md AND NOT od THEN 'highway type is not trail-capable' WHEN k = '' THEN 'unnamed feature'
    WHEN NOT (regexp_full_match(k, '\\d{{1,4}}[a-z]?') AND (sc OR tv)) AND (len(k) < 3 OR NOT regexp_matches(k, '[a-z]')) THEN 'non-descriptive name'
    WHEN length_km <= 0 THEN 'zero-length geometry' WHEN k IN {sql_in(lx.GENERIC_WAY_NAMES)} AND length_km < 0.8 THEN 'generic path identity'
    WHEN len(list_filter(nm, lambda n: regexp_matches(n, '{lx.ROAD_NAME}'))) > 0 AND NOT ex AND NOT md AND NOT od AND NOT pl THEN 'road-oriented name without explicit route evidence'
    WHEN NOT od AND NOT ds AND len(list_filter(nm, lambda n: list_has_any(string_split(n, ' '), {sql_list(lx.STRUCTURE_ACCESS_WORDS)}))) > 0 AND NOT du AND NOT pl THEN 'structure access rather than a route'
    WHEN len(list_filter(nm, lambda n: regexp_matches(n, '{lx.INFRASTRUCTURE_NAME}'))) > 0 AND NOT du AND NOT (pl AND ex) THEN 'ordinary access/infrastructure name'
    WHEN len(list_filter(nm, lambda n: regexp_matches(n, '{lx.RELIGIOUS_NAME}'))) > 0 AND NOT od AND NOT md AND NOT ds AND NOT pl THEN 'religious site access without route evidence'
    WHEN footway_use = 'sidewalk' AND NOT md THEN 'ordinary urban footway use'
    WHEN regexp_matches(k, '{lx.DEAD_END_NAME}') THEN 'name states the way is a dead end'
    WHEN access IN ('no', 'private') AND NOT (hr OR sc) THEN 'restricted access without explicit hiking route' END AS why,
  CASE WHEN md OR (od AND NOT og) THEN 'strong' WHEN length_km < 0.3 THEN 'short' WHEN paved AND NOT du THEN 'paved'
    WHEN surface IS NOT NULL OR tracktype IS NOT NULL OR incline IS NOT NULL OR width IS NOT NULL OR sc OR tv OR length_km >= 1.5 THEN 'weak'
    WHEN pl AND (length_km >= 0.4 OR point_count >= 8 OR od OR ds) THEN 'corr' ELSE 'nothing' END AS kind,
  CASE WHEN hr THEN 100 ELSE 0 END + CASE WHEN sc THEN 92 ELSE 0 END + CASE WHEN tv THEN 88 ELSE 0 END + CASE WHEN fd THEN 74 ELSE 0 END
    + CASE WHEN trailblazed IS NOT NULL THEN 18 ELSE 0 END + CASE WHEN designation IS NOT NULL THEN 14 ELSE 0 END + CASE WHEN hiking IS NOT NULL THEN 16 ELSE 0 END
    + CASE WHEN sp THEN 60 ELSE 0 END + CASE WHEN od AND NOT og THEN 82 ELSE 0 END + CASE WHEN surface IS NOT NULL THEN 5 ELSE 0 END
    + CASE WHEN smoothness IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN tracktype IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN incline IS NOT NULL THEN 4 ELSE 0 END
    + CASE WHEN width IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN cap THEN 48 WHEN highway IN {sql_in(lx.NEUTRAL_HIGHWAYS)} THEN 20 ELSE 0 END AS pts,
  concat_ws('; ', CASE WHEN hr THEN 'route=' || route END, CASE WHEN sc THEN 'sac_scale=' || sac_scale END, CASE WHEN tv THEN 'trail_visibility=' || lower(trim(trail_visibility)) END,
    CASE WHEN fd THEN 'foot=designated' END, CASE WHEN trailblazed IS NOT NULL THEN 'trailblazed metadata' END, CASE WHEN designation IS NOT NULL THEN 'designation metadata' END,
    CASE WHEN hiking IS NOT NULL THEN 'hiking metadata' END, CASE WHEN sp THEN 'sport=hiking' END, CASE WHEN od AND NOT og THEN 'hiking destination/name evidence' END,
    CASE WHEN tracktype IS NOT NULL THEN 'tracktype metadata' END) AS rs
  FROM (SELECT *, hr OR sc OR tv OR fd OR trailblazed IS NOT NULL OR designation IS NOT NULL OR hiking IS NOT NULL OR sp AS md, sc OR tv OR fd OR ds AS du FROM v_signs))"""


@query("resolve_search_box", """SELECT place_id, box_source, is_peak, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east,
  round(north, 9) AS north, CAST(NULL AS VARCHAR) AS reject_reason FROM v_boxes
  UNION ALL SELECT place_id, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v_bad_boxes WHERE reason IS NOT NULL""")
def _resolve(t: Tables):
    good, bad = boxes.search_boxes(t.places())
    sides = [F.round(c, 9).alias(c) for c in boxes.BOX]
    return good.select(
        "place_id", "box_source", "is_peak", *sides, F.lit(None).cast("string").alias("reject_reason")
    ).unionByName(
        bad.select("place_id", F.col("reason").alias("reject_reason")), allowMissingColumns=True
    )


def place_boxes(t: Tables):
    return t.once("boxes", lambda: boxes.search_boxes(t.places())[0])


SIDES = ", ".join(f"round({c}, 9) AS {c}" for c in boxes.BOX)


@query("plan_tiles", f"SELECT place_id, nr AS rows, nc AS cols, tile_no, {SIDES} FROM v_tiles")
def _tiles(t: Tables):
    tiles = boxes.plan_tiles(place_boxes(t))
    return tiles.select("place_id", "rows", "cols", "tile_no", *[F.round(c, 9).alias(c) for c in boxes.BOX])


AWAY = "round(sqrt(pow(((west + east) / 2 - longitude) * cos(radians(latitude)), 2) + pow((south + north) / 2 - latitude, 2)), 9)"


@query("order_tiles_outward", f"""SELECT place_id, tile_no, {AWAY} AS away,
  row_number() OVER (PARTITION BY place_id ORDER BY {AWAY}, tile_no) AS turn FROM v_tiles""")
def _outward(t: Tables):
    tiles = boxes.plan_tiles(place_boxes(t)).withColumn("away", F.round(boxes.outward_key(), 9))
    return skew.position(tiles, ["place_id"], [F.col("away"), F.col("tile_no")], "turn").select(
        "place_id", "tile_no", "away", "turn"
    )


def split_lines(t: Tables):
    return t.once("lines", lambda: boxes.split_lines(t.vertices()))


def box_reach(t: Tables, attached=None, keep=(), places=None):
    """Every search with the lines that meet its box: (box_id, places, is_peak, feature_id, gap, km, closest_km).

    ``attached`` has rows of a feature_id with the columns ``keep``, which come along; a feature
    without such a row is left out. The few lines too long for one row go by their segments.
    """
    shared = boxes.shared_boxes(place_boxes(t) if places is None else places)
    lines, wide = split_lines(t)
    kept = ["box_id", "places", "is_peak", "feature_id", *keep]
    near = discovery.reach_lines(
        boxes.lines_in_boxes(shared, lines if attached is None else lines.join(attached, "feature_id")), kept
    )
    if wide.isEmpty():
        return near
    asked = shared.withColumn("place_id", F.col("box_id"))
    long = t.vertices().join(wide, "feature_id", "left_semi")
    pairs = boxes.join_segments_in_box(asked, t.segments().join(wide, "feature_id", "left_semi"), long)
    rest = discovery.reach(pairs, asked, long).withColumnRenamed("place_id", "box_id").join(
        shared.select("box_id", "places"), "box_id"
    )
    if attached is not None:
        rest = rest.join(attached, "feature_id")
    return near.unionByName(rest.select(*near.columns))


def box_lines(t: Tables):
    """(area, feature_id, bounds of the line): every line that meets a box, once per box whoever asks for it."""

    def build():
        asked = boxes.areas(place_boxes(t))
        lines, wide = split_lines(t)
        bounds = ["_w", "_s", "_e", "_n"]
        sides = [F.col(c).alias(f"_b{c}") for c in bounds]
        met = boxes.lines_in_boxes(asked, lines.select("*", *sides)).select("area", "feature_id", *[F.col(f"_b{c}").alias(c) for c in bounds])
        if not wide.isEmpty():
            long = t.vertices().join(wide, "feature_id", "left_semi")
            pairs = boxes.join_segments_in_box(
                asked.withColumnRenamed("area", "place_id"), t.segments().join(wide, "feature_id", "left_semi"), long
            ).withColumnRenamed("place_id", "area")
            spans = long.groupBy("feature_id").agg(
                F.min("lon").alias("_w"), F.min("lat").alias("_s"), F.max("lon").alias("_e"), F.max("lat").alias("_n")
            )
            met = met.unionByName(pairs.join(spans, "feature_id").select(*met.columns))
        return stored(met, "met")

    return t.once("box_lines", build)


@query("join_features_in_box", "SELECT place_id, feature_id FROM v_pairs")
def _pairs(t: Tables):
    return box_reach(t).select(F.explode("places").alias("place_id"), "feature_id")


ORACLE_ONLY["v_near"] = """
SELECT place_id, feature_id, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (
  SELECT *, sin(radians(lat - latitude) / 2) * sin(radians(lat - latitude) / 2) + cos(radians(latitude)) * cos(radians(lat))
      * sin(radians(lon - longitude) / 2) * sin(radians(lon - longitude) / 2) AS h
  FROM (SELECT p.place_id, p.feature_id, b.latitude, b.longitude, v.lat, v.lon,
      row_number() OVER (PARTITION BY p.place_id, p.feature_id ORDER BY pow((v.lon - b.longitude) * cos(radians(b.latitude)), 2) + pow(v.lat - b.latitude, 2)) AS rn
    FROM v_pairs p JOIN v_boxes b ON b.place_id = p.place_id JOIN v_vertices v ON v.feature_id = p.feature_id) WHERE rn = 1)"""


@query("distance_from_place", "SELECT place_id, feature_id, round(km, 6) AS km FROM v_near")
def _distance(t: Tables):
    return box_reach(t).select(F.explode("places").alias("place_id"), "feature_id", F.round("km", 6).alias("km"))


@query("split_dense_tiles", """WITH RECURSIVE pts AS (SELECT longitude AS x, latitude AS y FROM v_ways WHERE way_id > 0),
  q AS (SELECT 0 AS level, CAST(floor(x / 5.0) AS BIGINT) AS tx, CAST(floor(y / 5.0) AS BIGINT) AS ty, x, y, count(*) OVER (PARTITION BY floor(x / 5.0), floor(y / 5.0)) AS n FROM pts
    UNION ALL
    SELECT level + 1, CAST(floor(x / (5.0 / pow(2, level + 1))) AS BIGINT), CAST(floor(y / (5.0 / pow(2, level + 1))) AS BIGINT), x, y,
      count(*) OVER (PARTITION BY floor(x / (5.0 / pow(2, level + 1))), floor(y / (5.0 / pow(2, level + 1)))) FROM q WHERE n > 40 AND level < 7)
  SELECT CAST(level AS BIGINT) AS level, tx, ty, count(*) AS n, count(*) > 40 AS truncated FROM q WHERE n <= 40 OR level = 7 GROUP BY level, tx, ty""")
def _dense(t: Tables):
    points = t.ways().select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return boxes.dense_tiles(points, cap=40, root_deg=5.0)


def scored_ways(t: Tables):
    # The rules cost far more than a shuffle of the few columns that ways are made of, and a file may be one task.
    counted = t.dealt_ways().withColumn("point_count", 2 + F.col("way_id") % 9)
    return t.once("scored", lambda: evidence.score_ways(counted))


@query("score_way_evidence", "SELECT way_id, accepted, relevance_score, evidence_class, reasons FROM v_evidence")
def _evidence(t: Tables):
    return scored_ways(t).select(
        "way_id", "accepted", "relevance_score", "evidence_class",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("names_a_place", f"SELECT way_id, pl AS names_a_place FROM v_signs")
def _place_word(t: Tables):
    from cairnway.functions import text

    names = F.array(*[text.name_key(c) for c in ["name"] + lx.ALIAS_TAGS])
    tokens = text.tokens(F.array_join(names, " "))
    return t.ways().withColumn("tokens", tokens).select(
        "way_id", text.names_a_place("tokens").alias("names_a_place")
    )


@query("peak_association", """SELECT place_id, feature_id, round(closest, 1) AS closest_approach_m,
  CASE WHEN closest <= 150 THEN 'summit_route' WHEN closest <= 1500 THEN 'peak_approach' ELSE 'nearby_route' END AS association
  FROM (SELECT p.place_id, p.feature_id, min(2000 * 6371.0 * asin(sqrt(pow(sin(radians(v.lat - b.latitude) / 2), 2)
     + cos(radians(b.latitude)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - b.longitude) / 2), 2)))) AS closest
   FROM v_pairs p JOIN v_boxes b ON b.place_id = p.place_id AND b.is_peak JOIN v_vertices v ON v.feature_id = p.feature_id GROUP BY 1, 2)""")
def _peaks(t: Tables):
    near = box_reach(t, places=place_boxes(t).where("is_peak"))
    return near.select(
        F.explode("places").alias("place_id"), "feature_id",
        F.round(1000.0 * F.col("closest_km"), 1).alias("closest_approach_m"),
        discovery.association().alias("association"),
    )
