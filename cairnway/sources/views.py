"""Trail-shaped views over the given tables.

Each view is deterministic SQL arithmetic that means the same in Spark and in the oracle's
dialect, so both sides read the same trails. ``{name}`` stands for a table or another view.
Where a view needs an order inside a group, Spark numbers the rows with ``skew.position`` and
the oracle with ``row_number``; see ``ORACLE_ONLY``.
"""

from __future__ import annotations

_PLACES = (
    "Anamudi|Meesapuli|Kolukku|Chokramudi|Alpenrose|Hochgrat|Säntis|Brienz|Tramuntana|Sierra|"
    "Lauvstad|Kaprun|Ötztal|Marmolada|Cervino|Pilakkavu"
)
_KINDS = (
    "Trail|Path|Road|Ridge Trail|Footpath|Way|Bridge Path|Loop|Temple Path|Peak Trek|Street|"
    "Dead End Path|Hut Path|Local Path"
)


def _pick(items: str, index: str) -> str:
    return f"split_part('{items}', '|', CAST({index} + 1 AS INT))"


def _name(key: str) -> str:
    place = _pick(_PLACES, f"({key} % 16)")
    kind = _pick(_KINDS, f"(CAST(floor({key} / 16) AS BIGINT) % 14)")
    return (
        f"CASE WHEN {key} % 53 = 0 THEN '16' WHEN {key} % 59 = 0 THEN 'Path' "
        f"WHEN {key} % 61 = 0 THEN 'no' WHEN {key} % 17 = 0 THEN NULL "
        f"WHEN {key} % 18 = 0 THEN '' WHEN {key} % 20 = 3 THEN {place} || ' & ' || {kind} "
        f"ELSE {place} || ' ' || {kind} END"
    )


def _other_names(key: str) -> str:
    place = _pick(_PLACES, f"({key} % 16)")
    kind = _pick(_KINDS, f"(CAST(floor({key} / 16) AS BIGINT) % 14)")
    return f"""
      CASE {key} % 5 WHEN 0 THEN {place} || ' ' || {kind} WHEN 1 THEN {place} || ' Walk' END AS name_en,
      CASE WHEN {key} % 41 = 0 THEN {place} || ' Route' END AS int_name,
      CASE WHEN {key} % 13 = 0 THEN '' WHEN {key} % 13 = 1 THEN 'The ' || {place} || ' {{k}}' END AS official_name,
      CASE WHEN {key} % 7 = 0 THEN {place} || ' Circuit' END AS alt_name,
      CASE WHEN {key} % 29 = 0 THEN ' ' || {place} || ' ' END AS loc_name,
      CASE WHEN {key} % 31 = 0 THEN {place} END AS short_name,
      CASE WHEN {key} % 11 = 0 THEN 'Old ' || {kind} END AS old_name""".replace("{k}", "Trail")


_GRADE = (
    "CASE CAST(floor({k} / 5) AS BIGINT) % 14 WHEN 0 THEN 'strolling' WHEN 1 THEN 'hiking' "
    "WHEN 2 THEN 'mountain_hiking' WHEN 3 THEN 'demanding_mountain_hiking' "
    "WHEN 4 THEN 'alpine_hiking' WHEN 5 THEN 'demanding_alpine_hiking' "
    "WHEN 6 THEN 'difficult_alpine_hiking' END"
)

SHARED: dict[str, str] = {
    # One row per line vertex before numbering; s1..s5 give the full order of a line.
    "v_points": """
SELECT l_orderkey AS feature_id,
       CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS part,
       6e0 + (l_orderkey * 37 % 4000) / 200e0 + (l_partkey % 20) / 1000e0 AS lon,
       35e0 + (l_orderkey * 53 % 4000) / 200e0 + ((l_suppkey * 3 + l_linenumber) % 20) / 1000e0 AS lat,
       CASE WHEN l_discount = 0 THEN NULL ELSE 300e0 + l_extendedprice % 3000e0 END AS elevation_m,
       l_linenumber AS s1, l_partkey AS s2, l_suppkey AS s3, l_shipdate AS s4, l_extendedprice AS s5
FROM {lineitem}""",
    "v_ways": f"""
SELECT o_orderkey AS way_id,
       {_name('o_orderkey')} AS name, {_other_names('o_orderkey')},
       CASE o_orderkey % 19 WHEN 0 THEN 'hiking' WHEN 1 THEN 'foot' END AS route,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE
         {_pick('path|track|footway|residential|service|steps|pedestrian|tertiary|bridleway|unclassified', '(o_orderkey * 3 % 10)')} END AS highway,
       {_GRADE.format(k='o_orderkey')} AS sac_scale,
       CASE o_orderkey % 27 WHEN 0 THEN 'good' WHEN 1 THEN 'intermdiate' WHEN 2 THEN ' Bad ' END AS trail_visibility,
       CASE CAST(floor(o_orderkey / 2) AS BIGINT) % 7 WHEN 0 THEN 'ground' WHEN 1 THEN 'asphalt' WHEN 2 THEN 'gravel'
         WHEN 3 THEN 'paved' WHEN 4 THEN 'Rock' END AS surface,
       CASE o_orderkey % 8 WHEN 0 THEN 'bad' WHEN 1 THEN 'good' END AS smoothness,
       CASE WHEN o_orderkey % 6 = 0 THEN 'grade2' END AS tracktype,
       CASE WHEN o_orderkey % 29 = 0 THEN 'private' WHEN o_orderkey % 31 = 0 THEN 'no' END AS access,
       CASE o_orderkey % 10 WHEN 0 THEN 'up' WHEN 1 THEN '12%' WHEN 2 THEN '-8' WHEN 3 THEN '10°' WHEN 4 THEN 'steep'
         WHEN 5 THEN '5-9%' WHEN 6 THEN 'wavy' END AS incline,
       CASE o_orderkey % 12 WHEN 0 THEN '2' WHEN 1 THEN '150 cm' WHEN 2 THEN '3 ft' WHEN 3 THEN '1.5-2.5'
         WHEN 4 THEN '40 in' WHEN 5 THEN 'wide' WHEN 6 THEN '500mm' END AS width,
       CASE o_orderkey % 15 WHEN 0 THEN 'ropes' WHEN 1 THEN 'Rope' WHEN 2 THEN 'ladder' END AS assisted_trail,
       CASE WHEN o_orderkey % 34 = 0 THEN 'designated' END AS foot,
       CASE WHEN o_orderkey % 16 = 3 THEN 'sidewalk' END AS footway_use,
       CASE WHEN o_orderkey % 37 = 0 THEN 'yes' END AS trailblazed,
       CASE WHEN o_orderkey % 47 = 0 THEN 'public_footpath' END AS designation,
       CASE WHEN o_orderkey % 43 = 0 THEN 'yes' END AS hiking,
       CASE WHEN o_orderkey % 67 = 0 THEN 'hiking' END AS sport,
       CASE WHEN o_orderkey % 71 = 0 THEN 0e0 ELSE o_totalprice / 100e0 END AS length_m,
       CASE WHEN o_orderkey % 71 = 0 THEN 0e0 ELSE round(o_totalprice / 100000e0, 3) END AS length_km,
       35e0 + (o_orderkey * 53 % 4000) / 200e0 + 1e-2 AS latitude,
       6e0 + (o_orderkey * 37 % 4000) / 200e0 + 1e-2 AS longitude,
       CASE WHEN o_orderkey % 4 = 0 THEN 'fallback' ELSE 'primary' END AS source
FROM {{orders}}""",
    "v_relations": f"""
SELECT c_custkey AS relation_id,
       {_name('c_custkey')} AS name, {_other_names('c_custkey')},
       CASE c_custkey % 6 WHEN 3 THEN 'foot' WHEN 4 THEN 'walking' WHEN 5 THEN 'bicycle' ELSE 'hiking' END AS route,
       CASE c_custkey % 4 WHEN 0 THEN 'lwn' WHEN 1 THEN 'rwn' WHEN 2 THEN 'nwn' END AS network,
       {_GRADE.format(k='c_custkey')} AS sac_scale,
       CASE WHEN c_custkey % 3 = 0 THEN 'ground' END AS surface,
       round(abs(c_acctbal) / 100e0, 2) AS length_km,
       CASE WHEN c_custkey % 4 = 0 THEN 'fallback' ELSE 'primary' END AS source
FROM {{customer}}""",
    # One row per relation member before numbering.
    "v_member_rows": """
SELECT o_custkey AS relation_id, o_orderdate AS s1, o_orderkey AS ref,
       CASE WHEN o_orderkey % 13 = 0 THEN 'n' ELSE 'w' END AS raw_type,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Alternative' ELSE '' END AS role
FROM {orders}""",
    "v_places": f"""
SELECT s_suppkey AS place_id,
       {_pick(_PLACES, '(s_suppkey % 16)')} AS name,
       CASE WHEN s_suppkey % 4 = 1 THEN {_pick(_PLACES, '(s_suppkey % 16)')} || ' Footpath'
            WHEN s_suppkey % 4 = 2 THEN 'Footpath' ELSE {_pick(_PLACES, '(s_suppkey % 16)')} END AS query,
       6e0 + (s_suppkey * 31 % 400) / 20e0 AS longitude,
       35e0 + (s_suppkey * 17 % 400) / 20e0 AS latitude,
       CASE s_nationkey % 5 WHEN 0 THEN 'peak' WHEN 1 THEN 'town' WHEN 2 THEN 'administrative' WHEN 3 THEN 'Saddle'
         ELSE 'village' END AS place_kind,
       CASE WHEN s_suppkey % 3 = 0 THEN 'area' ELSE 'local' END AS scope,
       CASE s_suppkey % 9 WHEN 0 THEN CAST(CAST(floor(6 + (s_suppkey * 31 % 400) / 20e0) AS BIGINT) AS VARCHAR(20)) || ',40,'
           || CAST(CAST(floor(7 + (s_suppkey * 31 % 400) / 20e0) AS BIGINT) AS VARCHAR(20)) || ',41'
         WHEN 1 THEN 'a,b,c,d' WHEN 2 THEN '10.0,45.0,10.01,45.01' WHEN 3 THEN '9,46,8,47' WHEN 4 THEN '6,35,14,41' END AS bbox
FROM {{supplier}}""",
    # Hourly readings: one row per point and hour, one column per measured quantity.
    "v_hourly": """
SELECT user_id % 20 AS point_id,
       date_trunc('hour', ts) AS ts,
       round(sum(CASE WHEN event_type = 'click' THEN value END) / 100, 4) AS precipitation,
       round(sum(CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN value END) / 100, 4) AS rain,
       max(CASE WHEN event_type = 'view' THEN value END) / 5 AS wind_speed,
       max(CASE WHEN event_type = 'view' THEN value END) / 3 AS wind_gust,
       min(CASE WHEN event_type = 'purchase' THEN value END) / 10 - 10 AS temperature,
       round(sum(CASE WHEN event_type = 'signup' THEN value END) / 500, 4) AS snowfall,
       max(CASE WHEN event_type = 'signup' THEN value END) / 1000 AS snow_depth,
       min(CASE WHEN event_type = 'error' THEN value END) * 40 + 500 AS freezing_level,
       max(CASE WHEN event_type = 'error' THEN value END) AS probability
FROM {events} GROUP BY user_id % 20, date_trunc('hour', ts)""",
    "v_calls": """
SELECT event_id, ts, user_id % 5 AS provider,
       CASE event_type WHEN 'error' THEN 'outage' WHEN 'signup' THEN 'refused' ELSE 'ok' END AS outcome
FROM {events}""",
    # Text candidates for a place, with an explicit map reference on some.
    "v_candidates": f"""
SELECT p_partkey AS candidate_id, p_partkey % 10 AS place_id,
       {_pick(_PLACES, '(p_partkey % 16)')} || ' ' ||
         {_pick('Trail|Ridge Trail|Circuit|Walk|Glen|Peak Trek|Hidden Valley', '(CAST(floor(p_partkey / 16) AS BIGINT) % 7)')} AS name,
       CASE WHEN p_partkey % 5 = 0 THEN {_pick(_PLACES, '(p_partkey % 16)')} || ' Loop' END AS alias,
       CASE p_partkey % 7 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' END AS ref_type,
       CASE WHEN p_partkey % 7 <= 1 THEN p_partkey * 3 % 400 END AS ref_id,
       p_partkey % 2 = 0 AS ref_from_url
FROM {{part}}""",
    "v_results": """
SELECT page_id, page_id % 3 AS query_no, page_id AS rank, url,
       trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, html
FROM {pages}""",
    # One row per route with what the rule engines read: measured terrain, tags and weather.
    "v_conditions": """
SELECT o_orderkey AS feature_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 12000e0 END AS distance_km,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 37 % 1500) * 1e0 END AS gain_m,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 29 % 1400) * 1e0 END AS loss_m,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 31 % 1300) * 1e0 END AS range_m,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 17 % 600) / 10e0 END AS max_slope_pct,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 71 % 4500) * 1e0 END AS max_elevation_m,
  o_orderkey % 4 AS component_count,
  CASE o_orderkey % 8 WHEN 0 THEN 'ground' WHEN 1 THEN 'asphalt' WHEN 2 THEN 'rock' WHEN 3 THEN 'woodchips' WHEN 4 THEN 'grass' END AS surface,
  CASE CAST(floor(o_orderkey / 5) AS BIGINT) % 11 WHEN 0 THEN 'hiking' WHEN 1 THEN 'mountain_hiking' WHEN 2 THEN 'alpine_hiking' WHEN 3 THEN 'demanding_alpine_hiking'
    WHEN 4 THEN 'difficult_alpine_hiking' WHEN 5 THEN 'strolling' END AS sac_scale,
  CASE o_orderkey % 6 WHEN 0 THEN 'walking' WHEN 1 THEN 'mountain' WHEN 2 THEN 'alpine' END AS estimate_tier,
  CASE o_orderkey % 23 WHEN 0 THEN 'yes' WHEN 1 THEN 'via_ferrata' WHEN 2 THEN 'no' END AS assisted_trail,
  CASE WHEN o_orderkey % 41 = 0 THEN 'via_ferrata' ELSE 'path' END AS highway,
  CASE o_orderkey % 3 WHEN 0 THEN 'separate_pieces' WHEN 1 THEN 'gaps' ELSE 'connected' END AS continuity,
  CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 10) / 10e0 END AS main_chain_share,
  o_orderkey % 12 <> 0 AS has_weather,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 7 % 300) / 10e0 END AS rain_24h,
  (o_orderkey * 11 % 250) / 10e0 AS precip_24h,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 3 % 700) / 10e0 END AS rain_72h,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_orderkey * 5 % 600) / 10e0 END AS precip_72h,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 0e0 ELSE (o_orderkey * 13 % 40) / 10e0 END AS precip_now,
  CASE WHEN o_orderkey % 2 = 0 THEN 900e0 END AS precip_interval_s,
  CASE WHEN o_orderkey % 14 = 0 THEN 1.5e0 WHEN o_orderkey % 15 = 0 THEN NULL ELSE 0e0 END AS snowfall,
  CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE (o_orderkey * 19 % 500) / 10e0 - 15 END AS temperature,
  CASE WHEN o_orderkey % 18 = 0 THEN NULL ELSE (o_orderkey * 23 % 800) / 10e0 END AS wind,
  CASE WHEN o_orderkey % 9 = 1 THEN NULL ELSE (o_orderkey * 2 % 80) / 10e0 END AS forecast_rain,
  CASE WHEN o_orderkey % 9 = 2 THEN NULL ELSE (o_orderkey % 101) * 1e0 END AS forecast_prob,
  CASE o_orderkey % 12 WHEN 1 THEN 0 WHEN 2 THEN 45 WHEN 3 THEN 51 WHEN 4 THEN 63 WHEN 5 THEN 65 WHEN 6 THEN 73 WHEN 7 THEN 95 WHEN 8 THEN 3 WHEN 9 THEN 80 END AS weather_code,
  CASE WHEN o_orderkey % 3 = 0 THEN 4e0 END AS window_hours,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 19 % 500) / 10e0 - 18 END AS window_cold,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 29 % 900) / 10e0 END AS window_wind,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 31 % 90) / 10e0 END AS window_peak_mm,
  o_orderkey % 21 = 0 AS snow_likely
FROM {orders}""",
    # Each document's lines are facts about one trail; user turns are questions.
    "v_questions": """
SELECT conv_id, turn, text AS question FROM {conversations} WHERE role = 'user'""",
}

_VERTICES = """
SELECT feature_id, part, row_number() OVER (PARTITION BY feature_id, part ORDER BY s1, s2, s3, s4, s5) AS pos,
       lon, lat, elevation_m FROM v_points"""
_MEMBERS = """
SELECT relation_id, row_number() OVER (PARTITION BY relation_id ORDER BY s1, ref) AS pos,
       upper(raw_type) AS member_type, ref, lower(role) AS role FROM v_member_rows WHERE ref > 0"""

# Views the oracle builds in SQL and Spark builds with operators (see tables.py).
ORACLE_ONLY: dict[str, str] = {
    "v_vertices": _VERTICES,
    "v_members": _MEMBERS,
    "v_segments": """
SELECT * FROM (SELECT feature_id, part, pos, lon, lat, elevation_m,
         lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(elevation_m) OVER w AS elevation2
       FROM v_vertices WINDOW w AS (PARTITION BY feature_id, part ORDER BY pos)) WHERE lon2 IS NOT NULL""",
    "v_seg_km": """
SELECT *, 2 * 6371.0 * atan2(sqrt(least(1.0, greatest(0.0, h))), sqrt(1 - least(1.0, greatest(0.0, h)))) AS km
FROM (SELECT *, sin(radians(lat2 - lat) / 2) * sin(radians(lat2 - lat) / 2) + cos(radians(lat)) * cos(radians(lat2))
        * sin(radians(lon2 - lon) / 2) * sin(radians(lon2 - lon) / 2) AS h FROM v_segments)""",
    "v_profile": """
SELECT v.feature_id, v.part, v.pos, v.lon, v.lat, v.elevation_m,
       coalesce(sum(s.km) OVER (PARTITION BY v.feature_id, v.part ORDER BY v.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS component_km,
       coalesce(sum(s.km) OVER (PARTITION BY v.feature_id ORDER BY v.part, v.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS distance_km
FROM v_vertices v LEFT JOIN v_seg_km s ON s.feature_id = v.feature_id AND s.part = v.part AND s.pos + 1 = v.pos""",
    "v_way_keys": """
SELECT *, trim(regexp_replace(replace(strip_accents(lower(coalesce(name, ''))), '&', ' and '), '[^a-z0-9_]+', ' ', 'g')) AS name_key
FROM v_ways WHERE way_id > 0""",
    "v_features": """
SELECT w.way_id AS feature_id, w.sac_scale,
       CASE WHEN w.sac_scale IN ('strolling', 'hiking') THEN 'walking'
            WHEN w.sac_scale IN ('mountain_hiking', 'demanding_mountain_hiking') THEN 'mountain'
            WHEN w.sac_scale IS NOT NULL THEN 'alpine' END AS tier,
       w.length_km, w.latitude, w.longitude,
       CAST(floor(w.longitude) AS BIGINT) AS grid_x, CAST(floor(w.latitude) AS BIGINT) AS grid_y,
       w.highway, w.surface, w.smoothness, w.tracktype, w.trail_visibility, w.incline, w.width, w.assisted_trail
FROM v_ways w WHERE w.way_id > 0""",
}
