"""Weather along routes and the rule engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway.operators import rules, terrain, weather
from cairnway.plans.p03_terrain import profile, rounded
from cairnway.plans.registry import query
from cairnway.sources.tables import Tables
from cairnway.sources.views import ORACLE_ONLY

# Observation times: odd points report a time before their series starts.
CURRENT = """SELECT point_id, CASE WHEN point_id % 2 = 1 THEN min(ts) - INTERVAL 5 HOUR ELSE min(ts) + INTERVAL 80 HOUR END AS observed_at,
  1 + (point_id % 9) * 1.5e0 AS window_hours FROM {h} GROUP BY point_id"""
ORACLE_ONLY["v_current"] = CURRENT.replace("{h}", "v_hourly")
ORACLE_ONLY["v_hour"] = """
SELECT c.point_id, c.observed_at, c.window_hours, coalesce(e.ts, f.first_ts) AS hour FROM v_current c JOIN (SELECT point_id, min(ts) AS first_ts FROM v_hourly GROUP BY 1) f USING (point_id)
LEFT JOIN v_hourly e ON e.point_id = c.point_id AND e.ts = date_trunc('hour', c.observed_at)"""
ORACLE_ONLY["v_window"] = """
SELECT c.point_id, c.window_hours, min(temperature) FILTER (d BETWEEN 0 AND ceil(window_hours)) AS min_temperature, max(wind_speed) FILTER (d BETWEEN 0 AND ceil(window_hours)) AS max_wind_speed,
  max(wind_gust) FILTER (d BETWEEN 0 AND ceil(window_hours)) AS max_wind_gust, max(precipitation) FILTER (d BETWEEN 0 AND ceil(window_hours)) AS max_precipitation_mm,
  round(sum(snowfall) FILTER (d BETWEEN 0 AND ceil(window_hours)), 2) AS snowfall_cm, max(snow_depth) FILTER (d BETWEEN 0 AND ceil(window_hours)) AS max_snow_depth_m,
  min(freezing_level) FILTER (d BETWEEN 0 AND ceil(window_hours)) AS min_freezing_level_m, round(sum(snowfall) FILTER (d BETWEEN -72 AND -1), 2) AS recent_snowfall_cm
FROM (SELECT h.*, c.window_hours, date_diff('hour', c.hour, h.ts) AS d FROM v_hourly h JOIN v_hour c ON c.point_id = h.point_id) c GROUP BY 1, 2"""


def current(t: Tables):
    return t.spark.sql(CURRENT, h=t.hourly())


def current_hours(t: Tables):
    now = current(t)
    return weather.current_hour(now, t.hourly()).join(now.select("point_id", "window_hours"), "point_id")


@query("match_current_hour", "SELECT point_id, observed_at, hour FROM v_hour")
def _match(t: Tables):
    return weather.current_hour(current(t), t.hourly())


SPANS = {f"{q}_{n}h": (q, f"{n - 1} HOUR' PRECEDING AND CURRENT ROW") for q in ("precipitation", "rain") for n in (24, 48, 72)}


def _next(fn: str, q: str) -> str:
    return f"{fn}({q}) OVER (PARTITION BY point_id ORDER BY ts RANGE BETWEEN INTERVAL '1 HOUR' FOLLOWING AND INTERVAL '24 HOUR' FOLLOWING)"


@query("rolling_rain", "SELECT point_id, ts, " + ", ".join(
    f"round(sum({q}) OVER (PARTITION BY point_id ORDER BY ts RANGE BETWEEN INTERVAL '{frame}), 4) AS {name}" for name, (q, frame) in SPANS.items())
    + f", round({_next('sum', 'precipitation')}, 4) AS next_precipitation_24h, round({_next('sum', 'rain')}, 4) AS next_rain_24h, round({_next('max', 'probability')}, 4) AS next_probability_max FROM v_hourly")
def _rolling(t: Tables):
    return weather.rolling_rain(t.hourly(), digits=4)


@query("walk_window", """SELECT feature_id, round(CASE WHEN km > 0 THEN greatest(1.0, least(24.0, km / 5.0 + coalesce(elevation_gain_m, 0) / 600.0)) END, 4) AS hours
  FROM (SELECT feature_id, sum(km) AS km FROM v_seg_km GROUP BY 1) m LEFT JOIN v_terrain USING (feature_id)""")
def _walk(t: Tables):
    length = t.measured_segments().groupBy("feature_id").agg(F.sum("km").alias("km"))
    climb = terrain.model_terrain(profile(t), t.line_width()).select("feature_id", "elevation_gain_m")
    hours = weather.walking_hours(F.col("km"), F.col("elevation_gain_m"))
    return rounded(length.join(climb, "feature_id", "left").select("feature_id", hours.alias("hours")), "hours", digits=4)


WINDOW = ["min_temperature", "max_wind_speed", "max_wind_gust", "max_precipitation_mm", "snowfall_cm", "max_snow_depth_m", "min_freezing_level_m", "recent_snowfall_cm"]


@query("weather_window_summary", "SELECT point_id, window_hours, " + ", ".join(f"round({c}, 4) AS {c}" for c in WINDOW) + " FROM v_window")
def _window(t: Tables):
    return rounded(weather.window_summary(t.hourly(), current_hours(t)), *WINDOW, digits=4)


_CODES = [0, 1, 45, 51, 61, 80, 65, 71, 73, 75, 95, 999]
CODE_SQL = "CASE point_id % 12 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CODES[:-1])) + " END"
SEVERITY_SQL = "CASE " + " ".join(f"WHEN weather_code IN ({', '.join(map(str, g))}) THEN {i}" for i, g in enumerate(lx.CODE_SEVERITY_TIERS)) + " ELSE 0 END"
NAME_SQL = "CASE weather_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in lx.WEATHER_CODE_NAMES.items()) + " ELSE 'Unknown' END"
ORACLE_ONLY["v_readings"] = f"""
SELECT r.feature_id, r.sample_no, r.elevation_m, h.temperature, h.wind_speed, h.precipitation, h.snowfall, {CODE_SQL.replace('point_id', 'c.point_id')} AS weather_code, w.* EXCLUDE (point_id, window_hours)
FROM v_route_points r JOIN v_hour c ON c.point_id = (r.feature_id * 5 + r.sample_no) % 20 LEFT JOIN v_hourly h ON h.point_id = c.point_id AND h.ts = c.hour LEFT JOIN v_window w ON w.point_id = c.point_id"""
ORACLE_ONLY["v_worst"] = f"""
SELECT *, {NAME_SQL} AS weather_condition FROM (SELECT feature_id, count(*) AS samples, min(temperature) AS temperature, max(wind_speed) AS wind_speed, max(precipitation) AS precipitation,
  arg_max(weather_code, {SEVERITY_SQL} * 100 - sample_no) FILTER (weather_code IS NOT NULL) AS weather_code, max(elevation_m) AS highest_m, min(min_temperature) AS min_temperature, max(max_wind_speed) AS max_wind_speed,
  max(max_precipitation_mm) AS max_precipitation_mm, max(snowfall_cm) AS snowfall_cm, max(max_snow_depth_m) AS max_snow_depth_m, min(min_freezing_level_m) AS min_freezing_level_m, max(recent_snowfall_cm) AS recent_snowfall_cm
FROM v_readings GROUP BY 1)"""
WORST = ["temperature", "wind_speed", "precipitation", "highest_m", "min_temperature", "max_wind_speed", "max_precipitation_mm", "snowfall_cm", "max_snow_depth_m", "min_freezing_level_m", "recent_snowfall_cm"]


def worst(t: Tables):
    points = terrain.route_points(profile(t), t.line_width()).withColumn("point_id", (F.col("feature_id") * 5 + F.col("sample_no")) % 20)
    hours = current_hours(t)
    window = weather.window_summary(t.hourly(), hours).drop("window_hours")
    here = hours.select("point_id", F.col("hour").alias("ts")).join(t.hourly(), ["point_id", "ts"], "left").select(
        "point_id", "temperature", "wind_speed", "precipitation", "snowfall", F.expr(CODE_SQL).alias("weather_code")
    )
    # Twenty weather points against all routes: readings are joined per point, then reduced.
    readings = points.join(here.join(window, "point_id", "left"), "point_id")
    return weather.route_worst(readings)


@query("route_weather_worst", "SELECT feature_id, samples, weather_code, weather_condition, " + ", ".join(f"round({c}, 4) AS {c}" for c in WORST) + " FROM v_worst")
def _worst(t: Tables):
    return rounded(worst(t).select("feature_id", "samples", "weather_code", "weather_condition", *WORST), *WORST, digits=4)


@query("route_inference", """SELECT feature_id, coalesce(highest_m > min_freezing_level_m, false) AS above_freezing_level, CASE WHEN highest_m > min_freezing_level_m THEN round_even(highest_m - min_freezing_level_m, 0) END AS margin_m,
  coalesce(max_snow_depth_m >= 0.05, false) OR coalesce(snowfall_cm >= 0.5, false) OR (coalesce(highest_m > min_freezing_level_m, false) AND coalesce(recent_snowfall_cm >= 2, false)) AS snow_likely FROM v_worst""")
def _inference(t: Tables):
    return weather.inference(worst(t)).select("feature_id", "above_freezing_level", "margin_m", "snow_likely")


# -- rules ---------------------------------------------------------------------

ORACLE_ONLY["v_effective"] = """
SELECT *, least(temperature, window_cold) AS cold, greatest(wind, window_wind) AS gust, coalesce(rain_24h, precip_24h) AS recent, coalesce(rain_72h, precip_72h) AS r72,
  greatest(CASE WHEN rate >= 7.6 THEN 3 WHEN rate >= 2.5 THEN 2 WHEN rate > 0 THEN 1 ELSE 0 END, CASE WHEN weather_code = 65 THEN 3 WHEN weather_code = 63 THEN 2 WHEN weather_code IN (51, 80) THEN 1 ELSE 0 END) AS lvl,
  coalesce(snowfall > 0, false) OR coalesce(weather_code = 73, false) AS snowing
FROM (SELECT *, greatest(precip_now * 3600 / coalesce(precip_interval_s, 3600), window_peak_mm) AS rate FROM v_conditions)"""
ORACLE_ONLY["v_points_of"] = """
SELECT *, CASE WHEN recent >= 20 THEN 34 WHEN recent >= 5 THEN 22 WHEN recent >= 1 THEN 10 WHEN recent > 0 THEN 3 ELSE 0 END AS f1, CASE lvl WHEN 3 THEN 24 WHEN 2 THEN 10 WHEN 1 THEN 4 ELSE 0 END AS f2,
  CASE WHEN weather_code = 45 THEN 6 ELSE 0 END AS f3, CASE WHEN forecast_rain >= 5 THEN 14 + CASE WHEN forecast_prob >= 70 THEN 4 ELSE 0 END WHEN forecast_rain >= 1 THEN 6 + CASE WHEN forecast_prob >= 70 THEN 3 ELSE 0 END ELSE 0 END AS f4,
  CASE WHEN snowing THEN 30 ELSE 0 END AS f5, CASE WHEN weather_code = 95 THEN 55 ELSE 0 END AS f6, CASE WHEN cold <= 0 THEN 26 WHEN cold <= 5 THEN 16 WHEN cold <= 10 THEN 6 ELSE 0 END AS f7,
  CASE WHEN gust >= 60 THEN 28 WHEN gust >= 40 THEN 25 WHEN gust >= 25 THEN 9 ELSE 0 END AS f8,
  CASE WHEN surface IN ('ground', 'rock', 'grass') AND (coalesce(recent >= 5, false) OR coalesce(forecast_rain >= 5, false) OR lvl >= 2) THEN 8 ELSE 0 END AS f9,
  CASE WHEN max_slope_pct >= 35 THEN 8 WHEN max_slope_pct >= 25 THEN 4 ELSE 0 END AS f10, CASE WHEN gain_m >= 600 AND cold <= 8 THEN 10 ELSE 0 END AS f11, CASE WHEN snow_likely AND NOT snowing THEN 22 ELSE 0 END AS f12,
  CASE WHEN r72 >= 50 THEN 14 WHEN r72 >= 20 THEN 8 ELSE 0 END AS f13,
  len(list_filter([recent IS NULL, r72 IS NULL, precip_now IS NULL, forecast_rain IS NULL, cold IS NULL, gust IS NULL, surface IS NULL, max_slope_pct IS NULL], lambda x: x)) AS gaps FROM v_effective"""
ORACLE_ONLY["v_assessed"] = """
SELECT *, CASE WHEN NOT has_weather OR gaps > 3 THEN 'unknown' WHEN total >= 55 THEN 'adverse' WHEN total >= 25 THEN 'caution' ELSE 'favorable' END AS condition_status,
  CASE WHEN has_weather THEN CAST(total AS BIGINT) END AS condition_score
FROM (SELECT *, greatest(0, least(100, f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8 + f9 + f10 + f11 + f12 + f13)) AS total FROM v_points_of)"""


def assessed(t: Tables):
    return t.once("assessed", lambda: rules.condition(t.view("v_conditions")))


@query("condition_status", """SELECT feature_id, condition_status, condition_score, CAST(CASE WHEN has_weather THEN gaps ELSE 1 END AS BIGINT) AS missing,
  CAST(CASE WHEN has_weather THEN f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8 + f9 + f10 + f11 + f12 ELSE 0 END AS BIGINT) AS factor_points FROM v_assessed""")
def _condition(t: Tables):
    points = F.aggregate("factors", F.lit(0), lambda acc, f: acc + f["weight"])
    return assessed(t).select(
        "feature_id", "condition_status", "condition_score",
        F.size("missing").cast("long").alias("missing"), points.cast("long").alias("factor_points"),
    )


ORACLE_ONLY["v_suited"] = """
SELECT *, CASE WHEN condition_status = 'unknown' THEN 'insufficient_data' WHEN condition_status = 'adverse' THEN 'currently_unfavorable' WHEN condition_status = 'caution' OR demand >= 4 THEN 'caution'
  WHEN demand >= 2 THEN 'demanding' ELSE 'suitable_now' END AS suitability
FROM (SELECT *, CAST(CASE WHEN distance_km >= 12 THEN 2 WHEN distance_km >= 6 THEN 1 ELSE 0 END + CASE WHEN gain_m >= 800 THEN 2 WHEN gain_m >= 350 THEN 1 ELSE 0 END
  + CASE WHEN max_slope_pct >= 35 THEN 2 WHEN max_slope_pct >= 20 THEN 1 ELSE 0 END
  + CASE WHEN has_weather THEN len(list_filter([f1, f2, f3, f4, f5, f6, f7, f8, f9, f10, f11, f12], lambda x: x >= 10)) ELSE 0 END AS BIGINT) AS demand FROM v_assessed)"""


@query("route_suitability", "SELECT feature_id, demand AS demand_points, suitability FROM v_suited")
def _suitability(t: Tables):
    return rules.suitability(assessed(t)).select("feature_id", "demand_points", "suitability")


ORACLE_ONLY["v_active"] = """
SELECT *, CASE WHEN coalesce(sac_scale IN ('demanding_alpine_hiking', 'difficult_alpine_hiking'), false) OR assisted THEN 'technical_alpine' WHEN max_elevation_m >= 3000 THEN 'high_altitude_trek'
  WHEN trip_km >= 25 THEN 'multi_day_trek' ELSE 'day_hike' END AS activity
FROM (SELECT *, coalesce(assisted_trail IN ('yes', 'via_ferrata'), false) OR highway = 'via_ferrata' AS assisted,
   CASE WHEN continuity = 'separate_pieces' AND main_chain_share IS NOT NULL THEN distance_km * main_chain_share ELSE distance_km END AS trip_km FROM v_suited)"""


@query("classify_activity", "SELECT feature_id, activity, round(trip_km, 10) AS trip_km, assisted FROM v_active")
def _activity(t: Tables):
    return rounded(rules.activity(t.view("v_conditions")).select("feature_id", "activity", "trip_km", "assisted"), "trip_km", digits=10)


@query("route_complexity", """SELECT feature_id, complexity, CASE WHEN complexity IS NULL THEN 'unavailable' WHEN complexity < 22 THEN 'low' WHEN complexity < 45 THEN 'moderate' WHEN complexity < 70 THEN 'substantial' ELSE 'demanding' END AS complexity_label
  FROM (SELECT feature_id, round_even(100 * (coalesce(distance_km / (distance_km + 8) * 0.30::DOUBLE, 0) + CASE WHEN gain_m > 0 THEN gain_m / (gain_m + 500) * 0.28::DOUBLE ELSE 0 END + CASE WHEN max_slope_pct IS NOT NULL THEN least(max_slope_pct / 60, 1) * 0.24::DOUBLE ELSE 0 END
    + CASE WHEN range_m > 0 THEN least(range_m / 1200, 1) * 0.18::DOUBLE ELSE 0 END + CASE WHEN component_count > 1 THEN least((component_count - 1) / 6, 1) * 0.10::DOUBLE ELSE 0 END)
    / nullif(CASE WHEN distance_km IS NOT NULL THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN gain_m > 0 THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN max_slope_pct IS NOT NULL THEN 0.24::DOUBLE ELSE 0 END + CASE WHEN range_m > 0 THEN 0.18::DOUBLE ELSE 0 END
    + CASE WHEN component_count > 1 THEN 0.10::DOUBLE ELSE 0 END, 0), 1) AS complexity FROM v_conditions)""")
def _complexity(t: Tables):
    return rules.complexity(t.view("v_conditions")).select("feature_id", "complexity", "complexity_label")


@query("reconcile_difficulty", """SELECT feature_id, recorded_tier, CASE WHEN recorded_tier IS NOT NULL AND estimate_tier IS NOT NULL AND recorded_tier <> estimate_tier THEN 'superseded_by_official_scale' WHEN recorded_tier IS NOT NULL THEN 'official_scale_available'
    WHEN estimate_tier IS NOT NULL THEN 'model_estimate_only' ELSE 'unavailable' END AS difficulty_status,
  CASE coalesce(recorded_tier, estimate_tier) WHEN 'walking' THEN 'Walkable trail' WHEN 'mountain' THEN 'Mountain trail' WHEN 'alpine' THEN 'Alpine / scrambling' END AS shown_difficulty,
  CASE WHEN recorded_tier IS NOT NULL THEN 'official_osm_sac_scale' WHEN estimate_tier IS NOT NULL THEN 'model_estimated' ELSE 'unavailable' END AS provenance
  FROM (SELECT *, CASE WHEN sac_scale IN ('strolling', 'hiking') THEN 'walking' WHEN sac_scale IN ('mountain_hiking', 'demanding_mountain_hiking') THEN 'mountain' WHEN sac_scale IS NOT NULL THEN 'alpine' END AS recorded_tier FROM v_conditions)""")
def _reconcile(t: Tables):
    return rules.reconcile(t.view("v_conditions")).select("feature_id", "recorded_tier", "difficulty_status", "shown_difficulty", "provenance")


ORACLE_ONLY["v_gear_in"] = """
SELECT *, has_weather AND raining_any AND (damp OR most >= 1) AS soaked, has_weather AND raining_any AS raining FROM (
  SELECT *, coalesce(distance_km, 0) AS km, coalesce(max_slope_pct >= 30, false) AS steep, coalesce(gain_m >= 400, false) AS climb, coalesce(distance_km >= 8, false) AS longer,
    has_weather AND coalesce(temperature >= 28, false) AS hot, CASE WHEN has_weather THEN cold END AS chill, CASE WHEN has_weather THEN gust END AS blow, has_weather AND coalesce(precip_now > 0, false) AS falling,
    has_weather AND (snowing OR snow_likely) AS snowy, activity = 'technical_alpine' AS technical, most > 0 OR coalesce(forecast_prob >= 50, false) OR damp AS raining_any FROM (
    SELECT *, coalesce(recent > 0, false) OR lvl > 0 AS damp, greatest(0, recent, precip_now, forecast_rain) AS most FROM v_active))"""
_GEAR = [
    ("trail_footwear", "footwear", "true", "'essential'", "CASE WHEN surface IS NOT NULL AND surface <> 'asphalt' THEN 'Trail shoes with an outsole suited to ' || surface ELSE 'Broken-in trail shoes' END"),
    ("navigation", "navigation", "true", "'essential'", "'Offline access to this route'"),
    ("overnight", "shelter", "trip_km >= 25", "'recommended'", "'Overnight plan: huts, lodging or shelter and a sleep system'"),
    ("resupply", "food", "trip_km >= 25", "'recommended'", "'Food and water resupply plan for each day'"),
    ("light", "lighting", "coalesce(trip_km >= 25, false) OR longer OR climb", "CASE WHEN trip_km >= 25 THEN 'recommended' ELSE 'conditional' END", "CASE WHEN trip_km >= 25 THEN 'Headlamp' ELSE 'Headlamp, if any of the route is walked after dark' END"),
    ("acclimatisation", "acclimatisation", "max_elevation_m >= 3000", "CASE WHEN max_elevation_m >= 4000 THEN 'essential' ELSE 'recommended' END", "'Acclimatisation plan and the signs of altitude sickness'"),
    ("insulation", "clothing", "coalesce(max_elevation_m >= 3000, false) OR coalesce(chill <= 4, false)", "CASE WHEN chill <= 4 THEN 'essential' ELSE 'recommended' END",
     "CASE WHEN chill <= -10 THEN 'Expedition insulation: mitts, balaclava and insulated boots' WHEN max_elevation_m >= 3000 THEN 'Insulating layer for the high sections' ELSE 'Insulated jacket, hat and gloves' END"),
    ("sun_protection", "sun protection", "coalesce(max_elevation_m >= 3000, false) OR (has_weather AND temperature >= 27 AND NOT raining)", "'recommended'", "CASE WHEN max_elevation_m >= 3000 THEN 'Sunglasses and high-SPF sun protection' ELSE 'Sun hat, sunglasses and sunscreen' END"),
    ("experience", "experience", "technical", "'essential'", "'Mountaineering experience, or a qualified guide'"),
    ("helmet", "equipment", "technical", "CASE WHEN assisted THEN 'essential' ELSE 'recommended' END", "'Climbing helmet'"),
    ("harness", "equipment", "technical AND assisted", "'essential'", "'Harness and via ferrata set'"),
    ("poles", "equipment", "climb OR steep OR (steep AND coalesce(range_m >= 300, false) AND soaked)", "'recommended'", "'Trekking poles'"),
    ("socks", "clothing", "climb OR steep", "'recommended'", "'Socks, plus a spare pair'"),
    ("hydration", "hydration", "longer OR hot OR km >= 3", "CASE WHEN longer OR hot THEN 'essential' ELSE 'recommended' END", "CASE WHEN hot THEN 'Water and electrolytes for the route length, and extra for the heat' WHEN longer THEN 'Water and electrolytes for the route length' ELSE 'Water for the route length' END"),
    ("first_aid", "first_aid", "longer OR climb", "'recommended'", "'Small first-aid kit'"),
    ("rain_shell", "clothing", "soaked", "'essential'", "'Waterproof shell'"),
    ("wet_footwear", "clothing", "soaked AND falling AND surface IS NOT NULL", "'conditional'", "'Waterproof over-trousers'"),
    ("thermal_layer", "clothing", "chill <= 12", "'essential'", "'Fleece or synthetic mid layer'"),
    ("wind_layer", "clothing", "blow >= 30", "'essential'", "'Windproof outer layer'"),
    ("winter_equipment", "equipment", "snowy", "CASE WHEN steep OR climb THEN 'essential' ELSE 'recommended' END", "CASE WHEN steep OR climb THEN 'Ice axe or crampons, matched to the route' ELSE 'Waterproof boots and warm layers for snow underfoot' END"),
]
_GROUP = {"navigation": "preparation", "first_aid": "preparation", "acclimatisation": "preparation", "experience": "preparation", "hydration": "supplies", "food": "supplies"}
ORACLE_ONLY["v_gear"] = " UNION ALL ".join(
    f"SELECT feature_id, '{need}' AS need, '{cat}' AS category, {prio} AS priority, {item} AS item, '{_GROUP.get(cat, 'equipment')}' AS gear_group FROM v_gear_in WHERE {test}"
    for need, cat, test, prio, item in _GEAR)
PRIO = "CASE priority WHEN 'essential' THEN 1 WHEN 'recommended' THEN 2 ELSE 3 END"


def gear(t: Tables):
    return t.once("gear", lambda: rules.gear(rules.activity(assessed(t))))


@query("recommend_gear", "SELECT feature_id, need, category, priority, item, gear_group FROM v_gear")
def _gear(t: Tables):
    return gear(t).drop("evidence")


@query("gear_counts", """SELECT feature_id, count(*) FILTER (priority = 'essential') AS essential, count(*) FILTER (priority = 'recommended') AS recommended, count(*) FILTER (priority = 'conditional') AS conditional,
  count(*) FILTER (gear_group = 'equipment') AS equipment, count(*) FILTER (gear_group = 'supplies') AS supplies, count(*) FILTER (gear_group = 'preparation') AS preparation FROM v_gear GROUP BY 1""")
def _counts(t: Tables):
    return rules.gear_counts(gear(t))


@query("order_gear", f"SELECT feature_id, need, row_number() OVER (PARTITION BY feature_id ORDER BY {PRIO}, item, need) AS place FROM v_gear")
def _order(t: Tables):
    return rules.ordered_gear(gear(t)).select("feature_id", "need", "place")


@query("select_gear_items", f"""SELECT feature_id, need, item, row_number() OVER (PARTITION BY feature_id ORDER BY {PRIO}, item, need) AS place FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, lower(item) ORDER BY {PRIO}, need) AS rn
  FROM v_gear WHERE need NOT IN ('navigation', 'overnight', 'resupply', 'acclimatisation', 'experience')) WHERE rn = 1""")
def _buyable(t: Tables):
    return rules.buyable(gear(t)).select("feature_id", "need", "item", "place")


VOTES = """SELECT relation_id AS route_id, pos, ref % 7 <> 0 AS scored, CASE ref % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'mountain' ELSE 'alpine' END AS tier,
  CASE WHEN ref % 3 = 0 THEN 0.5e0 + ref % 5 / 16e0 ELSE 0.125e0 END AS p_walking, CASE WHEN ref % 3 = 1 THEN 0.5e0 + ref % 5 / 16e0 ELSE 0.125e0 END AS p_mountain,
  CASE WHEN ref % 3 = 2 THEN 0.5e0 + ref % 5 / 16e0 ELSE 0.125e0 END AS p_alpine FROM {m} WHERE member_type = 'W'"""
ORACLE_ONLY["v_votes"] = VOTES.replace("{m}", "v_members")


@query("route_tier_vote", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY route_id) AS total FROM v_votes),
  s AS (SELECT route_id, tier, count(*) AS n FROM f WHERE rn <= 25 AND scored GROUP BY 1, 2),
  q AS (SELECT route_id, max(total) AS total, count(*) FILTER (scored AND rn <= 25) AS k, round_even(sum(round_even(p_walking, 4)) FILTER (scored AND rn <= 25), 4) AS mw, round_even(sum(round_even(p_mountain, 4)) FILTER (scored AND rn <= 25), 4) AS mm,
    round_even(sum(round_even(p_alpine, 4)) FILTER (scored AND rn <= 25), 4) AS ma FROM f GROUP BY 1),
  x AS (SELECT q.*, u.i, u.t, u.m, coalesce(s.n, 0) AS n FROM q, LATERAL (VALUES (0, 'walking', mw), (1, 'mountain', mm), (2, 'alpine', ma)) u(i, t, m) LEFT JOIN s ON s.route_id = q.route_id AND s.tier = u.t),
  r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, m DESC, i) AS pl FROM x),
  a AS (SELECT a.route_id, a.total, a.k, a.t, a.n, a.m, b.n AS n2, b.m AS m2, a.k >= 2 OR (a.k = 1 AND a.total = 1) AS ok FROM r a JOIN r b ON a.route_id = b.route_id AND a.pl = 1 AND b.pl = 2)
  SELECT route_id, total AS total_members, k AS scored_members, CASE WHEN ok THEN t END AS tier, CASE WHEN ok THEN round_even(n / k, 4) END AS agreement, CASE WHEN ok THEN round_even(m / k, 4) END AS confidence,
    CASE WHEN ok THEN round_even(n / k, 4) < 2 / 3 END AS members_disagree, CASE WHEN ok THEN k > 1 AND n = n2 AND m = m2 END AS tied, total > 25 AS truncated FROM a""")
def _vote(t: Tables):
    return rules.tier_vote(t.spark.sql(VOTES, m=t.members()))
