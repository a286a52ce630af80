"""Route geometry and elevation profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnway import skew
from cairnway import lexicon as lx
from cairnway.functions import geo
from cairnway.operators import terrain
from cairnway.plans.registry import query
from cairnway.sources.tables import Tables
from cairnway.sources.views import ORACLE_ONLY


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def profile(t: Tables):
    return terrain.profile(t.vertices(), t.line_width())


@query("cumulative_distance", """SELECT feature_id, part, pos, round(component_km, 6) AS component_km, round(distance_km, 6) AS distance_km FROM v_profile""")
def _cumulative(t: Tables):
    return rounded(
        profile(t).select("feature_id", "part", "pos", "component_km", "distance_km"),
        "component_km", "distance_km",
    )


ORACLE_ONLY["v_shape"] = """
SELECT feature_id, sum(coalesce(abs(turn), 0)) / count(*) AS mean_turn, count(*) / sum(km) AS verts_per_km FROM (
  SELECT *, d - 2 * pi() * floor((d + pi()) / (2 * pi())) AS turn FROM (
    SELECT *, b - lag(b) OVER (PARTITION BY feature_id, part ORDER BY pos) AS d FROM (
      SELECT feature_id, part, pos, sqrt(dx * dx + dy * dy) AS km, atan2(dy, dx) AS b FROM (
        SELECT s.*, (lon2 - lon) * 111.32 * greatest(0.05, cos(radians(m.mean_lat))) AS dx, (lat2 - lat) * 110.574 AS dy
        FROM v_segments s JOIN (SELECT feature_id, part, avg(lat) AS mean_lat FROM v_vertices GROUP BY 1, 2) m USING (feature_id, part))
      WHERE dx * dx + dy * dy > 0))) GROUP BY feature_id"""


@query("route_shape", "SELECT feature_id, round(mean_turn, 6) AS mean_turn, round(verts_per_km, 6) AS verts_per_km FROM v_shape")
def _shape(t: Tables):
    return rounded(terrain.route_shape(t.vertices(), t.line_width()), "mean_turn", "verts_per_km")


ORACLE_ONLY["v_measures"] = """
SELECT p.*, m.lon AS middle_lon, m.lat AS middle_lat FROM (
  SELECT feature_id, sum(km) AS km, count(*) AS part_count, CAST(sum(points) AS BIGINT) AS point_count, min(west) AS west, min(south) AS south, max(east) AS east,
    max(north) AS north, first(part ORDER BY round(km, 9) DESC, part) AS main_part, max(km) AS main_km FROM (
    SELECT feature_id, part, sum(km) AS km, count(*) + 1 AS points, min(least(lon, lon2)) AS west, min(least(lat, lat2)) AS south,
      max(greatest(lon, lon2)) AS east, max(greatest(lat, lat2)) AS north FROM v_seg_km GROUP BY 1, 2) GROUP BY 1) p
JOIN (SELECT feature_id, part, lon + (lon2 - lon) * (half - upto + km) / greatest(km, 1e-12) AS lon, lat + (lat2 - lat) * (half - upto + km) / greatest(km, 1e-12) AS lat FROM (
    SELECT *, sum(km) OVER (PARTITION BY feature_id, part ORDER BY pos) AS upto, sum(km) OVER (PARTITION BY feature_id, part) / 2 AS half FROM v_seg_km)
  WHERE upto >= half QUALIFY row_number() OVER (PARTITION BY feature_id, part ORDER BY pos) = 1) m
ON m.feature_id = p.feature_id AND m.part = p.main_part"""


@query("route_measures", """SELECT feature_id, round(km, 6) AS km, part_count, point_count, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east,
  round(north, 6) AS north, main_part, round(main_km, 6) AS main_km, round(middle_lon, 5) AS middle_lon, round(middle_lat, 5) AS middle_lat FROM v_measures""")
def _measures(t: Tables):
    out = terrain.route_measures(t.measured_segments(), t.line_width())
    out = rounded(out, "km", "west", "south", "east", "north", "main_km")
    return rounded(out, "middle_lon", "middle_lat", digits=5)


@query("smooth_profile", """SELECT feature_id, part, pos, round(CASE WHEN n < 3 THEN elevation_m ELSE m END, 4) AS smooth_m FROM (
  SELECT *, count(*) OVER (PARTITION BY feature_id, part) AS n, avg(elevation_m) OVER (PARTITION BY feature_id, part ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m
  FROM v_vertices WHERE elevation_m IS NOT NULL)""")
def _smooth(t: Tables):
    usable = t.vertices().where(F.col("elevation_m").isNotNull())
    return rounded(terrain.smooth(usable).select("feature_id", "part", "pos", "smooth_m"), "smooth_m", digits=4)


ORACLE_ONLY["v_display"] = """
WITH u AS (SELECT *, lag(elevation_m) OVER w AS prev_m, count(*) OVER (PARTITION BY feature_id, part) AS n,
    avg(elevation_m) OVER (PARTITION BY feature_id, part ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m
    FROM v_profile WHERE elevation_m IS NOT NULL WINDOW w AS (PARTITION BY feature_id, part ORDER BY pos)),
  s AS (SELECT *, CASE WHEN n < 3 THEN elevation_m ELSE m END AS sm FROM u),
  g AS (SELECT a.feature_id, a.part, a.pos, a.component_km AS d0, a.sm AS h0, b.component_km AS d1, b.sm AS h1,
      row_number() OVER (PARTITION BY a.feature_id, a.part, a.pos ORDER BY b.component_km, b.pos) AS rn
    FROM s a JOIN s b ON a.feature_id = b.feature_id AND a.part = b.part AND b.component_km >= a.component_km + 0.150),
  sl AS (SELECT feature_id, sum(abs(h1 - h0) / (d1 - d0) / 10 * (d1 - d0)) / sum(d1 - d0) AS average_slope_pct, max(abs(h1 - h0) / (d1 - d0) / 10) AS max_slope_pct
    FROM g WHERE rn = 1 AND d1 > d0 GROUP BY 1)
SELECT t.*, average_slope_pct, max_slope_pct FROM (SELECT feature_id, min(elevation_m) AS min_m, max(elevation_m) AS max_m, max(elevation_m) - min(elevation_m) AS range_m,
    coalesce(sum(greatest(elevation_m - prev_m, 0)), 0) AS gain_m, coalesce(sum(greatest(prev_m - elevation_m, 0)), 0) AS loss_m FROM s GROUP BY 1 HAVING count(*) >= 2) t
LEFT JOIN sl USING (feature_id)"""
DISPLAY = ["min_m", "max_m", "range_m", "gain_m", "loss_m", "average_slope_pct", "max_slope_pct"]


@query("terrain_metrics_display", "SELECT feature_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in DISPLAY) + " FROM v_display")
def _display(t: Tables):
    return rounded(terrain.display_terrain(profile(t), t.line_width()), *DISPLAY, digits=4)


ORACLE_ONLY["v_samples90"] = """
WITH u AS (SELECT feature_id, part, pos, component_km * 1000 AS d, elevation_m AS h, row_number() OVER w AS k, count(*) OVER (PARTITION BY feature_id, part) AS n
    FROM v_profile WHERE elevation_m IS NOT NULL WINDOW w AS (PARTITION BY feature_id, part ORDER BY pos)),
  p AS (SELECT feature_id, part, max(d) - min(d) AS len, greatest(2, CAST(ceil((max(d) - min(d)) / 90.0) AS BIGINT) + 1) AS c FROM u GROUP BY 1, 2 HAVING count(*) >= 2 AND max(d) - min(d) >= 90),
  e AS (SELECT a.feature_id, a.part, a.k, a.n, a.d, a.h, b.d AS d2, b.h AS h2, p.len, p.c FROM u a JOIN u b ON a.feature_id = b.feature_id AND a.part = b.part AND b.k = a.k + 1
    JOIN p ON p.feature_id = a.feature_id AND p.part = a.part),
  i AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE CAST(floor(d * ((c - 1) / len)) AS BIGINT) + 1 END AS lo,
      CASE WHEN k = n - 1 THEN c - 1 ELSE least(c - 1, CAST(floor(d2 * ((c - 1) / len)) AS BIGINT)) END AS hi FROM e)
SELECT feature_id, part, sample, len, c, CASE WHEN d2 > d THEN h + (h2 - h) * (len * sample / (c - 1) - d) / (d2 - d) ELSE h END AS height
FROM (SELECT *, unnest(range(lo, hi + 1)) AS sample FROM i WHERE lo <= hi)"""
ORACLE_ONLY["v_terrain"] = """
SELECT feature_id, sum(gain) AS elevation_gain_m, sum(loss) AS elevation_loss_m, max(hi) - min(lo) AS elevation_range_m, sum((gain + loss) / len * 100 * len) / sum(len) AS average_slope_pct,
  max(steepest) AS max_slope_pct FROM (
  SELECT feature_id, part, max(len) AS len, sum(greatest(height - prev, 0)) AS gain, sum(greatest(prev - height, 0)) AS loss, max(abs(height - prev) / (len / (c - 1)) * 100) AS steepest,
    min(height) AS lo, max(height) AS hi FROM (SELECT *, lag(height) OVER (PARTITION BY feature_id, part ORDER BY sample) AS prev FROM v_samples90) GROUP BY 1, 2) GROUP BY 1"""
TERRAIN = ["elevation_gain_m", "elevation_loss_m", "elevation_range_m", "average_slope_pct", "max_slope_pct"]


@query("resample_component", """SELECT feature_id, part, count(*) AS samples, CAST(max(sample) AS BIGINT) AS last_sample, round(avg(height), 4) AS mean_m, round(min(height), 4) AS low_m,
  round(max(height), 4) AS high_m FROM v_samples90 GROUP BY 1, 2""")
def _resample(t: Tables):
    """Every sample is produced; the result keeps one row per part so it stays readable."""
    return terrain.resample(profile(t), t.line_width()).groupBy("feature_id", "part").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max("sample").alias("last_sample"),
        F.round(F.avg("height_m"), 4).alias("mean_m"),
        F.round(F.min("height_m"), 4).alias("low_m"),
        F.round(F.max("height_m"), 4).alias("high_m"),
    )


@query("terrain_metrics_model", "SELECT feature_id, " + ", ".join(f"round({c}, 3) AS {c}" for c in TERRAIN) + " FROM v_terrain")
def _terrain(t: Tables):
    out = terrain.model_terrain(profile(t), t.line_width()).drop("terrain_available")
    return rounded(out, *TERRAIN, digits=3)


@query("sample_along_line", """WITH s AS (SELECT *, sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)) AS deg FROM v_seg_km),
  w AS (SELECT *, sum(deg) OVER (PARTITION BY feature_id, part ORDER BY pos) AS upto, sum(deg) OVER p AS tot, sum(km) OVER p AS len, max(pos) OVER p AS last_pos FROM s WINDOW p AS (PARTITION BY feature_id, part)),
  c AS (SELECT *, greatest(2, CAST(ceil(len * 1000 / 90.0) AS BIGINT) + 1) AS c FROM w WHERE len * 1000 >= 90 AND tot > 0),
  i AS (SELECT *, CASE WHEN pos = 1 THEN 0 ELSE CAST(floor((upto - deg) * ((c - 1) / tot)) AS BIGINT) + 1 END AS lo, CASE WHEN pos = last_pos THEN c - 1 ELSE least(c - 1, CAST(floor(upto * ((c - 1) / tot)) AS BIGINT)) END AS hi FROM c),
  x AS (SELECT *, unnest(range(lo, hi + 1)) AS k FROM i WHERE lo <= hi),
  y AS (SELECT *, CASE WHEN deg > 0 THEN greatest(0, least(1, (tot * k / (c - 1) - upto + deg) / deg)) ELSE 0 END AS f FROM x)
  SELECT feature_id, part, count(*) AS samples, round(avg(lon + (lon2 - lon) * f), 6) AS mean_lon, round(avg(lat + (lat2 - lat) * f), 6) AS mean_lat FROM y GROUP BY 1, 2""")
def _along(t: Tables):
    return terrain.sample_along(t.measured_segments(), t.line_width()).groupBy("feature_id", "part").agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg("lon"), 6).alias("mean_lon"),
        F.round(F.avg("lat"), 6).alias("mean_lat"),
    )


@query("orient_profile", """SELECT feature_id, CASE WHEN sure THEN 'low_to_high' ELSE 'as_mapped' END AS orientation, sure AND b < a AS reversal_needed FROM (
  SELECT feature_id, a, b, coalesce(parts = 1 AND n >= 2 AND abs(b - a) >= 10, false) AS sure FROM (
    SELECT feature_id, count(DISTINCT part) AS parts, count(*) AS n, max(CASE WHEN r = 1 THEN elevation_m END) AS a, max(CASE WHEN q = 1 THEN elevation_m END) AS b
    FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY part, pos) AS r, row_number() OVER (PARTITION BY feature_id ORDER BY part DESC, pos DESC) AS q FROM v_vertices) GROUP BY 1)) z
  """.replace("sure AND b < a", "coalesce(sure AND b < a, false)"))
def _orient(t: Tables):
    return terrain.orientation(t.vertices())


ORACLE_ONLY["v_route_points"] = """
WITH u AS (SELECT *, max(distance_km) OVER (PARTITION BY feature_id) AS tot FROM v_profile WHERE elevation_m IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY part, pos) AS k0, row_number() OVER (PARTITION BY feature_id ORDER BY elevation_m DESC, part, pos) AS k1,
    row_number() OVER (PARTITION BY feature_id ORDER BY elevation_m, part, pos) AS k2, row_number() OVER (PARTITION BY feature_id ORDER BY part DESC, pos DESC) AS k3,
    row_number() OVER (PARTITION BY feature_id ORDER BY round(abs(distance_km - tot / 2), 9), part, pos) AS k4 FROM u),
  p AS (SELECT feature_id, 0 AS no, 'start' AS label, lat, lon, elevation_m AS m FROM r WHERE k0 = 1 UNION ALL SELECT feature_id, 1, 'highest', lat, lon, elevation_m FROM r WHERE k1 = 1
    UNION ALL SELECT feature_id, 2, 'lowest', lat, lon, elevation_m FROM r WHERE k2 = 1 UNION ALL SELECT feature_id, 3, 'end', lat, lon, elevation_m FROM r WHERE k3 = 1
    UNION ALL SELECT feature_id, 4, 'midpoint', lat, lon, elevation_m FROM r WHERE k4 = 1),
  near AS (SELECT a.feature_id, a.no AS i, b.no AS j FROM p a JOIN p b ON a.feature_id = b.feature_id AND b.no < a.no AND abs(a.m - b.m) < 150
    AND sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)) * 111.195, 2) + pow((b.lat - a.lat) * 111.195, 2)) < 0.3),
  h1 AS (SELECT p.*, coalesce((SELECT min(j) FROM near n WHERE n.feature_id = p.feature_id AND n.i = 1), 1) AS home1 FROM p),
  h2 AS (SELECT *, coalesce((SELECT min(j) FROM near n WHERE n.feature_id = h1.feature_id AND n.i = 2 AND (n.j = 0 OR (n.j = 1 AND home1 = 1))), 2) AS home2 FROM h1),
  h3 AS (SELECT *, coalesce((SELECT min(j) FROM near n WHERE n.feature_id = h2.feature_id AND n.i = 3 AND (n.j = 0 OR (n.j = 1 AND home1 = 1) OR (n.j = 2 AND home2 = 2))), 3) AS home3 FROM h2),
  h4 AS (SELECT *, coalesce((SELECT min(j) FROM near n WHERE n.feature_id = h3.feature_id AND n.i = 4 AND (n.j = 0 OR (n.j = 1 AND home1 = 1) OR (n.j = 2 AND home2 = 2) OR (n.j = 3 AND home3 = 3))), 4) AS home4 FROM h3),
  f AS (SELECT *, CASE no WHEN 0 THEN 0 WHEN 1 THEN home1 WHEN 2 THEN home2 WHEN 3 THEN home3 ELSE home4 END AS home FROM h4)
SELECT a.feature_id, CAST(a.no AS BIGINT) AS sample_no, (SELECT string_agg(b.label, '|' ORDER BY b.no) FROM f b WHERE b.feature_id = a.feature_id AND b.home = a.no) AS labels, a.lat, a.lon, a.m AS elevation_m
FROM f a WHERE a.home = a.no"""


@query("pick_route_points", "SELECT feature_id, sample_no, labels, round(lat, 6) AS lat, round(lon, 6) AS lon, round(elevation_m, 2) AS elevation_m FROM v_route_points")
def _points(t: Tables):
    return rounded(rounded(terrain.route_points(profile(t), t.line_width()), "lat", "lon"), "elevation_m", digits=2)


CHANGED = """SELECT feature_id, part, pos, CASE WHEN feature_id % 13 = 0 AND pos = 1 THEN lon + 0.001 ELSE lon END AS lon, lat
  FROM {v} WHERE feature_id % 10 <> 0"""
_TEXT = "SELECT feature_id, string_agg(t, ';' ORDER BY t) AS g FROM (SELECT feature_id, part, least(string_agg(p, ',' ORDER BY pos), string_agg(p, ',' ORDER BY pos DESC)) AS t FROM (SELECT *, CAST(round(lon, 7) AS VARCHAR) || ' ' || CAST(round(lat, 7) AS VARCHAR) AS p FROM {src}) GROUP BY 1, 2) GROUP BY 1"


@query("detect_geometry_drift", f"""WITH a AS ({_TEXT.format(src='(SELECT * FROM v_vertices WHERE feature_id % 17 <> 0)')}),
  b AS ({_TEXT.format(src='(' + CHANGED.format(v='v_vertices') + ')')})
  SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, CASE WHEN a.g IS NULL THEN 'added' WHEN b.g IS NULL THEN 'removed' WHEN a.g = b.g THEN 'same' ELSE 'changed' END AS state
  FROM a FULL JOIN b ON a.feature_id = b.feature_id""")
def _drift(t: Tables):
    stored = t.vertices().where(F.col("feature_id") % 17 != 0)
    current = t.spark.sql(CHANGED, v=t.vertices())
    # The current snapshot is drawn in the other direction for some features; that is no drift.
    turned = skew.with_group(current, ["feature_id", "part"], {"_n": F.count(F.lit(1))}, width=t.line_width()).withColumn(
        "pos", F.when(F.col("feature_id") % 11 == 0, F.col("_n") - F.col("pos") + 1).otherwise(F.col("pos"))
    )
    return terrain.drift(stored, turned.drop("_n"))


SNAPPED = "SELECT feature_id, part, pos, floor(lon / 3e0) * 3e0 AS lon, floor(lat / 3e0) * 3e0 AS lat FROM {v}"


@query("duplicate_geometry", f"""WITH g AS (SELECT feature_id, string_agg(CAST(part AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':' || CAST(round(lon, 7) AS VARCHAR) || ' ' || CAST(round(lat, 7) AS VARCHAR), ',' ORDER BY part, pos) AS s
    FROM ({SNAPPED.format(v='v_vertices')}) GROUP BY 1)
  SELECT feature_id, min(feature_id) OVER (PARTITION BY s) AS first_id, count(*) OVER (PARTITION BY s) AS copies FROM g QUALIFY count(*) OVER (PARTITION BY s) > 1""")
def _duplicates(t: Tables):
    return terrain.shared_geometry(t.spark.sql(SNAPPED, v=t.vertices()))


@query("allocate_profile_samples", f"""WITH parts AS (
  SELECT relation_id, pos AS part_no, length_km AS km, row_number() OVER (PARTITION BY relation_id ORDER BY length_km DESC NULLS LAST, pos) AS rn
  FROM v_members JOIN v_ways ON way_id = ref WHERE member_type = 'W'
), shared AS (
  SELECT relation_id, part_no, km, {lx.PROFILE_BUDGET} - count(*) OVER r AS spare, sum(coalesce(km, 0)) OVER r AS whole
  FROM parts WHERE rn <= {lx.PROFILE_BUDGET} WINDOW r AS (PARTITION BY relation_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), given AS (
  SELECT *, sum(points) OVER (PARTITION BY relation_id) - {lx.PROFILE_BUDGET} AS surplus
  FROM (SELECT *, 1 + greatest(coalesce(round_even(spare * coalesce(km, 0) / nullif(whole, 0), 0), 0), 0)::BIGINT AS points FROM shared)
), taken AS (
  SELECT relation_id, part_no, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY level DESC, part_no) AS rk FROM (
      SELECT relation_id, part_no, surplus, unnest(range(2, points + 1)) AS level FROM given WHERE surplus > 0)) WHERE rk <= surplus GROUP BY ALL
)
SELECT relation_id, part_no, km, (points - coalesce(n, 0))::BIGINT AS points FROM given LEFT JOIN taken USING (relation_id, part_no)""")
def _allocate(t: Tables):
    """Relations take their member ways as parts."""
    members = t.members().where(F.col("member_type") == "W")
    ways = t.ways().select(F.col("way_id").alias("ref"), F.col("length_km").alias("km"))
    parts = members.join(ways, "ref").select("relation_id", F.col("pos").alias("part_no"), "km")
    return terrain.allocate_samples(parts, ["relation_id"])
