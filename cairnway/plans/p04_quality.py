"""The difficulty dataset: census, samples, audits, metrics, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo
from cairnway.operators import graph, quality, terrain
from cairnway.plans.p03_terrain import rounded
from cairnway.plans.registry import query
from cairnway.session import scratch
from cairnway.sources.tables import Tables
from cairnway.sources.views import ORACLE_ONLY

GRADE_ROWS = "(VALUES " + ", ".join(
    f"('{g}', CAST({i} AS BIGINT), '{lx.GRADE_TIER[g]}', '{lx.TIER_LABEL[lx.GRADE_TIER[g]]}', '{w}')"
    for i, (g, w) in enumerate(zip(lx.GRADES, ["Easy", "Easy", "Moderate", "Hard"] + ["Very Hard"] * 3))
) + ") g(sac_scale, grade_idx, tier, tier_label, word)"
TIER_IDX = "CASE {} WHEN 'walking' THEN 0 WHEN 'mountain' THEN 1 ELSE 2 END"


def graded(t: Tables):
    return t.sample().where(F.col("sac_scale").isNotNull())


ORACLE_ONLY["v_graded"] = "SELECT * FROM v_features WHERE sac_scale IS NOT NULL"


@query("census_by_grade", f"""SELECT g.sac_scale, g.grade_idx, count(way_id) AS ways, {', '.join(f'count(w.{c}) AS {c}' for c in lx.CENSUS_TAGS)},
  count(v.feature_id) AS geometry, {', '.join(f'round(100.0 * count(w.{c}) / nullif(count(way_id), 0), 2) AS {c}_pct' for c in lx.CENSUS_TAGS)}
  FROM {GRADE_ROWS} LEFT JOIN v_ways w ON w.sac_scale = g.sac_scale AND w.way_id > 0
  LEFT JOIN (SELECT DISTINCT feature_id FROM v_points) v ON v.feature_id = w.way_id GROUP BY 1, 2""")
def _census(t: Tables):
    drawn = t.view("v_points").select("feature_id").distinct()
    return quality.census(t.ways(), drawn)


DEFECTS = """SELECT CASE WHEN feature_id % 211 = 0 THEN feature_id + 1 ELSE feature_id END AS feature_id,
  CASE WHEN feature_id % 97 = 0 THEN 'very_hard' ELSE sac_scale END AS sac_scale, CASE WHEN feature_id % 101 = 0 THEN NULL ELSE length_km END AS length_km,
  latitude, CASE WHEN feature_id % 103 = 0 THEN NULL ELSE longitude END AS longitude, grid_x, grid_y FROM {s}"""


@query("validate_way_sample", f"""WITH s AS ({DEFECTS.format(s='v_graded')}), n AS (SELECT feature_id, count(*) AS points FROM v_points GROUP BY 1),
  d AS (SELECT s.*, points FROM s LEFT JOIN n USING (feature_id))
  SELECT 'unknown label' AS rule, count(*) FILTER (sac_scale NOT IN (SELECT sac_scale FROM {GRADE_ROWS})) AS broken FROM d
  UNION ALL SELECT 'missing length', count(*) FILTER (length_km IS NULL) FROM d UNION ALL SELECT 'length not positive', count(*) FILTER (length_km <= 0) FROM d
  UNION ALL SELECT 'missing position', count(*) FILTER (latitude IS NULL OR longitude IS NULL) FROM d UNION ALL SELECT 'missing cell', count(*) FILTER (grid_x IS NULL OR grid_y IS NULL) FROM d
  UNION ALL SELECT 'missing geometry', count(*) FILTER (points IS NULL OR points < 2) FROM d UNION ALL SELECT 'duplicate id', count(feature_id) - count(DISTINCT feature_id) FROM d""")
def _validate(t: Tables):
    rows = t.spark.sql(DEFECTS, s=graded(t))
    points = t.view("v_points").groupBy("feature_id").agg(F.count(F.lit(1)).alias("points"))
    return quality.violations(rows.join(points, "feature_id", "left"))


CELL_DEG, CELL_CAP, CLASS_CAP = 2.5, 8, 150
ORACLE_ONLY["v_celled"] = f"""
SELECT * FROM (SELECT feature_id, sac_scale, tier, CAST(floor(longitude / {CELL_DEG}) AS BIGINT) AS grid_x, CAST(floor(latitude / {CELL_DEG}) AS BIGINT) AS grid_y,
  row_number() OVER (PARTITION BY sac_scale, floor(longitude / {CELL_DEG}), floor(latitude / {CELL_DEG}) ORDER BY md5(CAST(feature_id AS VARCHAR)), feature_id) AS cell_rank
  FROM v_graded) WHERE cell_rank <= {CELL_CAP}"""
ORACLE_ONLY["v_retained"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sac_scale ORDER BY md5(CAST(feature_id AS VARCHAR)), feature_id) AS class_rank FROM v_celled)
WHERE class_rank <= {CLASS_CAP}"""


def capped(t: Tables):
    return quality.cap_per_cell(graded(t), CELL_CAP, CELL_DEG)


def retained(t: Tables):
    return quality.cap_per_class(capped(t), CLASS_CAP)


@query("sample_cap_per_cell", "SELECT feature_id, sac_scale, grid_x, grid_y, cell_rank FROM v_celled")
def _cell_cap(t: Tables):
    return capped(t).select("feature_id", "sac_scale", "grid_x", "grid_y", "cell_rank")


@query("sample_cap_per_class", "SELECT feature_id, sac_scale, class_rank FROM v_retained")
def _class_cap(t: Tables):
    return retained(t).select("feature_id", "sac_scale", "class_rank")


@query("sample_natural_holdout", """SELECT * FROM (SELECT feature_id, grid_x, grid_y, row_number() OVER (PARTITION BY grid_x, grid_y ORDER BY md5(CAST(feature_id AS VARCHAR)), feature_id) AS cell_rank
  FROM v_graded WHERE (grid_x + grid_y) % 7 = 0) WHERE cell_rank <= 20""")
def _holdout(t: Tables):
    rows = graded(t)
    cells = rows.where((F.col("grid_x") + F.col("grid_y")) % 7 == 0).select("grid_x", "grid_y")
    return quality.natural_holdout(rows, cells, 20).select("feature_id", "grid_x", "grid_y", "cell_rank")


TAGS7 = ["highway", "surface", "smoothness", "tracktype", "trail_visibility", "incline_direction", "assisted_trail"]
_NUM = "TRY_CAST(nullif(regexp_extract({}, '[-+]?\\d+(?:\\.\\d+)?'), '') AS DOUBLE)"


def _mid(col: str) -> str:
    body = f"trim(regexp_replace(lower(trim({col})), '(mm|cm|ft|in|m|°)\\s*$', ''))"
    a = _NUM.format(f"regexp_extract({body}, '^(.*?)\\s*[-–]\\s*(.*)$', 1)")
    b = _NUM.format(f"regexp_extract({body}, '^(.*?)\\s*[-–]\\s*(.*)$', 2)")
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({a} + {b}) / 2 ELSE {_NUM.format(body)} END"


ORACLE_ONLY["v_tags"] = f"""
SELECT feature_id, coalesce(nullif(lower(trim(highway)), ''), '<MISSING>') AS highway, coalesce(nullif(lower(trim(surface)), ''), '<MISSING>') AS surface,
  coalesce(lower(trim(smoothness)), '<MISSING>') AS smoothness, coalesce(lower(trim(tracktype)), '<MISSING>') AS tracktype,
  CASE lower(trim(trail_visibility)) WHEN 'intermdiate' THEN 'intermediate' ELSE coalesce(lower(trim(trail_visibility)), '<MISSING>') END AS trail_visibility,
  CASE WHEN incline IS NULL THEN '<MISSING>' WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down' WHEN pct IS NOT NULL THEN 'flat'
    WHEN incline IN ('up', 'down', 'steep') THEN incline ELSE 'unknown' END AS incline_direction,
  CASE lower(trim(assisted_trail)) WHEN 'ropes' THEN 'rope' ELSE coalesce(lower(trim(assisted_trail)), '<MISSING>') END AS assisted_trail,
  pct AS incline_pct, w AS width_m, incline AS raw_incline, width AS raw_width, sac_scale, tier, length_km, latitude, longitude, grid_x, grid_y
FROM (SELECT *, CASE WHEN incline LIKE '%°' THEN tan(n / 180 * pi()) * 100 ELSE n END AS pct,
   CASE WHEN width LIKE '%mm' THEN m / 1000 WHEN width LIKE '%cm' THEN m / 100 WHEN width LIKE '%ft' THEN m * 0.3048 WHEN width LIKE '%in' THEN m * 0.0254 ELSE m END AS w
  FROM (SELECT *, {_mid('incline')} AS n, {_mid('width')} AS m FROM v_features))"""


def tags(t: Tables):
    return quality.normalise_tags(t.sample())


@query("normalise_tags", f"""SELECT feature_id, {', '.join(TAGS7)}, round(incline_pct, 6) AS incline_pct, round(width_m, 6) AS width_m,
  CASE WHEN incline_pct IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS incline_numeric_missing, CASE WHEN width_m IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS width_missing FROM v_tags""")
def _tags(t: Tables):
    return rounded(tags(t), "incline_pct", "width_m")


@query("normalise_tags_rejects", """SELECT 'incline' AS tag, count(raw_incline) AS given, count(incline_pct) AS read, count(raw_incline) - count(incline_pct) AS rejected FROM v_tags
  UNION ALL SELECT 'width', count(raw_width), count(width_m), count(raw_width) - count(width_m) FROM v_tags""")
def _rejects(t: Tables):
    return quality.unreadable(t.sample(), tags(t))


ORACLE_ONLY["v_derived"] = """
SELECT feature_id, ln(len) AS log_length, elevation_gain_m / len AS gain_per_km, elevation_loss_m / nullif(elevation_gain_m + elevation_loss_m, 0) AS descent_ratio,
  pow(max_slope_pct, 2) / 100 AS steepness_squared, elevation_range_m / len AS relief_per_km, CASE WHEN elevation_range_m IS NULL THEN len ELSE 0 END AS length_x_no_terrain
FROM (SELECT f.feature_id, CASE WHEN length_km > 0 THEN length_km ELSE 0.05 END AS len, t.* EXCLUDE (feature_id) FROM v_features f LEFT JOIN v_terrain t ON t.feature_id = f.feature_id)"""


def with_terrain(t: Tables):
    rough = terrain.model_terrain(terrain.profile(t.vertices(), t.line_width()), t.line_width())
    return t.sample().join(rough, "feature_id", "left").na.fill(0.0, ["terrain_available"])


@query("derive_features", "SELECT feature_id, " + ", ".join(f"round({c}, 3)::DOUBLE AS {c}" for c in lx.DERIVED) + " FROM v_derived")
def _derive(t: Tables):
    return rounded(quality.derive(with_terrain(t)).select("feature_id", *lx.DERIVED), *lx.DERIVED, digits=3)


@query("grade_to_tier", f"SELECT way_id, w.sac_scale, g.tier, g.tier_label, g.word FROM v_ways w LEFT JOIN {GRADE_ROWS} ON g.sac_scale = w.sac_scale WHERE way_id > 0")
def _tier(t: Tables):
    known = F.broadcast(quality.grades_table(t.ways()).drop("grade_idx"))
    return t.ways().select("way_id", "sac_scale").join(known, "sac_scale", "left")


NUMBERS = ["length_km", "latitude", "longitude", "incline_pct", "width_m"]


def with_tags(t: Tables):
    return tags(t).join(t.sample().drop(*lx.CENSUS_TAGS), "feature_id")


@query("numeric_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS present, round(min({c}), 6)::DOUBLE AS least, round(max({c}), 6)::DOUBLE AS most, round(avg({c}), 6) AS mean FROM v_tags"
    for c in NUMBERS))
def _numeric(t: Tables):
    return rounded(quality.numeric_audit(with_tags(t), NUMBERS), "least", "most", "mean")


@query("categorical_audit", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS n FROM v_tags GROUP BY {c}" for c in TAGS7))
def _categorical(t: Tables):
    return quality.categorical_audit(tags(t), TAGS7)


@query("class_distribution", f"""SELECT 'grade' AS level, g.sac_scale AS label, count(f.feature_id) AS n FROM {GRADE_ROWS} LEFT JOIN v_graded f ON f.sac_scale = g.sac_scale GROUP BY 2
  UNION ALL SELECT 'tier', g.tier, count(f.feature_id) FROM {GRADE_ROWS} LEFT JOIN v_graded f ON f.sac_scale = g.sac_scale GROUP BY 2
  UNION ALL SELECT 'all', 'rows', count(*) FROM v_graded UNION ALL SELECT 'all', 'ids', count(DISTINCT feature_id) FROM v_graded
  UNION ALL SELECT 'all', 'cells', count(*) FROM (SELECT DISTINCT grid_x, grid_y FROM v_graded)""")
def _distribution(t: Tables):
    return quality.class_distribution(graded(t))


@query("natural_prior", "SELECT tier, round(count(*) / (SELECT count(*) FROM v_graded), 9) AS share FROM v_graded GROUP BY tier")
def _prior(t: Tables):
    return rounded(quality.natural_prior(graded(t)), "share", digits=9)


@query("row_weights", """SELECT r.feature_id, r.tier, round(pow(greatest(p.share / k.share, 1e-3), 0.5), 6) AS weight FROM v_retained r
  JOIN (SELECT tier, count(*) / (SELECT count(*) FROM v_graded) AS share FROM v_graded GROUP BY 1) p USING (tier)
  JOIN (SELECT tier, count(*) / (SELECT count(*) FROM v_retained) AS share FROM v_retained GROUP BY 1) k USING (tier)""")
def _weights(t: Tables):
    weighted = quality.row_weights(retained(t), quality.natural_prior(graded(t)), 0.5)
    return rounded(weighted.select("feature_id", "tier", "weight"), "weight")


@query("unknown_labels", f"SELECT DISTINCT sac_scale FROM ({DEFECTS.format(s='v_graded')}) WHERE sac_scale NOT IN (SELECT sac_scale FROM {GRADE_ROWS})")
def _unknown(t: Tables):
    return quality.label_sets(t.spark.sql(DEFECTS, s=graded(t)))[0]


@query("missing_labels", f"SELECT sac_scale FROM {GRADE_ROWS} WHERE sac_scale NOT IN (SELECT sac_scale FROM v_retained WHERE grid_x % 2 = 0 AND tier = 'walking')")
def _missing(t: Tables):
    some = retained(t).where((F.col("grid_x") % 2 == 0) & (F.col("tier") == "walking"))
    return quality.label_sets(some)[1]


@query("split_overlap", "SELECT grid_x, grid_y FROM v_graded WHERE feature_id % 5 = 0 INTERSECT SELECT grid_x, grid_y FROM v_graded WHERE feature_id % 5 <> 0")
def _overlap(t: Tables):
    """Cells on both sides of a row-wise split; a split by whole groups leaves none."""
    cells = graded(t)
    test = cells.where(F.col("feature_id") % 5 == 0).select("grid_x", "grid_y")
    return test.intersect(cells.where(F.col("feature_id") % 5 != 0).select("grid_x", "grid_y"))


@query("join_features_to_ways", """SELECT coalesce(f.feature_id, w.way_id) AS feature_id, CASE WHEN w.way_id IS NULL THEN 'no way' WHEN f.feature_id IS NULL THEN 'no features' ELSE 'matched' END AS state,
  w.length_km FROM (SELECT DISTINCT feature_id FROM v_points) f FULL JOIN (SELECT way_id, length_km FROM v_ways WHERE way_id > 0) w ON f.feature_id = w.way_id""")
def _one_to_one(t: Tables):
    features = t.view("v_points").select("feature_id").distinct().withColumn("_f", F.lit(True))
    ways = t.ways().select(F.col("way_id").alias("feature_id"), "length_km").withColumn("_w", F.lit(True))
    return features.join(ways, "feature_id", "full_outer").select(
        "feature_id",
        F.when(F.col("_w").isNull(), "no way").when(F.col("_f").isNull(), "no features").otherwise("matched").alias("state"),
        "length_km",
    )


@query("nearest_train_distance", """SELECT feature_id, round(km, 5) AS km FROM (SELECT a.feature_id, min(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2)
  + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))) AS km
  FROM (SELECT * FROM v_graded WHERE feature_id % 5 = 0) a, (SELECT DISTINCT latitude, longitude FROM v_graded WHERE feature_id % 5 <> 0) b GROUP BY 1)""")
def _nearest(t: Tables):
    rows = graded(t).select("feature_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    test, train = rows.where(F.col("feature_id") % 5 == 0), rows.where(F.col("feature_id") % 5 != 0)
    return rounded(quality.nearest_km(test, train), "km", digits=5)


SCORED = """SELECT vec_id, CASE label % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'mountain' ELSE 'alpine' END AS label,
  CASE WHEN e1 >= e2 AND e1 >= e3 THEN 'walking' WHEN e2 >= e3 THEN 'mountain' ELSE 'alpine' END AS prediction,
  CASE label % 3 WHEN 0 THEN 0.57e0 WHEN 1 THEN 0.31e0 ELSE 0.12e0 END AS weight FROM {e}"""
ORACLE_ONLY["v_scored"] = SCORED.replace("{e}", "(SELECT vec_id, label, embedding[1] AS e1, embedding[2] AS e2, embedding[3] AS e3 FROM embeddings)")
METRICS = """
SELECT {name}, c.tier, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(actual, 0), 0) AS r, coalesce(2 * hit / nullif(said + actual, 0), 0) AS f, hit, actual
FROM (VALUES ('walking'), ('mountain'), ('alpine')) c(tier) LEFT JOIN LATERAL (
  SELECT sum(CASE WHEN label = c.tier AND {pred} = c.tier THEN weight ELSE 0 END) AS hit, sum(CASE WHEN {pred} = c.tier THEN weight ELSE 0 END) AS said,
    sum(CASE WHEN label = c.tier THEN weight ELSE 0 END) AS actual FROM v_scored) x ON true"""
ORACLE_ONLY["v_per_class"] = METRICS.format(name="'model' AS who", pred="prediction")
ORACLE_ONLY["v_per_class_base"] = METRICS.format(name="'base' AS who", pred="'walking'")


def scored(t: Tables):
    e = t.raw("embeddings").select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i + 1}") for i in range(3)])
    return t.spark.sql(SCORED, e=e)


@query("weighted_metrics", """SELECT metric, tier, round(value, 9) AS value FROM (
  SELECT 'precision' AS metric, tier, p AS value FROM v_per_class UNION ALL SELECT 'recall', tier, r FROM v_per_class UNION ALL SELECT 'f1', tier, f FROM v_per_class
  UNION ALL SELECT 'accuracy', 'all', sum(hit) / sum(actual) FROM v_per_class UNION ALL SELECT 'macro_f1', 'all', avg(f) FROM v_per_class
  UNION ALL SELECT 'balanced_accuracy', 'all', avg(r) FROM v_per_class)""")
def _metrics(t: Tables):
    return rounded(quality.weighted_metrics(scored(t)), "value", digits=9)


@query("usefulness_gate", """SELECT a.metric, round(a.v, 9) AS model, round(b.v, 9) AS baseline, a.v > b.v AS beats FROM
  (SELECT unnest(['accuracy', 'macro_f1', 'balanced_accuracy']) AS metric, unnest([sum(hit) / sum(actual), avg(f), avg(r)]) AS v FROM v_per_class) a JOIN
  (SELECT unnest(['accuracy', 'macro_f1', 'balanced_accuracy']) AS metric, unnest([sum(hit) / sum(actual), avg(f), avg(r)]) AS v FROM v_per_class_base) b USING (metric)""")
def _gate(t: Tables):
    rows = scored(t)
    base = quality.weighted_metrics(rows.withColumn("prediction", F.lit("walking")))
    return rounded(quality.gate(quality.weighted_metrics(rows), base), "model", "baseline", digits=9)


@query("tag_collision", f"""WITH g AS (SELECT {', '.join(TAGS7)}, sac_scale, count(*) AS n FROM v_tags WHERE sac_scale IS NOT NULL GROUP BY ALL),
  c AS (SELECT {', '.join(TAGS7)}, sum(n) AS ways, count(*) AS grades, max(n) AS top FROM g GROUP BY ALL)
  SELECT count(*) AS combinations, CAST(sum(ways) AS BIGINT) AS ways, count(*) FILTER (grades > 1) AS ambiguous, CAST(coalesce(sum(ways) FILTER (grades > 1), 0) AS BIGINT) AS ways_in_ambiguous,
  CAST(max(ways) FILTER (grades > 1) AS BIGINT) AS largest_ambiguous, round(sum(top) / sum(ways), 9) AS majority_share FROM c""")
def _collision(t: Tables):
    rows = with_tags(t).where(F.col("sac_scale").isNotNull())
    return rounded(quality.tag_collision(rows, TAGS7), "majority_share", digits=9)


@query("tag_majority_lookup", f"""WITH c AS (SELECT {', '.join(TAGS7)}, tier, count(*) AS n FROM v_tags WHERE sac_scale IS NOT NULL AND feature_id % 5 <> 0 GROUP BY ALL),
  b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {', '.join(TAGS7)} ORDER BY n DESC, {TIER_IDX.format('tier')}) = 1)
  SELECT t.feature_id, t.tier, b.tier AS looked_up FROM v_tags t LEFT JOIN b USING ({', '.join(TAGS7)}) WHERE t.sac_scale IS NOT NULL AND t.feature_id % 5 = 0""")
def _lookup(t: Tables):
    rows = with_tags(t).where(F.col("sac_scale").isNotNull())
    train, test = rows.where(F.col("feature_id") % 5 != 0), rows.where(F.col("feature_id") % 5 == 0)
    return quality.majority_lookup(train, test, TAGS7).select("feature_id", "tier", "looked_up")


@query("feature_auc", """WITH r AS (SELECT *, avg(rn) OVER (PARTITION BY highway, length_km) AS rk FROM (SELECT highway, length_km, tier = 'alpine' AS pos, row_number() OVER (PARTITION BY highway ORDER BY length_km) AS rn
    FROM v_tags WHERE sac_scale IS NOT NULL))
  SELECT highway, count(*) FILTER (pos) AS positives, count(*) FILTER (NOT pos) AS negatives,
    round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auc FROM r GROUP BY 1""")
def _auc(t: Tables):
    rows = with_tags(t).where(F.col("sac_scale").isNotNull())
    return rounded(quality.auc(rows, ["highway"], "length_km", F.col("tier") == "alpine"), "auc", digits=9)


AGREE = {"range": ("elevation_range_m", "range_m"), "gain": ("elevation_gain_m", "gain_m"),
         "mean_slope": ("average_slope_pct", "average_slope_pct"), "max_slope": ("max_slope_pct", "max_slope_pct")}


@query("source_agreement", " UNION ALL ".join(
    f"SELECT '{q}' AS quantity, count(*) FILTER (a.{a} IS NOT NULL AND b.{b} IS NOT NULL) AS n, round(corr(a.{a}, b.{b}), 6) AS r FROM v_terrain a JOIN v_display b USING (feature_id)"
    for q, (a, b) in AGREE.items()))
def _agreement(t: Tables):
    width = t.line_width()
    profiled = terrain.profile(t.vertices(), width)
    a = terrain.model_terrain(profiled, width).select("feature_id", *[F.col(x).alias(f"a_{q}") for q, (x, _) in AGREE.items()])
    b = terrain.display_terrain(profiled, width).select("feature_id", *[F.col(y).alias(f"b_{q}") for q, (_, y) in AGREE.items()])
    return rounded(quality.agreement(a.join(b, "feature_id"), list(AGREE)), "r")


@query("dedupe_first_seen", "SELECT feature_id, min(place_id) AS first_place FROM v_pairs GROUP BY 1")
def _first_seen(t: Tables):
    from cairnway.plans.p02_boxes import box_reach

    # A search goes by the least of its places.
    return box_reach(t).groupBy("feature_id").agg(F.min("box_id").alias("first_place"))


GRID = "CAST(floor(longitude * 50e0) AS BIGINT) AS grid_x, CAST(floor(latitude * 50e0) AS BIGINT) AS grid_y"
ORACLE_ONLY["v_ends"] = """
SELECT feature_id, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY part, pos) AS a, row_number() OVER (PARTITION BY feature_id ORDER BY part DESC, pos DESC) AS z
  FROM v_vertices) WHERE a = 1 OR z = 1"""
ORACLE_ONLY["v_celled_ways"] = f"SELECT way_id AS feature_id, CAST(gx AS VARCHAR) || ':' || CAST(gy AS VARCHAR) AS cell FROM (SELECT way_id, {GRID.replace('grid_x', 'gx').replace('grid_y', 'gy')} FROM v_ways WHERE way_id > 0)"


def fine_cells(t: Tables):
    return t.ways().select(
        F.col("way_id").alias("feature_id"),
        F.floor(F.col("longitude") * 50.0).alias("grid_x"),
        F.floor(F.col("latitude") * 50.0).alias("grid_y"),
    )


@query("connected_components", """WITH RECURSIVE n AS (SELECT DISTINCT c.cell, round(e.lon, 6) AS x, round(e.lat, 6) AS y FROM v_ends e JOIN v_celled_ways c USING (feature_id)),
  edges AS (SELECT DISTINCT a.cell AS a, b.cell AS b FROM n a JOIN n b USING (x, y) WHERE a.cell <> b.cell),
  reach AS (SELECT DISTINCT cell AS a, cell AS b FROM v_celled_ways UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
  SELECT w.feature_id, w.cell, m.g AS split_group FROM v_celled_ways w JOIN (SELECT a, min(b) AS g FROM reach GROUP BY 1) m ON m.a = w.cell""")
def _components(t: Tables):
    return graph.cell_groups(fine_cells(t), graph.line_ends(t.vertices()))


@query("cluster_cells", """WITH RECURSIVE c AS (SELECT DISTINCT grid_x, grid_y FROM v_graded WHERE (grid_x + grid_y) % 7 <= 1),
  reach AS (SELECT grid_x AS ax, grid_y AS ay, grid_x AS bx, grid_y AS b_y FROM c UNION SELECT r.ax, r.ay, c.grid_x, c.grid_y FROM reach r JOIN c ON abs(c.grid_x - r.bx) + abs(c.grid_y - r.b_y) = 1),
  l AS (SELECT ax, ay, min(bx * 1000 + b_y) AS g FROM reach GROUP BY 1, 2)
  SELECT CAST(floor(g / 1000) AS BIGINT) AS seed_x, CAST(g % 1000 AS BIGINT) AS seed_y, count(*) AS cells, min(ax)::DOUBLE AS west, min(ay)::DOUBLE AS south, (max(ax) + 1)::DOUBLE AS east, (max(ay) + 1)::DOUBLE AS north
  FROM l GROUP BY g ORDER BY count(*) DESC, g LIMIT 6""")
def _clusters(t: Tables):
    cells = graded(t).where((F.col("grid_x") + F.col("grid_y")) % 7 <= 1)
    return graph.cell_clusters(cells)


@query("grouped_stratified_split", """WITH c AS (SELECT cell, tier, count(*) AS n FROM (SELECT CAST(grid_x AS VARCHAR) || ':' || CAST(grid_y AS VARCHAR) AS cell, tier FROM v_graded) GROUP BY 1, 2),
  s AS (SELECT cell, CAST(sum(n) AS BIGINT) AS size, arg_max(tier, n * 10 + CASE tier WHEN 'walking' THEN 2 WHEN 'mountain' THEN 1 ELSE 0 END) AS lead FROM c GROUP BY 1),
  o AS (SELECT *, (row_number() OVER (PARTITION BY lead ORDER BY size DESC, cell) - 1) % 10 AS k FROM s)
  SELECT cell, lead, size, CAST(CASE WHEN k < 5 THEN k ELSE 9 - k END AS BIGINT) AS fold FROM o""")
def _folds(t: Tables):
    rows = graded(t).select("tier", F.concat_ws(":", "grid_x", "grid_y").alias("cell"))
    return quality.grouped_folds(rows, "cell")


@query("write_audit_report")
def _report(t: Tables):
    """One JSON document of counts and parameters, written and read back."""
    rows = graded(t)
    summary = quality.class_distribution(rows).agg(
        F.array_sort(F.collect_list(F.struct("level", "label", "n"))).alias("counts")
    )
    document = summary.select(
        F.to_json(
            F.struct(
                "counts",
                F.struct(
                    F.lit(CELL_DEG).alias("cell_deg"), F.lit(CELL_CAP).alias("per_cell"),
                    F.lit(CLASS_CAP).alias("per_grade"),
                ).alias("parameters"),
            )
        ).alias("value")
    )
    path = scratch(t.spark, "report")
    document.write.text(path)
    return t.spark.read.text(path).select(F.col("value").alias("report"))
