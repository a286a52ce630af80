"""The difficulty dataset: sampling, features, audits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo, measures
from cairnway.session import cut


def grades_table(df: DataFrame) -> DataFrame:
    """Seven rows: the recorded grades in order, their tier and words."""
    # The display word of each grade.
    shown = ["Easy", "Easy", "Moderate", "Hard", "Very Hard", "Very Hard", "Very Hard"]
    rows = [
        (grade, i, lx.GRADE_TIER[grade], lx.TIER_LABEL[lx.GRADE_TIER[grade]], word)
        for i, (grade, word) in enumerate(zip(lx.GRADES, shown))
    ]
    return df.sparkSession.createDataFrame(
        rows, "sac_scale string, grade_idx long, tier string, tier_label string, word string"
    )


def census(ways: DataFrame, with_line: DataFrame) -> DataFrame:
    """Per grade: ways, ways carrying each tag and a line, and their share. Zeros included."""
    lined = ways.join(
        with_line.select(F.col("feature_id").alias("way_id"), F.lit(True).alias("drawn")),
        "way_id", "left",
    )
    counts = lined.groupBy("sac_scale").agg(
        F.count(F.lit(1)).alias("ways"),
        *[F.count(tag).alias(tag) for tag in lx.CENSUS_TAGS],
        F.count("drawn").alias("geometry"),
    )
    known = F.broadcast(grades_table(ways).select("sac_scale", "grade_idx"))
    full = counts.join(known, "sac_scale", "right").na.fill(0)
    return full.select(
        "sac_scale", "grade_idx", "ways", *lx.CENSUS_TAGS, "geometry",
        *[
            F.round(100.0 * F.col(tag) / F.nullif(F.col("ways"), F.lit(0)), 2).alias(f"{tag}_pct")
            for tag in lx.CENSUS_TAGS
        ],
    )


def violations(rows: DataFrame) -> DataFrame:
    """One row per rule with the rows that break it; a clean table has zeros only."""
    c = F.col
    checks = {
        "unknown label": ~c("sac_scale").isin(lx.GRADES),
        "missing length": c("length_km").isNull(),
        "length not positive": c("length_km") <= 0,
        "missing position": c("latitude").isNull() | c("longitude").isNull(),
        "missing cell": c("grid_x").isNull() | c("grid_y").isNull(),
        "missing geometry": c("points").isNull() | (c("points") < 2),
    }
    found = rows.agg(
        *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in checks.items()],
        (F.count("feature_id") - F.count_distinct("feature_id")).alias("duplicate id"),
    )
    names = [*checks, "duplicate id"]
    return found.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("broken")) for n in names])
        )
    )


def require_clean(found: DataFrame) -> None:
    """Fail the job when any rule is broken."""
    bad = [f"{r['rule']}: {r['broken']}" for r in found.where("broken > 0").collect()]
    if bad:
        raise ValueError("dataset is not valid: " + "; ".join(bad))


def by_hash(column: str = "feature_id") -> list[Column]:
    """A fixed pseudo-random order: the digest of the id, then the id."""
    return [F.md5(F.col(column).cast("string")), F.col(column)]


def cap_per_cell(rows: DataFrame, cap: int, cell_deg: float) -> DataFrame:
    """At most ``cap`` rows per grade and cell, in digest order."""
    celled = rows.withColumns(
        {
            "grid_x": geo.cell(F.col("longitude"), cell_deg),
            "grid_y": geo.cell(F.col("latitude"), cell_deg),
        }
    )
    return skew.top_per_group(celled, ["sac_scale", "grid_x", "grid_y"], by_hash(), cap, "cell_rank")


def cap_per_class(rows: DataFrame, cap: int) -> DataFrame:
    return skew.top_per_group(rows, ["sac_scale"], by_hash(), cap, "class_rank")


def natural_holdout(rows: DataFrame, cells: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows of each listed cell, whatever their grade."""
    listed = rows.join(cells.select("grid_x", "grid_y").distinct(), ["grid_x", "grid_y"], "left_semi")
    return skew.top_per_group(listed, ["grid_x", "grid_y"], by_hash(), cap, "cell_rank")


def normalise_tags(ways: DataFrame) -> DataFrame:
    """Clean category levels and measured numbers of every way, with missing flags."""
    read = measures.with_number(ways, "incline", "_incline", "_incline_unit")
    read = measures.with_number(read, "width", "_width", "_width_unit")
    read = read.withColumns(
        {
            "incline_pct": measures.incline_pct(F.col("_incline"), F.col("_incline_unit")),
            "width_m": measures.width_m(F.col("_width"), F.col("_width_unit")),
        }
    )
    plain = {
        c: measures.plain_level(F.col(c)) for c in ("highway", "surface", "smoothness", "tracktype")
    }
    levels = {
        "incline_direction": measures.incline_level(F.col("incline"), F.col("incline_pct")),
        "trail_visibility": measures.visibility_level(F.col("trail_visibility")),
        "assisted_trail": measures.assisted_level(F.col("assisted_trail")),
    }
    return read.select(
        "feature_id",
        *[v.alias(k) for k, v in {**plain, **levels}.items()],
        "incline_pct",
        "width_m",
        F.when(F.col("incline_pct").isNull(), 1.0).otherwise(0.0).alias("incline_numeric_missing"),
        F.when(F.col("width_m").isNull(), 1.0).otherwise(0.0).alias("width_missing"),
    )


def unreadable(ways: DataFrame, normal: DataFrame) -> DataFrame:
    """Per measured tag: given, read, and given but not a number."""
    both = ways.select("feature_id", "incline", "width").join(normal, "feature_id")
    parts = [
        F.struct(
            F.lit(tag).alias("tag"),
            F.count(tag).alias("given"),
            F.count(number).alias("read"),
            (F.count(tag) - F.count(number)).alias("rejected"),
        )
        for tag, number in (("incline", "incline_pct"), ("width", "width_m"))
    ]
    return both.agg(F.array(*parts).alias("t")).select(F.inline("t"))


def derive(rows: DataFrame) -> DataFrame:
    """Derived predictors; an absent measurement stays absent."""
    c = F.col
    length = F.when(F.coalesce(c("length_km"), F.lit(0.0)) > 0, c("length_km")).otherwise(
        F.greatest(F.coalesce(c("length_km"), F.lit(0.0)), F.lit(0.05))
    )
    known = F.coalesce(c("terrain_available"), F.lit(0.0))
    climb = F.coalesce(c("elevation_gain_m"), F.lit(0.0)) + F.coalesce(
        c("elevation_loss_m"), F.lit(0.0)
    )
    return rows.withColumns(
        {
            "log_length": F.ln(length),
            "gain_per_km": c("elevation_gain_m") / length,
            "descent_ratio": c("elevation_loss_m") / F.nullif(climb, F.lit(0.0)),
            "steepness_squared": c("max_slope_pct") * c("max_slope_pct") / 100.0,
            "relief_per_km": c("elevation_range_m") / length,
            "length_x_no_terrain": length * (1.0 - known),
        }
    )


def numeric_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, present, least, greatest and mean of each column, from one pass."""
    one = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    (F.count(F.lit(1)) - F.count(c)).alias("missing"),
                    F.count(c).alias("present"),
                    F.min(c).cast("double").alias("least"),
                    F.max(c).cast("double").alias("most"),
                    F.avg(c).alias("mean"),
                )
                for c in columns
            ]
        ).alias("a")
    )
    return one.select(F.inline("a"))


def categorical_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.unpivot([], columns, "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(rows: DataFrame) -> DataFrame:
    """Rows per tier and grade with zeros, the total, and how many ids and cells there are."""
    known = grades_table(rows).select("tier", "sac_scale")
    counts = rows.groupBy("tier", "sac_scale").agg(F.count(F.lit(1)).alias("n"))
    graded = F.broadcast(known).join(counts, ["tier", "sac_scale"], "left").na.fill(0, ["n"])
    rolled = graded.rollup("tier", "sac_scale").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("g")
    )
    levels = rolled.select(
        F.when(F.col("g") == 0, "grade").when(F.col("g") == 1, "tier").otherwise("all").alias("level"),
        F.coalesce("sac_scale", "tier", F.lit("rows")).alias("label"),
        "n",
    )
    distinct = rows.agg(
        F.count_distinct("feature_id").alias("ids"),
        F.count_distinct("grid_x", "grid_y").alias("cells"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("all").alias("level"), F.lit("ids").alias("label"), F.col("ids").alias("n")),
                F.struct(F.lit("all").alias("level"), F.lit("cells").alias("label"), F.col("cells").alias("n")),
            )
        )
    )
    return levels.unionByName(distinct)


def natural_prior(graded: DataFrame) -> DataFrame:
    """Share of each tier among all graded ways."""
    counts = graded.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("tier", (F.col("n") / F.col("all")).alias("share"))


def row_weights(rows: DataFrame, prior: DataFrame, strength: float) -> DataFrame:
    """(natural share / retained share) ** strength for every row; a table of three tiers joins."""
    if strength <= 0:
        return rows.withColumn("weight", F.lit(1.0))
    retained = natural_prior(rows).withColumnRenamed("share", "kept")
    # Three rows, written once: training reads the weighted rows many times.
    per_tier = cut(retained.join(prior, "tier", "left").select(
        "tier",
        F.pow(
            F.greatest(F.coalesce("share", F.lit(0.0)) / F.col("kept"), F.lit(1e-3)), F.lit(strength)
        ).alias("weight"),
    ))
    return rows.join(F.broadcast(per_tier), "tier")


def label_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unknown, missing): labels seen but not expected, and expected but not seen."""
    seen = rows.where(F.col("sac_scale").isNotNull()).select("sac_scale").distinct()
    expected = grades_table(rows).select("sac_scale")
    return seen.join(expected, "sac_scale", "left_anti"), expected.join(seen, "sac_scale", "left_anti")


def weighted_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and per-class figures from weighted counts.

    ``scored`` has label, prediction and weight. The only shuffle carries one row per
    (label, prediction) pair.
    """
    # Written once, since the rows below it are scored anew for every reader.
    cells = cut(scored.groupBy("label", "prediction").agg(
        F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")
    ))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("tier"), F.col("w").alias("actual"), F.lit(0.0).alias("said"),
                         F.when(F.col("label") == F.col("prediction"), F.col("w")).otherwise(0.0).alias("hit"),
                         F.col("n").alias("rows")),
                F.struct(F.col("prediction").alias("tier"), F.lit(0.0).alias("actual"), F.col("w").alias("said"),
                         F.lit(0.0).alias("hit"), F.lit(0).cast("long").alias("rows")),
            )
        )
    ).groupBy("tier").agg(*[F.sum(c).alias(c) for c in ("actual", "said", "hit", "rows")])
    known = scored.sparkSession.createDataFrame([(t,) for t in lx.TIERS], "tier string")
    zero = F.lit(0.0)
    per = F.broadcast(known).join(sides, "tier", "left").na.fill(0.0).select(
        "tier", "actual", "said", "hit",
        F.coalesce(F.col("hit") / F.nullif("said", zero), zero).alias("precision"),
        F.coalesce(F.col("hit") / F.nullif("actual", zero), zero).alias("recall"),
        F.coalesce(2 * F.col("hit") / F.nullif(F.col("said") + F.col("actual"), zero), zero).alias("f1"),
    )
    overall = per.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("actual") > 0, F.col("recall"))).alias("balanced_accuracy"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit("all").alias("tier"), F.col(m).alias("value"))
        for m in ("accuracy", "macro_f1", "balanced_accuracy")
    ])))
    each = per.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col("tier"), F.col(m).alias("value"))
        for m in ("precision", "recall", "f1")
    ])))
    return overall.unionByName(each)


def gate(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per metric: the model's value, the majority baseline's, and whether it is beaten."""
    all_model = model.where(F.col("tier") == "all").select("metric", F.col("value").alias("model"))
    all_base = baseline.where(F.col("tier") == "all").select("metric", F.col("value").alias("baseline"))
    return all_model.join(all_base, "metric").withColumn("beats", F.col("model") > F.col("baseline"))


def tag_collision(rows: DataFrame, tags: list[str]) -> DataFrame:
    """Do complete tag combinations determine the grade? One summary row."""
    by_grade = rows.groupBy(*tags, "sac_scale").agg(F.count(F.lit(1)).alias("n"))
    combos = by_grade.groupBy(*tags).agg(
        F.sum("n").alias("ways"), F.count(F.lit(1)).alias("grades"), F.max("n").alias("top")
    )
    several = F.col("grades") > 1
    return combos.agg(
        F.count(F.lit(1)).alias("combinations"),
        F.sum("ways").alias("ways"),
        F.count_if(several).alias("ambiguous"),
        F.sum(F.when(several, F.col("ways")).otherwise(0)).alias("ways_in_ambiguous"),
        F.max(F.when(several, F.col("ways"))).alias("largest_ambiguous"),
        (F.sum("top") / F.sum("ways")).alias("majority_share"),
    )


def majority_lookup(train: DataFrame, test: DataFrame, tags: list[str]) -> DataFrame:
    """The tier most training ways with the same tags have; NULL for unseen combinations."""
    counts = train.groupBy(*tags, "tier").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("n"), -F.array_position(F.array(*map(F.lit, lx.TIERS)), F.col("tier")))
    best = counts.groupBy(*tags).agg(F.max_by("tier", order).alias("looked_up"))
    return test.join(best, tags, "left")


def auc(rows: DataFrame, group: list[str], value: str, positive: Column) -> DataFrame:
    """Rank-sum AUC of one value within each group.

    Rows are first reduced to one per distinct value, so ties cost nothing and the running
    count goes over values, not rows.
    """
    per_value = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count_if(positive).cast("double").alias("pos"),
        F.count_if(~positive).cast("double").alias("neg"),
    )
    ordered = skew.position(per_value, group, [F.col(value)], "_at")
    summed = skew.running_total(ordered, group, "_at", "neg", "_upto")
    wins = F.col("pos") * (F.col("_upto") - F.col("neg") / 2)
    return summed.groupBy(*group).agg(
        F.sum("pos").cast("long").alias("positives"),
        F.sum("neg").cast("long").alias("negatives"),
        (F.sum(wins) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"),
    )


def agreement(pairs: DataFrame, quantities: list[str]) -> DataFrame:
    """Correlation of two sources per quantity: columns ``a_x`` and ``b_x``."""
    return pairs.agg(
        F.array(
            *[
                F.struct(
                    F.lit(q).alias("quantity"),
                    F.count_if(F.col(f"a_{q}").isNotNull() & F.col(f"b_{q}").isNotNull()).alias("n"),
                    F.corr(f"a_{q}", f"b_{q}").alias("r"),
                )
                for q in quantities
            ]
        ).alias("x")
    ).select(F.inline("x"))


def grouped_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups dealt to folds back and forth, largest first, per leading tier.

    Dealing within the tier a group mostly holds keeps the tier shares of the folds close.
    """
    counts = rows.groupBy(group, "tier").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("n"), F.col("tier"))
    sized = counts.groupBy(group).agg(F.sum("n").alias("size"), F.max_by("tier", order).alias("lead"))
    dealt = skew.position(sized, ["lead"], [F.col("size").desc(), F.col(group)], "_turn")
    turn = (F.col("_turn") - 1) % (2 * folds)
    return dealt.select(
        group, "lead", "size",
        F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("long").alias("fold"),
    )


def nearest_km(test: DataFrame, train: DataFrame) -> DataFrame:
    """Great-circle distance from every test row to the closest training row.

    Search widens ring by ring: a point looks at the nine cells around it and is settled once
    the circle of the best distance found lies inside them; the others go on with cells four
    times as wide, until the cells cover the globe. Repeated coordinates are compared once, on
    either side.
    """
    tested = test.select("feature_id", "lat", "lon")
    asked = tested.select("lat", "lon").distinct()
    places = train.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).distinct()
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    km = geo.great_circle_km(
        F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), lx.EARTH_MEAN_KM
    )
    settled = None
    size = 0.05
    while True:
        whole = size > 180.0
        turns = F.lit(max(1, round(360.0 / size)))  # cells around the globe
        place_cells = places.withColumns(
            {
                "cx": F.pmod(F.floor((F.col("t_lon") + 180.0) / size), turns),
                "cy": geo.cell(F.col("t_lat"), size),
            }
        )
        asked_cells = (
            asked.withColumn("_dx", F.explode(around))
            .withColumn("_dy", F.explode(around))
            .withColumns(
                {
                    "cx": F.pmod(F.floor((F.col("lon") + 180.0) / size) + F.col("_dx"), turns),
                    "cy": geo.cell(F.col("lat"), size) + F.col("_dy"),
                }
            )
        )
        found = (
            asked_cells.join(place_cells, ["cx", "cy"])
            .groupBy("lat", "lon")
            .agg(F.min(km).alias("km"))
        )
        # A circle of angle a around latitude p reaches asin(sin a / cos p) in longitude
        # unless it holds a pole.
        angle = F.col("km") / lx.EARTH_MEAN_KM
        no_pole = F.abs("lat") + F.degrees(angle) < 90.0
        reach = F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("lat"))))
        limit = F.radians(F.lit(size))
        inside = (angle <= limit) & no_pole & (reach <= limit)
        done = F.lit(True) if whole else F.coalesce(inside, F.lit(False))
        checked = cut(asked.join(found, ["lat", "lon"], "left").withColumn("_done", done))
        part = checked.where("_done").select("lat", "lon", "km")
        settled = part if settled is None else settled.unionByName(part)
        asked = checked.where("NOT _done").drop("_done", "km")
        if whole or asked.isEmpty():
            # A row without a place has no distance, as before.
            return tested.join(settled.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")), "left").select("feature_id", "km")
        size *= 4
