"""Is a named way really a trail? Rules as one ordered chain over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway.functions import text


def score_ways(
    ways: DataFrame, place: Column | None = None, semantic: Column | None = None
) -> DataFrame:
    """Adds accepted, relevance_score, evidence_class and reasons to every way.

    Every step is a projection, so the whole chain runs inside the scan's stage.
    """
    semantic = F.lit(0.0) if semantic is None else semantic
    every_name = ", ".join(text.key_sql(tag) for tag in ["name", *lx.ALIAS_TAGS])
    if place is not None:
        ways = ways.withColumn("_asked", place)
    out = ways.withColumns(
        {
            "_name": text.name_key("name"),
            "_names": F.expr(f"array_distinct(filter(array({every_name}), n -> n <> ''))"),
            "_semantic": semantic,
            "_place": text.name_key("_asked") if place is not None else F.lit(""),
            **{
                f"_{tag}": text.name_key(tag)
                for tag in (
                    "route", "sac_scale", "trail_visibility", "foot", "footway_use", "highway",
                    "surface", "tracktype", "incline", "width", "sport", "access",
                )
            },
        }
    )
    c = F.col

    def any_name(pattern: str) -> Column:
        return F.exists("_names", lambda n: n.rlike(pattern))

    def some(tag: str) -> Column:
        return F.coalesce(F.length(tag) > 0, F.lit(False))

    out = out.withColumn("_tokens", text.tokens(F.array_join("_names", " ")))
    out = out.withColumns(
        {
            "_outdoor": F.arrays_overlap("_tokens", text.listed(lx.OUTDOOR_NAME_WORDS)),
            "_destination": F.arrays_overlap("_tokens", text.listed(lx.DESTINATION_NAME_WORDS)),
            "_explicit": F.arrays_overlap("_tokens", text.listed(lx.EXPLICIT_ROUTE_WORDS)),
            "_only_generic": (F.size("_tokens") > 0)
            & (
                F.size(
                    F.array_except(
                        "_tokens", text.listed(lx.GENERIC_TRAIL_WORDS + lx.GENERIC_WAY_NAMES)
                    )
                )
                == 0
            ),
            "_places": text.names_a_place("_tokens"),
            "_hiking_route": text.among("_route", lx.HIKING_ROUTE_TYPES),
            "_designated": (c("_foot") == "designated")
            & ~text.among("_surface", lx.PAVED_SURFACES)
            & ~text.among("_highway", lx.URBAN_HIGHWAYS),
            "_trail_sport": text.among("_sport", lx.TRAIL_SPORTS),
            "_capable": text.among("_highway", lx.PATH_HIGHWAYS + lx.TRACK_HIGHWAYS),
            "_at_place": (c("_place") != "") & F.exists("_names", lambda n: n.contains(c("_place"))),
        }
    )
    metadata = (
        c("_hiking_route") | some("_sac_scale") | some("_trail_visibility") | c("_designated")
        | some("trailblazed") | some("designation") | some("hiking") | c("_trail_sport")
    )
    durable = (
        some("_sac_scale") | some("_trail_visibility") | c("_designated")
        | (c("_semantic") >= 90.0) | c("_destination")
    )
    out = out.withColumns({"_metadata": metadata, "_durable": durable})
    named_outdoor = c("_outdoor") & ~c("_only_generic")

    # What each recorded signal adds, with the reason it is reported under.
    signals: list[tuple[Column, float, Column | str | None]] = [
        (c("_hiking_route"), 100.0, F.concat(F.lit("route="), "_route")),
        (some("_sac_scale"), 92.0, F.concat(F.lit("sac_scale="), F.lower(F.trim("sac_scale")))),
        (some("_trail_visibility"), 88.0, F.concat(F.lit("trail_visibility="), "_trail_visibility")),
        (c("_designated"), 74.0, "foot=designated"),
        (some("trailblazed"), 18.0, "trailblazed metadata"),
        (some("designation"), 14.0, "designation metadata"),
        (some("hiking"), 16.0, "hiking metadata"),
        (c("_trail_sport"), 60.0, F.concat(F.lit("sport="), "_sport")),
        (named_outdoor, 82.0, "hiking destination/name evidence"),
        (c("_at_place"), 78.0, "name matches searched place"),
        (some("_surface"), 5.0, None),
        (some("smoothness"), 5.0, None),
        (some("_tracktype"), 8.0, "tracktype metadata"),
        (some("_incline"), 4.0, None),
        (some("_width"), 3.0, None),
        (c("_semantic") >= 90.0, 86.0, "strong semantic-to-OSM name match"),
        (c("_capable"), 48.0, None),
        (~c("_capable") & text.among("_highway", lx.NEUTRAL_HIGHWAYS), 20.0, None),
    ]
    score = F.lit(0.0)
    for test, points, _ in signals:
        score = score + F.when(test, points).otherwise(0.0)
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.lit(reason) if isinstance(reason, str) else reason)
                for test, _, reason in signals
                if reason is not None
            ]
        )
    )

    numbered = c("_name").rlike(r"^\d{1,4}[a-z]?$") & (
        some("_sac_scale") | some("_trail_visibility")
    )
    length = F.coalesce(c("length_km"), F.lit(0.0))
    structure = F.exists(
        "_names",
        lambda n: F.arrays_overlap(F.split(n, " "), text.listed(lx.STRUCTURE_ACCESS_WORDS)),
    )
    reject = (
        F.when(
            ~c("_capable") & ~c("_metadata") & ~c("_outdoor"), "highway type is not trail-capable"
        )
        .when(c("_name") == "", "unnamed feature")
        .when(
            ~numbered & ((F.length("_name") < 3) | ~c("_name").rlike(r"\p{L}")),
            "non-descriptive name",
        )
        .when(length <= 0.0, "zero-length geometry")
        .when(
            text.among("_name", lx.GENERIC_WAY_NAMES) & (length < lx.GENERIC_NAME_LENGTH_KM),
            "generic path identity",
        )
        .when(
            any_name(lx.ROAD_NAME) & ~c("_explicit") & ~c("_metadata") & ~c("_outdoor")
            & ~c("_places") & (c("_semantic") < 90.0),
            "road-oriented name without explicit route evidence",
        )
        .when(
            ~c("_outdoor") & ~c("_destination") & structure & ~c("_durable") & ~c("_places"),
            "structure access rather than a route",
        )
        .when(
            any_name(lx.INFRASTRUCTURE_NAME) & ~c("_durable") & ~(c("_places") & c("_explicit")),
            "ordinary access/infrastructure name",
        )
        .when(
            any_name(lx.RELIGIOUS_NAME) & ~c("_outdoor") & ~c("_metadata")
            & (c("_semantic") < 90.0) & ~c("_destination") & ~c("_places"),
            "religious site access without route evidence",
        )
        .when(
            text.among("_footway_use", lx.EXCLUDED_FOOTWAY_USES) & ~c("_metadata"),
            "ordinary urban footway use",
        )
        .when(c("_name").rlike(lx.DEAD_END_NAME), "name states the way is a dead end")
        .when(
            text.among("_access", lx.RESTRICTED_ACCESS) & ~(c("_hiking_route") | some("_sac_scale")),
            "restricted access without explicit hiking route",
        )
    )
    strong = c("_metadata") | named_outdoor | (c("_semantic") >= 90.0) | c("_at_place")
    physical = (
        some("_surface") | some("_tracktype") | some("_incline") | some("_width")
        | some("_sac_scale") | some("_trail_visibility")
    )
    shaped = (
        (some("_surface") & ~text.among("_surface", lx.PAVED_SURFACES))
        | some("_tracktype")
        | (some("_incline") & ~c("_incline").isin("0", "0%", "flat", "uphill", "downhill"))
        | (some("_width") & ~c("_width").isin("0", "0m"))
        | (length >= 0.4)
        | (F.coalesce(c("point_count"), F.lit(0)) >= 8)
        | c("_outdoor")
        | c("_destination")
    )
    out = out.withColumns({"_score": score, "_found": found, "_reject": reject})
    verdict = (
        F.when(c("_reject").isNotNull(), "rejected")
        .when(strong, "strong")
        .when(length < lx.MIN_LOCAL_PATH_KM, "short")
        .when(text.among("_surface", lx.PAVED_SURFACES) & ~c("_durable"), "paved")
        .when(physical | (length >= lx.MIN_LOCAL_PATH_STRONG_KM), "weak")
        .when(c("_places") & shaped, "corroborated")
        .otherwise("nothing")
    )
    out = out.withColumn("_verdict", verdict)
    capped = F.least(c("_score"), F.lit(100.0))
    lifted = F.least(F.greatest(c("_score"), F.lit(lx.WEAK_EVIDENCE_SCORE)), F.lit(100.0))

    def single(reason: str) -> Column:
        return F.array(F.lit(reason))

    columns = {
            "accepted": c("_verdict").isin("strong", "weak", "corroborated"),
            "relevance_score": F.when(c("_verdict") == "rejected", 0.0)
            .when(c("_verdict").isin("weak", "corroborated"), lifted)
            .otherwise(capped),
            "evidence_class": F.when(c("_verdict") == "strong", "strong")
            .when(c("_verdict").isin("weak", "corroborated"), "weak")
            .otherwise("none"),
            "reasons": F.when(c("_verdict") == "rejected", F.array("_reject"))
            .when(c("_verdict") == "strong", c("_found"))
            .when(c("_verdict") == "short", single("too short to be a route in its own right"))
            .when(c("_verdict") == "paved", single("built-up surface without hiking metadata"))
            .when(
                c("_verdict") == "weak",
                F.concat(
                    "_found",
                    single("named local path; no route or trail-scale tags recorded"),
                ),
            )
            .when(
                c("_verdict") == "corroborated",
                F.concat(
                    "_found",
                    single(
                        "named local trail corroborated by independent evidence; no route or "
                        "trail-scale tags recorded"
                    ),
                ),
            )
            .otherwise(single("insufficient hiking evidence")),
        }
    # A generator keeps later filters on the verdict above the chain: pushed below, a filter
    # would repeat the whole chain inside itself.
    verdicts = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    kept = [name for name in ways.columns if name not in columns and name != "_asked"]
    return out.select(*kept, F.inline(verdicts))


def peak_association(vertices: DataFrame, peaks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Closest approach of each paired feature to a summit, and what it counts as."""
    from cairnway.functions import geo

    metres = 1000.0 * geo.great_circle_km(
        F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")
    )
    return (
        pairs.join(peaks.select("place_id", "latitude", "longitude"), "place_id")
        .join(vertices.select("feature_id", "lon", "lat"), "feature_id")
        .groupBy("place_id", "feature_id")
        .agg(F.min(metres).alias("closest_m"))
        .withColumn(
            "association",
            F.when(F.col("closest_m") <= lx.SUMMIT_BAND_M, "summit_route")
            .when(F.col("closest_m") <= lx.APPROACH_BAND_M, "peak_approach")
            .otherwise("nearby_route"),
        )
    )
