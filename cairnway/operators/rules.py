"""Rule engines over route rows. Each is a projection: no rule needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx

# Surfaces, weather-code groups and activity kinds.
HOLDS_WATER = "earth soil mud grass sand dirt ground gravel rock wood".split()
DRAINS = "asphalt paved concrete cement paving_stones".split()
SEALED = "asphalt paved concrete cement".split()
SNOW_CODES = [71, 73, 75, 77, 85, 86]
STORM_CODES = [95, 96, 99]
FOG_CODES = [45, 48]
LIGHT_RAIN_CODES = [51, 53, 55, 61, 80]
MODERATE_RAIN_CODES = [56, 57, 66, 67, 63, 81]
HEAVY_RAIN_CODES = [65, 82]
TECHNICAL_GRADES = ["demanding_alpine_hiking", "difficult_alpine_hiking"]
MULTI_DAY_KM, HIGH_ALTITUDE_M, VERY_HIGH_ALTITUDE_M = 25.0, 3000.0, 4000.0
ACTIVITIES = ["day_hike", "multi_day_trek", "high_altitude_trek", "technical_alpine"]
PRIORITIES = ["essential", "recommended", "conditional"]
UNBUYABLE = "navigation overnight resupply acclimatisation experience".split()


def _c(name: str) -> Column:
    return F.col(name)


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _ladder(*steps: tuple[Column, str, int]) -> tuple[Column, Column]:
    """State and points of the first step that holds."""
    state, points = F.lit(None).cast("string"), F.lit(0)
    for test, name, value in reversed(steps):
        state = F.when(test, name).otherwise(state)
        points = F.when(test, value).otherwise(points)
    return state, points


def effective(routes: DataFrame) -> DataFrame:
    """Cold and wind as the worse of now and the walk, and one rain level."""
    rate = _c("precip_now") * 3600.0 / F.coalesce(F.nullif("precip_interval_s", F.lit(0.0)), F.lit(3600.0))
    out = routes.withColumns(
        {
            "cold": F.least("temperature", "window_cold"),
            "gust": F.greatest("wind", "window_wind"),
            "rate": F.greatest(rate, _c("window_peak_mm")),
            "recent": F.coalesce("rain_24h", "precip_24h"),
            "recent_72h": F.coalesce("rain_72h", "precip_72h"),
        }
    )
    measured = F.when(_c("rate") >= 7.6, 3).when(_c("rate") >= 2.5, 2).when(_c("rate") > 0, 1).otherwise(0)
    coded = (
        F.when(_c("weather_code").isin(HEAVY_RAIN_CODES), 3)
        .when(_c("weather_code").isin(MODERATE_RAIN_CODES), 2)
        .when(_c("weather_code").isin(LIGHT_RAIN_CODES), 1)
        .otherwise(0)
    )
    return out.withColumn("rain_level", F.greatest(measured, coded))


def condition(routes: DataFrame) -> DataFrame:
    """Additive weather score 0-100 with its factors and what could not be read."""
    r = effective(routes)
    likely = _true(_c("forecast_prob") >= 70.0)
    heavy = _c("forecast_rain") >= 5.0
    wet_ground = _true(_c("recent") >= 5.0) | _true(_c("forecast_rain") >= 5.0) | (_c("rain_level") >= 2)
    snowing = _true(_c("snowfall") > 0) | _true(_c("weather_code").isin(SNOW_CODES))
    surface = F.nullif(F.lower(F.trim("surface")), F.lit(""))
    factors = {
        "wetness": _ladder(
            (_c("recent") >= 20.0, "saturated", 34), (_c("recent") >= 5.0, "wet", 22),
            (_c("recent") >= 1.0, "damp", 10), (_c("recent") > 0.0, "damp", 3),
            (_c("recent").isNotNull(), "dry", 0),
        ),
        "precipitation": _ladder(
            (_c("rain_level") == 3, "active", 24), (_c("rain_level") == 2, "active", 10),
            (_c("rain_level") == 1, "active", 4),
        ),
        "visibility": _ladder((_c("weather_code").isin(FOG_CODES), "fog", 6)),
        "forecast": _ladder(
            (heavy & likely, "likely_rain", 18), (heavy, "rain", 14),
            ((_c("forecast_rain") >= 1.0) & likely, "likely_rain", 9), (_c("forecast_rain") >= 1.0, "rain", 6),
        ),
        "snow": _ladder((snowing, "snow", 30)),
        "storm": _ladder((_c("weather_code").isin(STORM_CODES), "thunderstorm", 55)),
        "cold": _ladder(
            (_c("cold") <= 0.0, "freezing", 26), (_c("cold") <= 5.0, "very_cold", 16), (_c("cold") <= 10.0, "cold", 6)
        ),
        "wind": _ladder(
            (_c("gust") >= 60.0, "storm_force", 28), (_c("gust") >= 40.0, "strong", 25), (_c("gust") >= 25.0, "breezy", 9)
        ),
        "surface": _ladder(
            (surface.isin(HOLDS_WATER) & wet_ground, "water_retaining", 8), (surface.isin(HOLDS_WATER), "natural", 0),
            (surface.isin(DRAINS), "draining", 0), (surface.isNotNull(), "natural", 0),
        ),
        "terrain": _ladder((_c("max_slope_pct") >= 35.0, "steep", 8), (_c("max_slope_pct") >= 25.0, "moderately_steep", 4)),
        "exposure": _ladder(((_c("gain_m") >= 600.0) & (_c("cold") <= 8.0), "high_cold_exposed", 10)),
        "snow_forecast": _ladder((_true(_c("snow_likely")) & ~snowing, "snow", 22)),
    }
    found = F.array(
        *[
            F.when(state.isNotNull(), F.struct(F.lit(name).alias("factor"), state.alias("state"), points.alias("weight")))
            for name, (state, points) in factors.items()
        ]
    )
    gaps = {
        "recent_24h_rainfall": _c("recent"), "recent_72h_rainfall": _c("recent_72h"),
        "current_precipitation": _c("precip_now"), "forecast_rain": _c("forecast_rain"), "temperature": _c("cold"),
        "wind_speed": _c("gust"), "surface": surface, "terrain_slope": _c("max_slope_pct"),
    }
    missing = F.array(*[F.when(value.isNull(), name) for name, value in gaps.items()])
    r = r.withColumns({"factors": F.array_compact(found), "missing": F.array_compact(missing)})
    # Three days of rain add points without a factor of their own.
    soaked = F.when(_c("recent_72h") >= 50.0, 14).when(_c("recent_72h") >= 20.0, 8).otherwise(0)
    total = F.aggregate("factors", F.lit(0), lambda acc, f: acc + f["weight"]) + soaked
    known = _true(_c("has_weather"))
    r = r.withColumn("_total", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    status = (
        F.when(~known | (F.size("missing") > 3), "unknown")
        .when(_c("_total") >= 55, "adverse")
        .when(_c("_total") >= 25, "caution")
        .otherwise("favorable")
    )
    empty = F.filter("factors", lambda f: F.lit(False))
    return r.withColumns(
        {
            "condition_status": status,
            "condition_score": F.when(known, _c("_total").cast("long")),
            "factors": F.when(known, _c("factors")).otherwise(empty),
            "missing": F.when(known, _c("missing")).otherwise(F.array(F.lit("live_weather"))),
        }
    ).drop("_total", "recent", "recent_72h", "rate")


def suitability(assessed: DataFrame) -> DataFrame:
    """Demand points of the route and its conditions, and the level they amount to."""
    distance = F.coalesce("distance_km", F.lit(0.0))

    def two(value: Column, high: float, some: float) -> Column:
        return F.when(value >= high, 2).when(value >= some, 1).otherwise(0)

    weather = F.size(F.filter("factors", lambda f: f["weight"] >= 10))
    points = (
        two(distance, 12.0, 6.0) + two(_c("gain_m"), 800.0, 350.0) + two(_c("max_slope_pct"), 35.0, 20.0) + weather
    )
    out = assessed.withColumn("demand_points", points.cast("long"))
    status = _c("condition_status")
    return out.withColumn(
        "suitability",
        F.when(status == "unknown", "insufficient_data")
        .when(status == "adverse", "currently_unfavorable")
        .when((status == "caution") | (_c("demand_points") >= 4), "caution")
        .when(_c("demand_points") >= 2, "demanding")
        .otherwise("suitable_now"),
    )


def activity(routes: DataFrame) -> DataFrame:
    """What kind of trip a route is; the most demanding signal wins."""
    scattered = (_c("continuity") == "separate_pieces") & _c("main_chain_share").isNotNull()
    trip = F.when(scattered, _c("distance_km") * _c("main_chain_share")).otherwise(_c("distance_km"))
    helped = _true(F.lower("assisted_trail").isin("yes", "via_ferrata")) | _true(F.lower("highway") == "via_ferrata")
    r = routes.withColumns({"trip_km": trip, "assisted": helped})
    signals = [
        (_c("sac_scale").isin(TECHNICAL_GRADES), 3, F.concat(F.lit("recorded grade "), "sac_scale")),
        (_c("assisted"), 3, F.lit("fixed aids recorded")),
        (_c("max_elevation_m") >= HIGH_ALTITUDE_M, 2, F.format_string("highest sampled point %.0f m", "max_elevation_m")),
        (_c("trip_km") >= MULTI_DAY_KM, 1, F.format_string("%.0f km of continuous route", "trip_km")),
    ]
    best = F.greatest(F.lit(0), *[F.when(_true(test), rank).otherwise(0) for test, rank, _ in signals])
    reasons = F.array_compact(F.array(*[F.when(_true(test), why) for test, _, why in signals]))
    return r.withColumns(
        {
            "activity": F.element_at(F.array(*map(F.lit, ACTIVITIES)), best + 1),
            "activity_reasons": F.when(F.size(reasons) > 0, reasons).otherwise(
                F.array(F.lit("no signal beyond an ordinary walked route"))
            ),
        }
    )


def complexity(routes: DataFrame) -> DataFrame:
    """Weighted saturating score over the measurements that are present."""

    def saturate(value: Column, half: float) -> Column:
        return F.when(value > 0, value / (value + half)).otherwise(0.0)

    parts = [
        (_c("distance_km").isNotNull(), saturate(_c("distance_km"), 8.0), 0.30),
        (_c("gain_m") > 0, saturate(_c("gain_m"), 500.0), 0.28),
        (_c("max_slope_pct").isNotNull(), F.least(_c("max_slope_pct") / 60.0, F.lit(1.0)), 0.24),
        (_c("range_m") > 0, F.least(_c("range_m") / 1200.0, F.lit(1.0)), 0.18),
        (_c("component_count") > 1, F.least((_c("component_count") - 1) / 6.0, F.lit(1.0)), 0.10),
    ]
    total = weight = F.lit(0.0)
    for present, value, share in parts:
        total = total + F.when(_true(present), value * share).otherwise(0.0)
        weight = weight + F.when(_true(present), share).otherwise(0.0)
    r = routes.withColumn("complexity", F.bround(100.0 * total / F.nullif(weight, F.lit(0.0)), 1))
    return r.withColumn(
        "complexity_label",
        F.when(_c("complexity").isNull(), "unavailable")
        .when(_c("complexity") < 22.0, "low")
        .when(_c("complexity") < 45.0, "moderate")
        .when(_c("complexity") < 70.0, "substantial")
        .otherwise("demanding"),
    )


def reconcile(routes: DataFrame) -> DataFrame:
    """The recorded grade wins; an estimate is shown only where nothing is recorded."""
    grade = F.lower(F.trim("sac_scale"))
    tier = F.lit(None).cast("string")
    for name, value in lx.GRADE_TIER.items():
        tier = F.when(grade == name, value).otherwise(tier)
    r = routes.withColumn("recorded_tier", tier)
    recorded, guess = _c("recorded_tier"), _c("estimate_tier")
    shown = F.coalesce(recorded, guess)
    label = F.lit(None).cast("string")
    for name, value in lx.TIER_LABEL.items():
        label = F.when(shown == name, value).otherwise(label)
    return r.withColumns(
        {
            "difficulty_status": F.when(recorded.isNotNull() & (recorded != guess), "superseded_by_official_scale")
            .when(recorded.isNotNull(), "official_scale_available")
            .when(guess.isNotNull(), "model_estimate_only")
            .otherwise("unavailable"),
            "shown_difficulty": label,
            "provenance": F.when(recorded.isNotNull(), "official_osm_sac_scale")
            .when(guess.isNotNull(), "model_estimated")
            .otherwise("unavailable"),
        }
    )


def gear(routes: DataFrame) -> DataFrame:
    """One row per route and need: priority, item, category and evidence.

    ``routes`` has been through ``condition`` and ``activity``. The rules of one need are known
    beforehand, so they are merged inside the row: the best priority, the evidence of every
    rule that fired, and the wording of the first one or of a later, more specific one.
    """
    km = F.coalesce("distance_km", F.lit(0.0))
    surface = F.nullif(F.lower(F.trim("surface")), F.lit(""))
    rain = F.coalesce("rain_24h", "precip_24h")
    most_rain = F.greatest(F.lit(0.0), rain, _c("precip_now"), _c("forecast_rain"))
    weather = _true(_c("has_weather"))

    def state(factor: str) -> Column:
        hit = F.filter("factors", lambda f: f["factor"] == factor)
        return F.get(hit, F.lit(0))["state"]

    r = routes.withColumns({"_wet": state("wetness"), "_falling": state("precipitation"), "_snow": state("snow")})
    damp = _true(_c("_wet").isin("damp", "wet", "saturated")) | _true(_c("_falling").isin("active", "likely_rain", "rain"))
    r = r.withColumns(
        {
            "_raining": weather & ((most_rain > 0) | _true(_c("forecast_prob") >= 50.0) | damp),
            "_damp": weather & damp,
            "_rained": weather & (most_rain >= 1.0),
            "_steep": _true(_c("max_slope_pct") >= 30.0),
            "_climb": _true(_c("gain_m") >= 400.0),
            "_long": km >= 8.0,
            "_hot": weather & _true(_c("temperature") >= 28.0),
            "_now": weather & _true(_c("precip_now") > 0),
            "_snowy": weather & (_true(_c("snowfall") > 0) | _c("_snow").isNotNull() | _true(_c("snow_likely"))),
            "_chill": F.when(weather, _c("cold")),
            "_blow": F.when(weather, _c("gust")),
        }
    )
    soaked = _c("_raining") & (_c("_damp") | _c("_rained"))
    technical = _c("activity") == "technical_alpine"
    exposed = _c("_steep") & _true(_c("range_m") >= 300.0)
    multi_day, high = _true(_c("trip_km") >= MULTI_DAY_KM), _true(_c("max_elevation_m") >= HIGH_ALTITUDE_M)

    def fmt(pattern: str, *columns: str | Column) -> Column:
        values = [F.col(x) if isinstance(x, str) else x for x in columns]
        ready = F.lit(True)
        for value in values:
            ready = ready & value.isNotNull()
        return F.when(ready, F.format_string(pattern, *values))

    climb_notes = [fmt("%.0f m sampled ascent", "gain_m"), fmt("%.0f%% steepest sampled section", "max_slope_pct")]
    length_note = fmt("verified route length: %.1f km", km)
    cold_note, wind_note = fmt("coldest temperature: %.1f °C", "_chill"), fmt("strongest wind: %.1f km/h", "_blow")
    trip_note, high_note = fmt("%.0f km of continuous route", "trip_km"), fmt("highest sampled point %.0f m", "max_elevation_m")
    heat_note = F.when(_c("_hot"), fmt("current temperature: %.1f °C", "temperature"))
    ascent_note = fmt("sampled ascent: %.0f m", "gain_m")
    surface_note = F.concat(F.lit("recorded surface: "), surface)
    falling_note = F.when(_c("_now"), F.lit("current precipitation: above zero"))
    walked = F.lit("route is a walked trail")
    very_high = _true(_c("max_elevation_m") >= VERY_HIGH_ALTITUDE_M)
    reasons_note = F.array_join("activity_reasons", ", ")
    always = F.lit(True)
    # need, category -> rules in order: test, priority, item, evidence, replaces earlier wording.
    catalogue: dict[tuple[str, str], list[tuple]] = {
        ("trail_footwear", "footwear"): [
            (always, 0, "Broken-in trail shoes", [walked], False),
            (surface.isNotNull() & ~surface.isin(SEALED), 0, F.concat(F.lit("Trail shoes with an outsole suited to "), surface), [walked, surface_note], True),
        ],
        ("navigation", "navigation"): [(always, 0, "Offline access to this route", [F.lit("map identity is verified and stable")], False)],
        ("overnight", "shelter"): [(multi_day, 1, "Overnight plan: huts, lodging or shelter and a sleep system", [trip_note], False)],
        ("resupply", "food"): [(multi_day, 1, "Food and water resupply plan for each day", [trip_note], False)],
        ("light", "lighting"): [
            (multi_day, 1, "Headlamp", [trip_note], False),
            (_c("_long") | _c("_climb"), 2, "Headlamp, if any of the route is walked after dark", [length_note, ascent_note], False),
        ],
        ("acclimatisation", "acclimatisation"): [
            (high, F.when(very_high, 0).otherwise(1), "Acclimatisation plan and the signs of altitude sickness", [high_note], False)
        ],
        ("insulation", "clothing"): [
            (high, 1, "Insulating layer for the high sections", [high_note], False),
            (_c("_chill") <= 4.0, 0, "Insulated jacket, hat and gloves", [cold_note, *climb_notes], False),
            (_c("_chill") <= -10.0, 0, "Expedition insulation: mitts, balaclava and insulated boots",
             [cold_note, F.when(_c("_blow") >= 25.0, wind_note)], True),
        ],
        ("sun_protection", "sun protection"): [
            (high, 1, "Sunglasses and high-SPF sun protection", [high_note], False),
            (weather & (_c("temperature") >= 27.0) & ~_c("_raining"), 1, "Sun hat, sunglasses and sunscreen",
             [fmt("current temperature: %.1f °C", "temperature")], False),
        ],
        ("experience", "experience"): [(technical, 0, "Mountaineering experience, or a qualified guide", [reasons_note], False)],
        ("helmet", "equipment"): [(technical, F.when(_c("assisted"), 0).otherwise(1), "Climbing helmet", [reasons_note], False)],
        ("harness", "equipment"): [(technical & _c("assisted"), 0, "Harness and via ferrata set", [reasons_note], False)],
        ("poles", "equipment"): [
            (_c("_climb") | _c("_steep"), 1, "Trekking poles", climb_notes, False),
            (exposed & soaked, 1, "Trekking poles, and extra care on the steepest section",
             [fmt("steepest sampled section: %.0f%%", "max_slope_pct"), fmt("elevation range: %.0f m", "range_m"),
              F.concat(F.lit("current condition: "), "condition_status")], False),
        ],
        ("socks", "clothing"): [(_c("_climb") | _c("_steep"), 1, "Socks, plus a spare pair", climb_notes, False)],
        ("hydration", "hydration"): [
            (_c("_long") | _c("_hot"), 0,
             F.concat(F.lit("Water and electrolytes for the route length"), F.when(_c("_hot"), ", and extra for the heat").otherwise("")),
             [length_note, heat_note], False),
            (~_c("_long") & ~_c("_hot") & (km >= 3.0), 1, "Water for the route length", [length_note], False),
        ],
        ("first_aid", "first_aid"): [(_c("_long") | _c("_climb"), 1, "Small first-aid kit", [length_note, ascent_note], False)],
        ("rain_shell", "clothing"): [
            (soaked, 0, "Waterproof shell",
             [F.when(rain > 0, fmt("24 h rainfall: %.1f mm", rain)), falling_note,
              F.when(_c("forecast_prob") >= 50.0, fmt("forecast rain chance: %.0f%%", "forecast_prob")), surface_note], False)
        ],
        ("wet_footwear", "clothing"): [
            (soaked & _c("_now") & surface.isNotNull(), 2, "Waterproof over-trousers", [falling_note, surface_note], False)
        ],
        ("thermal_layer", "clothing"): [(_c("_chill") <= 12.0, 0, "Fleece or synthetic mid layer", [cold_note], False)],
        ("wind_layer", "clothing"): [
            (_c("_blow") >= 30.0, 0, "Windproof outer layer", [wind_note, fmt("steepest sampled section: %.0f%%", "max_slope_pct")], False)
        ],
        ("winter_equipment", "equipment"): [
            (_c("_snowy") & (_c("_steep") | _c("_climb")), 0, "Ice axe or crampons, matched to the route", [F.lit("snow on this route"), *climb_notes], False),
            (_c("_snowy") & ~(_c("_steep") | _c("_climb")), 1, "Waterproof boots and warm layers for snow underfoot", [F.lit("snow on this route")], False),
        ],
    }
    text_of = lambda x: F.lit(x) if isinstance(x, str) else x
    rows = []
    for (need, category), offers in catalogue.items():
        fired = [_true(test) for test, *_ in offers]
        any_fired = fired[0]
        for test in fired[1:]:
            any_fired = any_fired | test
        rank = F.least(*[F.when(f, F.lit(p) if isinstance(p, int) else p) for f, (_, p, *_) in zip(fired, offers)], F.lit(9))
        wording = [F.when(f, text_of(item)) for f, (_, _, item, _, special) in reversed(list(zip(fired, offers))) if special]
        wording += [F.when(f, text_of(item)) for f, (_, _, item, _, _) in zip(fired, offers)]
        notes = F.array(*[F.when(f, note) for f, (_, _, _, evidence, _) in zip(fired, offers) for note in evidence])
        rows.append(
            F.when(
                any_fired,
                F.struct(
                    F.lit(need).alias("need"), F.lit(category).alias("category"), rank.cast("long").alias("rank"),
                    F.coalesce(*wording).alias("item"), F.array_distinct(F.array_compact(notes)).alias("evidence"),
                ),
            )
        )
    listed = r.select("feature_id", F.inline(F.array_compact(F.array(*rows))))
    group = (
        F.when(_c("category").isin("navigation", "first_aid", "acclimatisation", "experience"), "preparation")
        .when(_c("category").isin("hydration", "food"), "supplies")
        .otherwise("equipment")
    )
    priority = F.element_at(F.array(*map(F.lit, PRIORITIES)), (_c("rank") + 1).cast("int"))
    return listed.select(
        "feature_id", "need", "category", priority.alias("priority"), "item", "evidence", group.alias("gear_group")
    )


def priority_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, PRIORITIES)), _c("priority"))


def buyable(items: DataFrame) -> DataFrame:
    """Items that can be bought, each text once per route, and their order."""
    from cairnway import skew

    wanted = items.where(~_c("need").isin(UNBUYABLE)).withColumn("_key", F.lower("item"))
    once = skew.top_per_group(wanted, ["feature_id", "_key"], [priority_rank(), _c("need")], 1).drop("_key")
    return ordered_gear(once)


def ordered_gear(items: DataFrame) -> DataFrame:
    """Items by priority and text, numbered within their route (a route has at most 20)."""
    from pyspark.sql import Window

    order = Window.partitionBy("feature_id").orderBy(priority_rank(), "item", "need")
    return items.withColumn("place", F.row_number().over(order).cast("long"))


def gear_counts(items: DataFrame) -> DataFrame:
    counted = {p: F.count_if(_c("priority") == p) for p in PRIORITIES}
    counted |= {g: F.count_if(_c("gear_group") == g) for g in ("equipment", "supplies", "preparation")}
    return items.groupBy("feature_id").agg(*[v.alias(k) for k, v in counted.items()])


def tier_vote(members: DataFrame, first: int = 25) -> DataFrame:
    """Tier of each route from its first members' own predictions.

    ``members``: route_id, pos, scored, tier and one probability column per tier.
    """
    from cairnway import skew

    total = members.groupBy("route_id").agg(F.count(F.lit(1)).alias("total_members"))
    early = skew.top_per_group(members, ["route_id"], [_c("pos")], first).where("scored")
    votes = early.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("scored_members"),
        *[F.count_if(_c("tier") == t).alias(f"n_{t}") for t in lx.TIERS],
        *[F.bround(F.sum(F.bround(f"p_{t}", 4)), 4).alias(f"m_{t}") for t in lx.TIERS],
    )
    ranked = F.array_sort(
        F.array(*[F.struct((-_c(f"n_{t}")).alias("n"), (-_c(f"m_{t}")).alias("m"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(lx.TIERS)])
    )
    v = total.join(votes, "route_id", "left").withColumn("scored_members", F.coalesce("scored_members", F.lit(0))).withColumn("_r", ranked)
    enough = (_c("scored_members") >= 2) | ((_c("scored_members") == 1) & (_c("total_members") == 1))
    lead, second = _c("_r")[0], _c("_r")[1]
    share = F.bround(-lead["n"] / _c("scored_members"), 4)
    return v.select(
        "route_id", "total_members", "scored_members",
        F.when(enough, lead["t"]).alias("tier"),
        F.when(enough, share).alias("agreement"),
        F.when(enough, F.bround(-lead["m"] / _c("scored_members"), 4)).alias("confidence"),
        F.when(enough, share < 2 / 3).alias("members_disagree"),
        F.when(enough, (_c("scored_members") > 1) & (lead["n"] == second["n"]) & (lead["m"] == second["m"])).alias("tied"),
        (_c("total_members") > first).alias("truncated"),
    )
