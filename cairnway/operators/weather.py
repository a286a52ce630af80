"""Hourly weather: the current hour, rolling sums, the walking window, a route's worst case.

Windows go over one point's hours: a century of hours is under a million rows, so a point is
always small enough for a task however many routes read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnway import lexicon as lx


def hour_number(ts: Column) -> Column:
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def current_hour(current: DataFrame, hourly: DataFrame) -> DataFrame:
    """The hour row each observation belongs to; without one, the first hour of its point."""
    hours = hourly.select("point_id", "ts")
    first = hours.groupBy("point_id").agg(F.min("ts").alias("_first"))
    exact = hours.select("point_id", F.col("ts").alias("_hour"))
    return (
        current.join(first, "point_id")
        .join(
            exact,
            (current["point_id"] == exact["point_id"])
            & (F.date_trunc("hour", current["observed_at"]).cast("timestamp_ntz") == exact["_hour"]),
            "left",
        )
        .select(current["point_id"], "observed_at", F.coalesce("_hour", "_first").alias("hour"))
    )


def rolling_rain(hourly: DataFrame, digits: int = 2) -> DataFrame:
    """Sums of the last 24, 48 and 72 hours with the current one, and of the next 24 without it."""
    by_hour = Window.partitionBy("point_id").orderBy("_h")
    out = hourly.withColumn("_h", hour_number(F.col("ts")))
    sums = {}
    for name in ("precipitation", "rain"):
        for hours in (24, 48, 72):
            sums[f"{name}_{hours}h"] = F.sum(name).over(by_hour.rangeBetween(1 - hours, 0))
        sums[f"next_{name}_24h"] = F.sum(name).over(by_hour.rangeBetween(1, 24))
    sums["next_probability_max"] = F.max("probability").over(by_hour.rangeBetween(1, 24))
    return out.select("point_id", "ts", *[F.round(v, digits).alias(k) for k, v in sums.items()])


def walking_hours(distance_km: Column, ascent_m: Column) -> Column:
    """Naismith's rule within 1 to 24 hours; without a distance there is no estimate."""
    hours = distance_km / lx.NAISMITH_KM_PER_HOUR + F.greatest(
        F.coalesce(ascent_m, F.lit(0.0)), F.lit(0.0)
    ) / lx.NAISMITH_ASCENT_M_PER_HOUR
    bounded = F.greatest(F.lit(lx.MIN_WINDOW_HOURS), F.least(F.lit(lx.MAX_WINDOW_HOURS), hours))
    return F.when(distance_km > 0, bounded)


def window_summary(hourly: DataFrame, current: DataFrame) -> DataFrame:
    """Harshest hourly values from now until the walk ends, and the snow of the 72 h before.

    ``current`` has point_id, hour and window_hours; both ends of the walk count.
    """
    off = hour_number(F.col("ts")) - hour_number(F.col("hour"))
    during = off.between(F.lit(0), F.ceil("window_hours"))
    before = off.between(-72, -1)

    def kept(test: Column, name: str) -> Column:
        return F.when(test, F.col(name))

    return hourly.join(current, "point_id").groupBy("point_id", "window_hours").agg(
        F.min(kept(during, "temperature")).alias("min_temperature"),
        F.max(kept(during, "wind_speed")).alias("max_wind_speed"),
        F.max(kept(during, "wind_gust")).alias("max_wind_gust"),
        F.max(kept(during, "precipitation")).alias("max_precipitation_mm"),
        F.round(F.sum(kept(during, "snowfall")), 2).alias("snowfall_cm"),
        F.max(kept(during, "snow_depth")).alias("max_snow_depth_m"),
        F.min(kept(during, "freezing_level")).alias("min_freezing_level_m"),
        F.round(F.sum(kept(before, "snowfall")), 2).alias("recent_snowfall_cm"),
    )


def severity(code: str) -> Column:
    arms = " ".join(
        f"WHEN {code} IN ({', '.join(map(str, codes))}) THEN {i}"
        for i, codes in enumerate(lx.CODE_SEVERITY_TIERS)
    )
    return F.expr(f"CASE {arms} ELSE 0 END")


def code_name(code: str) -> Column:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in lx.WEATHER_CODE_NAMES.items())
    return F.expr(f"CASE {code} {arms} ELSE 'Unknown' END")


def route_worst(readings: DataFrame) -> DataFrame:
    """The harshest reading of each route over its sample points; missing values hide nothing."""
    has_code = F.col("weather_code").isNotNull()
    by = F.when(has_code, F.struct(severity("weather_code").alias("s"), (-F.col("sample_no")).alias("n")))
    return readings.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("temperature").alias("temperature"),
        F.max("wind_speed").alias("wind_speed"),
        F.max("precipitation").alias("precipitation"),
        F.max("snowfall").alias("snowfall"),
        F.max_by("weather_code", by).alias("weather_code"),
        F.max("elevation_m").alias("highest_m"),
        F.min("min_temperature").alias("min_temperature"),
        F.max("max_wind_speed").alias("max_wind_speed"),
        F.max("max_precipitation_mm").alias("max_precipitation_mm"),
        F.max("snowfall_cm").alias("snowfall_cm"),
        F.max("max_snow_depth_m").alias("max_snow_depth_m"),
        F.min("min_freezing_level_m").alias("min_freezing_level_m"),
        F.max("recent_snowfall_cm").alias("recent_snowfall_cm"),
    ).withColumn("weather_condition", code_name("weather_code"))


def inference(worst: DataFrame) -> DataFrame:
    """What the forecast implies for the route; nothing here is observed on the trail."""
    c = F.col
    above = F.coalesce(c("highest_m") > c("min_freezing_level_m"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(
                c("max_snow_depth_m") >= lx.SNOW_LYING_M,
                F.format_string("about %.0f cm of snow lying at the high points", c("max_snow_depth_m") * 100),
            ),
            F.when(
                c("snowfall_cm") >= lx.SNOW_FORECAST_CM,
                F.format_string("%.1f cm of snow forecast during the walk", c("snowfall_cm")),
            ),
            F.when(
                above & (c("recent_snowfall_cm") >= lx.SNOW_RECENT_CM),
                F.format_string(
                    "%.1f cm of snow in the last 3 days, and the freezing level (%.0f m) is below "
                    "the highest point (%.0f m)",
                    c("recent_snowfall_cm"), c("min_freezing_level_m"), c("highest_m"),
                ),
            ),
        )
    )
    return worst.select(
        "feature_id",
        "highest_m",
        "min_freezing_level_m",
        above.alias("above_freezing_level"),
        F.when(above, F.bround(c("highest_m") - c("min_freezing_level_m"), 0)).alias("margin_m"),
        reasons.alias("snow_reasons"),
        (F.size(reasons) > 0).alias("snow_likely"),
    )
