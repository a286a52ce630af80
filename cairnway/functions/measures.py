"""Measured tags (width, incline) read as numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx

# Fixed patterns: a number, a trailing unit, and the dash of a range.
_NUMBER = r"([-+]?\d+(?:\.\d+)?)"
_UNIT = r"(mm|cm|ft|in|m|°)\s*$"
_DASH = r"\s*[-–]\s*"


def _number(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part, _NUMBER, 1), F.lit("")).cast("double")


def with_number(df: DataFrame, tag: str, number: str, unit: str) -> DataFrame:
    """Adds the number of a measured tag, or the mean of a simple ``a-b`` range, and its unit.

    Done in steps so that each regular expression runs once per row.
    """
    steps = df.withColumn("_text", F.lower(F.trim(F.col(tag))))
    steps = steps.withColumns(
        {
            unit: F.regexp_extract("_text", _UNIT, 1),
            "_body": F.trim(F.regexp_replace("_text", _UNIT, "")),
        }
    )
    steps = steps.withColumn("_sides", F.split("_body", _DASH, 2))
    steps = steps.withColumns(
        {
            "_first": _number(F.get("_sides", F.lit(0))),
            "_second": _number(F.get("_sides", F.lit(1))),
            "_whole": _number(F.col("_body")),
        }
    )
    middle = F.coalesce((F.col("_first") + F.col("_second")) / 2.0, F.col("_whole"))
    return steps.withColumn(number, middle).drop(
        "_text", "_body", "_sides", "_first", "_second", "_whole"
    )


def incline_pct(number: Column, unit: Column) -> Column:
    return F.when(unit == "°", F.tan(number * (math.pi / 180.0)) * 100.0).otherwise(number)


def width_m(number: Column, unit: Column) -> Column:
    return (
        F.when(unit == "mm", number / 1000.0)
        .when(unit == "cm", number / 100.0)
        .when(unit == "ft", number * 0.3048)
        .when(unit == "in", number * 0.0254)
        .otherwise(number)
    )


def plain_level(value: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit(lx.MISSING))


def visibility_level(value: Column) -> Column:
    text = plain_level(value)
    # The two spellings that mean "intermediate".
    long_form = (
        "intermediate: few markers, intermediate: few markers, path mostly visible"
    )
    return F.when(text.isin("intermdiate", long_form), "intermediate").otherwise(text)


def assisted_level(value: Column) -> Column:
    text = plain_level(value)
    return F.when(text.isin("rope", "ropes"), "rope").otherwise(text)


def incline_level(value: Column, number: Column) -> Column:
    text = F.nullif(F.lower(F.trim(value)), F.lit(""))
    return (
        F.when(text.isNull(), lx.MISSING)
        .when(number > 0, "up")
        .when(number < 0, "down")
        .when(number.isNotNull(), "flat")
        .when(text.isin("up", "down", "steep"), text)
        .otherwise("unknown")
    )
