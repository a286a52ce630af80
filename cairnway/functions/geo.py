"""Geometry as column arithmetic; coordinates are lon/lat degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnway import lexicon as lx


def great_circle_km(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = lx.EARTH_KM
) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # greatest and least skip NULL, so a missing coordinate has to be kept out of the clamp.
    safe = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    arc = F.lit(2.0 * radius) * F.atan2(F.sqrt(safe), F.sqrt(1.0 - safe))
    return F.when(a.isNotNull(), arc)


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a local plane, for points a few tens of kilometres apart."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * lx.FLAT_KM_PER_DEGREE
    north = (lat2 - lat1) * lx.FLAT_KM_PER_DEGREE
    return F.sqrt(east * east + north * north)


def planar_gap(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Squared cos-scaled degree distance with longitude wrapped; orders points by nearness."""
    # Wrapping costs digits, and near ties hang on them, so only what crosses the date line pays.
    step = lon - lon0
    d_lon = F.when(F.abs(step) <= 180.0, step).otherwise(F.pmod(step + 180.0, F.lit(360.0)) - 180.0)
    x = d_lon * F.cos(F.radians(lat0))
    y = lat - lat0
    return x * x + y * y


def box_around(lat: Column, lon: Column, radius_km: Column) -> dict[str, Column]:
    radius = F.greatest(F.lit(1.0), radius_km)
    d_lat = radius / lx.BOX_KM_PER_DEGREE
    d_lon = radius / (
        lx.BOX_KM_PER_DEGREE * F.greatest(F.lit(0.15), F.abs(F.cos(F.radians(lat))))
    )
    return {
        "west": F.greatest(F.lit(-180.0), lon - d_lon),
        "south": F.greatest(F.lit(-90.0), lat - d_lat),
        "east": F.least(F.lit(180.0), lon + d_lon),
        "north": F.least(F.lit(90.0), lat + d_lat),
    }


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def cells_of_span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(cell(low, size), cell(high, size))


def in_world(lon: Column, lat: Column) -> Column:
    """Finite and in range; NULL and NaN fail."""
    ok = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.coalesce(ok & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def segment_meets_box(
    x1: Column, y1: Column, x2: Column, y2: Column,
    west: Column, south: Column, east: Column, north: Column,
) -> Column:
    """Does the segment touch the closed box? Clips the segment's parameter range per axis."""

    def axis(start: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (low - start) / step, (high - start) / step
        inside = start.between(low, high)
        enter = F.when(step != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0))
        leave = F.when(step != 0, F.greatest(a, b)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))
        return enter, leave

    in_x, out_x = axis(x1, x2 - x1, west, east)
    in_y, out_y = axis(y1, y2 - y1, south, north)
    return F.greatest(F.lit(0.0), in_x, in_y) <= F.least(F.lit(1.0), out_x, out_y)
