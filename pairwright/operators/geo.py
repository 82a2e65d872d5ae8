"""Radius joins through grid cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.geo import EARTH_RADIUS_M, geo_distance
from pairwright.operators.skew import salted_join, spread_tasks

MAX_LEVEL = 16


def radius_level(radius_m: Column) -> Column:
    """The finest grid level whose cells are at least ``radius_m`` high."""
    degrees = F.greatest(F.degrees(radius_m * 1.000001 / F.lit(EARTH_RADIUS_M)), F.lit(1e-9))
    return F.greatest(
        F.lit(0), F.least(F.lit(MAX_LEVEL), F.floor(F.log2(F.lit(360.0) / degrees)))
    ).cast("int")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, so that expressions stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _columns(band: Column, size: Column) -> Column:
    """Cells around one latitude band; no cell is narrower than the band is high.

    The width is taken one band nearer to the pole, so it also holds for circles that start
    in the neighbour band; bands next to a pole are one single cell.
    """
    middle = (band + 0.5) * size - 90.0
    edge = F.abs(middle) + size * 1.5

    def count(ratio: Column) -> Column:
        # at a pole the cosine is (nearly) zero or negative and the ratio leaves (0, 1)
        width = F.degrees(2.0 * F.asin(ratio))
        return F.when((ratio > 0) & (ratio < 1), F.greatest(F.lit(1.0), F.floor(360.0 / width))).otherwise(1.0)

    return _bind(F.when(edge < 90.0, F.sin(F.radians(size) / 2.0) / F.cos(F.radians(edge))), count)


def _column_of(lon: Column, count: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * count), count - 1)


def _cell(level: Column, band: Column, column: Column) -> Column:
    """One number per (level, band, column)."""
    wide = F.lit(1 << 24)
    return (level.cast("bigint") * wide + band.cast("bigint")) * wide + column.cast("bigint")


def _band(lat: Column, size: Column) -> Column:
    return F.floor((lat + 90.0) / size)


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def own_cell(lat: Column, lon: Column, level: Column) -> Column:
    def placed(size: Column) -> Column:
        return _bind(_band(lat, size), lambda band: _cell(
            level, band, _column_of(lon, _columns(band, size))
        ))

    return _bind(_size(level), placed)


def reach_cells(lat: Column, lon: Column, level: Column) -> Column:
    """All cells a circle no larger than a cell can touch, wrapping at 180 degrees."""

    def around(size: Column, band: Column) -> Column:
        def neighbours(count: Column) -> Column:
            return _bind(_column_of(lon, count), lambda own: F.transform(
                F.array(F.lit(-1), F.lit(0), F.lit(1)),
                lambda step: _cell(level, band, F.pmod(own + step, count)),
            ))

        return _bind(_columns(band, size), neighbours)

    def bands(size: Column) -> Column:
        return F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)),
            lambda step: _bind(_band(lat, size) + step, lambda band: around(size, band)),
        )

    return F.array_distinct(F.flatten(_bind(_size(level), bands)))


def levels_in_use(requests: DataFrame, radius_m: Column) -> DataFrame:
    """One row with the distinct grid levels of all requests, at most ``MAX_LEVEL + 1``."""
    return requests.agg(F.collect_set(radius_level(radius_m)).alias("levels"))


def _unit_vector(lat: Column, lon: Column, name: str) -> dict[str, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return {f"{name}x": F.cos(phi) * F.cos(lam), f"{name}y": F.cos(phi) * F.sin(lam), f"{name}z": F.sin(phi)}


def _chord_limits(angle: Column, slack: float) -> tuple[Column, Column]:
    """Squared chords of the unit sphere: up to the first a pair is surely inside the angle, beyond the second surely not.

    Both stand off by more than the rounding of a chord; ``slack`` covers another shape of the earth.
    """
    def squared(wide: Column, share: float, step: float) -> Column:
        chord = 2.0 * F.sin(wide / 2.0) * (1.0 + share) + step
        return chord * chord

    inside = F.when((angle > 1e-12) & (angle < 3.14), squared(angle / slack, -1e-9, -1e-14)).otherwise(F.lit(-1.0))
    outside = F.when((angle >= 0) & (angle * slack < 3.14), squared(angle * slack, 1e-9, 1e-14)).otherwise(F.lit(5.0))
    return inside, outside


def geo_radius_join(
    requests: DataFrame, places: DataFrame, *, lat: str = "latitude", lon: str = "longitude",
    radius_km: str = "radius_km", place_lat: str = "place_latitude",
    place_lon: str = "place_longitude", ellipsoid: bool = False, distance: str = "distance_m",
) -> DataFrame:
    """All (request, place) pairs no farther apart than the request's radius.

    Cells follow the radius, so a large radius is looked up in large cells. Rows with a null
    coordinate never match. The pairs of a cell are told apart by the straight line between two
    points, which needs no angle; the distance itself decides only where that is too close to call.
    """
    radius_m = F.col(radius_km) * 1000.0
    slack = 1.01 if ellipsoid else 1.0
    inside, outside = _chord_limits(radius_m / EARTH_RADIUS_M, slack)
    asked = requests.where(
        F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(radius_km).isNotNull()
    ).withColumn("_level", radius_level(radius_m * slack)).withColumns(
        {"_inside": inside, "_outside": outside, **_unit_vector(F.col(lat), F.col(lon), "_u")})
    levels = levels_in_use(asked, radius_m * slack).scalar()
    asked = asked.withColumn(
        "_cell", F.explode(reach_cells(F.col(lat), F.col(lon), F.col("_level")))
    ).drop("_level")
    known = places.where(F.col(place_lat).isNotNull() & F.col(place_lon).isNotNull()).withColumns(
        _unit_vector(F.col(place_lat), F.col(place_lon), "_v"))
    placed = known.withColumn("_level", F.explode(levels)).withColumn(
        "_cell", own_cell(F.col(place_lat), F.col(place_lon), F.col("_level"))
    ).drop("_level")
    away = geo_distance(F.col(lat), F.col(lon), F.col(place_lat), F.col(place_lon), ellipsoid)
    steps = [F.col(f"_u{axis}") - F.col(f"_v{axis}") for axis in "xyz"]
    line = sum((step * step for step in steps[1:]), steps[0] * steps[0])
    near = F.when(line <= F.col("_inside"), F.lit(True)).when(
        line <= F.col("_outside"), away <= F.col(radius_km) * 1000.0).otherwise(F.lit(False))
    return (
        salted_join(placed, asked, ["_cell"], extra=near, tasks=spread_tasks(placed.sparkSession))
        .withColumn(distance, away)
        .drop("_cell", "_inside", "_outside", *[f"_{side}{axis}" for side in "uv" for axis in "xyz"])
    )


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same distance as SQL text, for checks on other engines."""
    return (
        f"2*{EARTH_RADIUS_M}*asin(sqrt(least(1.0, "
        f"power(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*power(sin((radians({lon2})-radians({lon1}))/2),2))))"
    )


