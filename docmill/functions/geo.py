"""Distances on the sphere and points in polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import named
from .values import BOOL, DOUBLE, QueryError, Value, field_of, number

#: Metres.
EARTH_RADIUS = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def point(v: Value) -> tuple[Column, Column]:
    """Latitude and longitude of {lat, lon|lng|longitude} or [lat, lon]; null where there are none."""
    if v.is_array:
        return F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double")
    if isinstance(v.type, (T.StructType, T.MapType)):
        names = v.type.fieldNames() if isinstance(v.type, T.StructType) else ["lat", "lon"]
        lat = next((n for n in ("lat", "latitude") if n in names), None)
        lon = next((n for n in ("lon", "lng", "longitude") if n in names), None)
        if lat and lon:
            return field_of(v, lat).col.cast("double"), field_of(v, lon).col.cast("double")
    raise QueryError("a point is {lat, lon} or [lat, lon]")


@named("DISTANCE", least=4, most=4)
def _distance(ctx, a, b, c, d):
    return Value(haversine(*(number(x, "DISTANCE") for x in (a, b, c, d))), DOUBLE)


@named("GEO_DISTANCE", least=2, most=2)
def _geo_distance(ctx, a, b):
    return Value(haversine(*point(a), *point(b)), DOUBLE)


def vertices(v: Value) -> Column:
    """Polygon corners as (x: longitude, y: latitude). Corner arrays are [lon, lat], unlike points."""
    if not v.is_array:
        raise QueryError("a polygon is an array of points")
    if isinstance(v.element, T.ArrayType):
        return F.transform(v.col, lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y")))

    def corner(p):
        lat, lon = point(Value(p, v.element))
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(v.col, corner)


@named("GEO_WITHIN", least=2, most=2)
def _within(ctx, p, polygon):
    """Ray casting: an odd number of edges to one side. Fewer than three corners hold nothing."""
    lat, lon = point(p)
    corners = vertices(polygon)
    before = F.concat(F.slice(corners, -1, 1), corners)
    edges = F.zip_with(F.slice(before, F.lit(1), F.size(corners)), corners, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(e):
        a, b = e["a"], e["b"]
        spans = (a["y"] > lat) != (b["y"] > lat)
        return spans & (lon < F.try_divide((b["x"] - a["x"]) * (lat - a["y"]), b["y"] - a["y"]) + a["x"])

    hits = F.size(F.filter(edges, crossed))
    return Value(F.coalesce(F.when(F.size(corners) >= 3, hits % 2 == 1), F.lit(False)), BOOL)
