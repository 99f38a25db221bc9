"""Distances, areas and centroids as Column expressions.

A geometry is an ``array<struct<lat: double, lon: double>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dasyspark import config as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * C.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def authalic(sine: Column) -> Column:
    """Sine of the authalic latitude from the sine of the latitude: equal-area on WGS84.

    The closed form is a power series in the squared eccentricity, summed here
    up to terms below 1e-15.
    """
    e2 = C.WGS84_ECCENTRICITY**2
    terms = [e2**k * (2 * k + 2) / (2 * k + 1) for k in range(8)]
    pole = sum(terms)
    square = sine * sine
    total = F.lit(terms[-1] / pole)
    for term in reversed(terms[:-1]):
        total = total * square + F.lit(term / pole)
    return sine * total


def ring_area_m2(ring: Column) -> Column:
    """Absolute area of a ring; closed if open; fewer than three vertices give 0."""
    sines = F.transform(
        ring, lambda v: F.struct(F.radians(v["lon"]).alias("x"), F.sin(F.radians(v["lat"])).alias("s"))
    )
    points = F.transform(sines, lambda p: F.struct(p["x"].alias("x"), authalic(p["s"]).alias("y")))
    return F.when(F.size(ring) >= 3, _shoelace(points)).otherwise(F.lit(0.0))


def _shoelace(points: Column) -> Column:
    steps = F.size(points) - 1
    inner = F.zip_with(
        F.slice(points, F.lit(1), steps), F.slice(points, F.lit(2), steps),
        lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]),
    )
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    closing = (first["x"] - last["x"]) * (first["y"] + last["y"])
    return F.abs(F.aggregate(inner, closing, lambda acc, p: acc + p)) * F.lit(C.AUTHALIC_RADIUS_M**2 / 2)


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices as given (a closing vertex counts twice); null if empty."""

    def mean(field: str) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, v: acc + v[field]) / F.size(ring)

    return F.when(F.size(ring) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def ring_bounds(ring: Column) -> Column:
    lats, lons = F.transform(ring, lambda v: v["lat"]), F.transform(ring, lambda v: v["lon"])
    return F.struct(
        F.array_min(lats).alias("miny"), F.array_max(lats).alias("maxy"),
        F.array_min(lons).alias("minx"), F.array_max(lons).alias("maxx"),
    )


def segments(line: Column) -> Column:
    """Consecutive vertex pairs as ``struct<a, b>``."""
    steps = F.greatest(F.size(line) - 1, F.lit(0))
    heads, tails = F.slice(line, F.lit(1), steps), F.slice(line, F.lit(2), steps)
    return F.arrays_zip(heads.alias("a"), tails.alias("b"))


def segment_columns(a: str = "a", b: str = "b") -> list[Column]:
    """``lat1, lon1, lat2, lon2, mid_lat, mid_lon`` of exploded segments."""
    lat1, lon1, lat2, lon2 = F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon")
    return [
        lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"),
        ((lat1 + lat2) * 0.5).alias("mid_lat"), ((lon1 + lon2) * 0.5).alias("mid_lon"),
    ]
