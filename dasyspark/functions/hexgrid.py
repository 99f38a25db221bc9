"""Equal-area hexagonal grid in plain arithmetic.

Longitude and the sine of latitude span a cylindrical equal-area plane, tiled
by pointy-top hexagons addressed by axial coordinates ``(q, r)``. The cell area
of level L is 1/7 of level L-1. A cell id packs ``level, q, r`` into a bigint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.007181
_OFFSET = 1 << 27
_BASE = 1 << 28
NO_CELL = -1
NEIGHBOUR_OFFSETS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def cell_area(level: int) -> float:
    """Cell area in km2, the same for every cell of a level."""
    return 4 * math.pi * RADIUS_KM**2 / (120 * 7**level)


def side_km(level: int) -> float:
    return math.sqrt(cell_area(level) * 2 / (3 * math.sqrt(3)))


def pack(level: int, q: Column, r: Column) -> Column:
    return (
        F.lit(level * _BASE * _BASE).cast("bigint")
        + (q.cast("bigint") + F.lit(_OFFSET)) * F.lit(_BASE)
        + (r.cast("bigint") + F.lit(_OFFSET))
    )


def axial(cell: Column) -> tuple[Column, Column]:
    q = F.pmod(F.shiftright(cell, 28), F.lit(_BASE)) - F.lit(_OFFSET)
    r = F.pmod(cell, F.lit(_BASE)) - F.lit(_OFFSET)
    return q, r


def cell_level(cell: Column) -> Column:
    return F.shiftright(cell, 56).cast("int")


def _nearest(level: int, q: Column, r: Column) -> Column:
    """Cell nearest to fractional axial coordinates; -1 without a position.

    A hexagon is the set of points whose three coordinate differences lie within
    one of its centre's, so floors of two differences fix each coordinate. Each
    input occurs four times only, which keeps nested cell formulas small, and the
    result is never null: null checks that joins infer would otherwise repeat the
    whole formula in the filters below.
    """
    whole_q = F.floor((F.floor(q - r + F.lit(1.0)) + F.floor(q + q + r + F.lit(1.0))) / F.lit(3.0))
    whole_r = F.floor((F.floor(r - q + F.lit(1.0)) + F.floor(r + r + q + F.lit(1.0))) / F.lit(3.0))
    return F.coalesce(pack(level, whole_q, whole_r), F.lit(NO_CELL).cast("bigint"))


def plane_to_cell(x: Column, y: Column, level: int) -> Column:
    """Cell of a point on the plane (km)."""
    s = side_km(level)
    return _nearest(level, x * F.lit(math.sqrt(3) / 3 / s) - y * F.lit(1 / 3 / s), y * F.lit(2 / 3 / s))


def point_to_cell(lat: Column, lon: Column, level: int) -> Column:
    x = F.radians(lon) * F.lit(RADIUS_KM)
    y = F.sin(F.radians(lat)) * F.lit(RADIUS_KM)
    return plane_to_cell(x, y, level)


def plane_center(cell: Column, level: int) -> tuple[Column, Column]:
    q, r = axial(cell)
    return axial_center(q, r, level)


def axial_center(q: Column, r: Column, level: int) -> tuple[Column, Column]:
    s = side_km(level)
    return F.lit(s * math.sqrt(3)) * (q + r / F.lit(2.0)), F.lit(s * 1.5) * r


def plane_to_latlon(x: Column, y: Column) -> tuple[Column, Column]:
    sine = F.least(F.greatest(y / F.lit(RADIUS_KM), F.lit(-1.0)), F.lit(1.0))
    return F.degrees(F.asin(sine)), F.degrees(x / F.lit(RADIUS_KM))


def cell_center(cell: Column, level: int) -> tuple[Column, Column]:
    """Latitude and longitude of the centre."""
    return plane_to_latlon(*plane_center(cell, level))


def cell_parent(cell: Column, level: int, parent_level: int) -> Column:
    """The coarser cell that holds the centre of ``cell``, one level at a time.

    Going level by level keeps ancestors nested: the grandparent is the parent
    of the parent.
    """
    # Grids of all levels share origin and orientation: the axial coordinates only scale.
    q, r = axial(cell)
    shrink = F.lit(side_km(level) / side_km(level - 1))
    parent = _nearest(level - 1, q * shrink, r * shrink)
    if level - 1 == parent_level:
        return parent
    # The one-element array binds the parent, so its formula is not repeated.
    return F.transform(F.array(parent), lambda c: cell_parent(c, level - 1, parent_level))[0]


def cell_neighbors(cell: Column, level: int) -> Column:
    q, r = axial(cell)
    return F.array(*[pack(level, q + dq, r + dr) for dq, dr in NEIGHBOUR_OFFSETS])


def cell_boundary(cell: Column, level: int) -> Column:
    """Closed ring of ``struct(lat, lon)`` corners, for drawing."""
    x, y = plane_center(cell, level)
    s = side_km(level)
    corners = []
    for k in [*range(6), 0]:
        angle = math.radians(60 * k - 30)
        lat, lon = plane_to_latlon(x + F.lit(s * math.cos(angle)), y + F.lit(s * math.sin(angle)))
        corners.append(F.struct(lat.alias("lat"), lon.alias("lon")))
    return F.array(*corners)
