"""Containment, polygon filling and tiling.

A polygon table has one row per ring: ``unit, part, ring`` with ``ring`` an
``array<struct<lat, lon>>``. Outer rings and holes of one polygon share a
``part``; containment is even-odd per part, so holes need no flag.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark.functions import geo, hexgrid
from dasyspark.operators.joins import claim_once


def ring_edges(polygons: DataFrame, *more: str) -> DataFrame:
    """One row per edge, with the columns ``more`` of its ring; the ring is closed if it is open."""
    closed = F.concat("ring", F.array(F.element_at("ring", 1)))
    pairs = polygons.select("unit", "part", *more, F.inline(geo.segments(closed)).alias("a", "b"))
    edges = pairs.select("unit", "part", *more, *geo.segment_columns())
    return edges.where((F.col("lat1") != F.col("lat2")) | (F.col("lon1") != F.col("lon2")))


def part_boxes(polygons: DataFrame) -> DataFrame:
    boxes = polygons.select("unit", "part", geo.ring_bounds(F.col("ring")).alias("b")).select("unit", "part", "b.*")
    return boxes.groupBy("unit", "part").agg(
        F.min("miny").alias("miny"), F.max("maxy").alias("maxy"),
        F.min("minx").alias("minx"), F.max("maxx").alias("maxx"),
    )


def _slots(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / F.lit(size)), F.floor(high / F.lit(size))))


def _ends() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))


# Where in a band its reference line lies; no vertex on round degrees comes to lie on it.
REFERENCE = 0.41421356237


def _turn(lat: Column, lon: Column) -> Column:
    """Positive left of the directed edge, negative right of it, 0 on its line; no division, so signs are exact enough to agree everywhere."""
    lat1, lon1, lat2, lon2 = _ends()
    return (lon2 - lon1) * (lat - lat1) - (lat2 - lat1) * (lon - lon1)


def _side(lat: Column, lon: Column) -> Column:
    """Whether a place lies left of the edge, for places moved a little north and, far less, west, so that none is on its line."""
    lat1, lon1, lat2, lon2 = _ends()
    turn, dx, dy = _turn(lat, lon), lon2 - lon1, lat2 - lat1
    return F.when(turn != 0, turn > 0).when(dx != 0, dx > 0).otherwise(dy > 0)


def _crosses_line(lat: Column) -> Column:
    lat1, lon1, lat2, lon2 = _ends()
    return (lat1 > lat) != (lat2 > lat)


def _is_west(lat: Column, lon: Column) -> Column:
    """For an edge that crosses the line of ``lat``: whether it does so west of the place."""
    lat1, lon1, lat2, lon2 = _ends()
    return _side(lat, lon) != (lat2 > lat1)


def edge_slots(polygons: DataFrame, band: float, slot: float) -> DataFrame:
    """Every edge once for each (band, slot) box that it may touch."""
    lat1, lon1, lat2, lon2 = _ends()
    edges = ring_edges(polygons).withColumn("_band", _slots(F.least(lat1, lat2), F.greatest(lat1, lat2), band))
    south, north = F.col("_band") * F.lit(band), (F.col("_band") + 1) * F.lit(band)
    dy = lat2 - lat1

    def at(lat: Column) -> Column:
        """Longitude of the edge at a latitude of the band, kept within the edge."""
        return lon1 + (lon2 - lon1) * F.least(F.greatest((lat - lat1) / dy, F.lit(0.0)), F.lit(1.0))

    level = dy == 0
    a, b = F.when(level, lon1).otherwise(at(south)), F.when(level, lon2).otherwise(at(north))
    # A little wider than computed, so that rounding loses no box; an extra one does no harm.
    return edges.withColumn("_slot", _slots(F.least(a, b) - 1e-9, F.greatest(a, b) + 1e-9, slot))


def inside_slots(polygons: DataFrame, band: float, slot: float) -> DataFrame:
    """``unit, part, _band, _slot`` of all boxes whose reference place lies inside the part.

    The place is the west end of the box on the band's reference line. Each edge that
    crosses the line counts from the first slot east of it on; between an odd count and the
    next change lies the inside.
    """
    lat1, lon1, lat2, lon2 = _ends()
    edges = ring_edges(polygons).withColumn("_band", _slots(F.least(lat1, lat2), F.greatest(lat1, lat2), band))
    line = (F.col("_band") + F.lit(REFERENCE)) * F.lit(band)
    met = edges.where(_crosses_line(line))
    near = F.floor((lon1 + (lon2 - lon1) * (line - lat1) / (lat2 - lat1)) / F.lit(slot))
    # Rounding may misplace the crossing by one slot; the sign test decides.
    first = F.coalesce(*[F.when(_is_west(line, (near + k) * F.lit(slot)), near + k) for k in (-1, 0, 1)], near + 2)
    counts = met.groupBy("unit", "part", "_band", first.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("unit", "part", "_band").orderBy("_slot")
    runs = counts.select(
        "unit", "part", "_band", F.col("_slot").alias("_from"), F.lead("_slot").over(along).alias("_to"), F.sum("_n").over(along).alias("_west")
    )
    odd = runs.where((F.col("_west") % 2 == 1) & F.col("_to").isNotNull())
    return odd.select("unit", "part", "_band", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_slot"))


def containing_units(points: DataFrame, polygons: DataFrame, band: float = 0.05, slot: float = 0.05) -> DataFrame:
    """Every ``cell, unit`` pair with the point in or on the unit.

    ``points``: cell (unique), lat, lon. Boxes of ``band`` by ``slot`` degrees index the
    polygons: for each box, whether its reference place lies inside, and the edges that
    touch it. A point meets its own box only, and is inside if an odd number of edges lies
    between it and an inside reference place, or an even one if that is outside: along the
    reference line to the point's longitude, then to its latitude. Both joins are equi-joins
    by box, and the crossings of a point are summed under the point's own key, so that a
    unit, or a band of it, is never a task's share.
    """
    lat1, lon1, lat2, lon2 = _ends()
    lat, lon = F.col("lat"), F.col("lon")
    located = points.select("cell", "lat", "lon", F.floor(lat / band).alias("_band"), F.floor(lon / slot).alias("_slot"))
    line, west = (F.col("_band") + F.lit(REFERENCE)) * F.lit(band), F.col("_slot") * F.lit(slot)
    along = _crosses_line(line) & (_is_west(line, west) != _is_west(line, lon))
    across = ((lon1 >= lon) != (lon2 >= lon)) & (_side(line, lon) != (_turn(lat, lon) > 0))
    touches = (
        (_turn(lat, lon) == 0)
        & lat.between(F.least(lat1, lat2), F.greatest(lat1, lat2))
        & lon.between(F.least(lon1, lon2), F.greatest(lon1, lon2))
    )
    box = ["_band", "_slot"]
    met = located.join(edge_slots(polygons, band, slot), box).select(
        "cell", "unit", "part", (along.cast("int") + across.cast("int")).alias("_n"), touches.alias("_on")
    )
    base = located.join(inside_slots(polygons, band, slot), box).select("cell", "unit", "part", F.lit(1).alias("_n"), F.lit(False).alias("_on"))
    parity = met.unionByName(base).groupBy("cell", "unit", "part").agg(F.sum("_n").alias("_n"), F.max("_on").alias("_on"))
    return parity.where((F.col("_n") % 2 == 1) | F.col("_on")).select("cell", "unit").distinct()


def pip_join(points: DataFrame, polygons: DataFrame, band: float = 0.05, slot: float = 0.05) -> DataFrame:
    """Unit of each point; a point that several units hold goes to the first name."""
    return claim_once(containing_units(points, polygons, band, slot))


def fill_spans(polygons: DataFrame, level: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, unit, r, q0, q1``: runs of cells in a grid row whose centres lie in or on a unit.

    Scan lines: the edges that cross the latitude of a row are sorted by where they do, and
    what lies between an odd one and the next is inside.
    """
    lat1, lon1, lat2, lon2 = _ends()
    s, radius = hexgrid.side_km(level), F.lit(hexgrid.RADIUS_KM)
    width, height = s * math.sqrt(3), s * 1.5
    low, high = (F.sin(F.radians(f(lat1, lat2))) * radius / height for f in (F.least, F.greatest))
    # One row more on both sides, as the sign tests below decide.
    rows = ring_edges(polygons, *keys).withColumn("r", F.explode(F.sequence((F.ceil(low) - 1).cast("long"), (F.floor(high) + 1).cast("long"))))
    line = hexgrid.plane_to_latlon(*hexgrid.axial_center(F.lit(0), F.col("r"), level))[0]

    def lon_of(q: Column) -> Column:
        return hexgrid.plane_to_latlon(*hexgrid.axial_center(q, F.col("r"), level))[1]

    def q_at(lon: Column) -> Column:
        return F.floor(F.radians(lon) * radius / width - F.col("r") / F.lit(2.0)).cast("long")

    rows = rows.withColumn("_lat", line)
    lat = F.col("_lat")
    met = rows.where(_crosses_line(lat)).withColumn("_x", lon1 + (lon2 - lon1) * (lat - lat1) / (lat2 - lat1)).withColumn("_q", q_at(F.col("_x")))
    # The first centre on or east of the edge, and the last one on or west of it.
    def is_east(q: Column) -> Column:
        turn = _turn(lat, lon_of(q))
        return (turn == 0) | ((turn < 0) == (lat2 > lat1))

    def is_west(q: Column) -> Column:
        turn = _turn(lat, lon_of(q))
        return (turn == 0) | ((turn > 0) == (lat2 > lat1))

    q = F.col("_q")
    start = F.coalesce(*[F.when(is_east(q + k), q + k) for k in (-1, 0, 1)], q + 2)
    end = F.coalesce(*[F.when(is_west(q + k), q + k) for k in (2, 1, 0)], q - 1)
    along = Window.partitionBy(*keys, "unit", "part", "r").orderBy("_x", "lat1", "lon1", "lat2", "lon2")
    cut = met.select(*keys, "unit", "part", "r", start.alias("q0"), F.lead(end).over(along).alias("q1"), F.row_number().over(along).alias("_i"))
    spans = cut.where(F.col("_i") % 2 == 1).select(*keys, "unit", "r", "q0", "q1")
    # Level edges cross no line, yet centres may lie on them.
    level_edges = rows.where((lat1 == lat2) & (lat1 == lat))
    a, b = F.least(lon1, lon2), F.greatest(lon1, lon2)
    first = F.coalesce(*[F.when(lon_of(q_at(a) + k) >= a, q_at(a) + k) for k in (-1, 0, 1)], q_at(a) + 2)
    last = F.coalesce(*[F.when(lon_of(q_at(b) + k) <= b, q_at(b) + k) for k in (2, 1, 0)], q_at(b) - 1)
    flat = level_edges.select(*keys, "unit", "r", first.alias("q0"), last.alias("q1"))
    # A vertex or edge of its own may hold a centre that no span reaches.
    touched = met.where(start <= end).select(*keys, "unit", "r", start.alias("q0"), end.alias("q1"))
    return spans.unionByName(flat).unionByName(touched).where(F.col("q0") <= F.col("q1"))


def polyfill(polygons: DataFrame, level: int, keys: Sequence[str] = ()) -> DataFrame:
    """All cells whose centre lies in a unit, or on its outline: ``cell, keys, unit, lat, lon``.

    ``keys`` name a unit together with ``unit``, such as its territory. A cell in several
    units goes to the first of these names. Cells come straight from spans of grid
    rows (``fill_spans``); long spans are spread over tasks before they are widened.
    """
    spans = fill_spans(polygons, level, keys).repartition("unit", "r", "q0")
    cells = spans.select(*keys, "unit", "r", F.explode(F.sequence("q0", "q1")).alias("q"))
    claimed = cells.groupBy("q", "r").agg(F.min(F.struct(*keys, "unit")).alias("_u"))
    lat, lon = hexgrid.plane_to_latlon(*hexgrid.axial_center(F.col("q"), F.col("r"), level))
    own = [F.col(f"_u.{k}").alias(k) for k in (*keys, "unit")]
    return claimed.select(hexgrid.pack(level, F.col("q"), F.col("r")).alias("cell"), *own, lat.alias("lat"), lon.alias("lon"))


def area_centroids(polygons: DataFrame) -> DataFrame:
    """``unit, lat, lon``: the area centroid of all parts of a unit.

    The winding of rings does not matter: of the rings of a part the largest is its
    outline and the others are holes.
    """
    lat1, lon1, lat2, lon2 = _ends()
    cross = lon1 * lat2 - lon2 * lat1
    ring = ring_edges(polygons.withColumn("_ring", F.xxhash64("ring")), "_ring").groupBy("unit", "part", "_ring").agg(
        F.sum(cross).alias("a"), F.sum((lon1 + lon2) * cross).alias("x"), F.sum((lat1 + lat2) * cross).alias("y")
    )
    # Turn every ring the same way; the outline of a part then counts twice against all rings taken off once.
    turned = ring.select("unit", "part", F.abs("a").alias("a"), *[(F.signum("a") * F.col(c)).alias(c) for c in ("x", "y")])
    parts = turned.groupBy("unit", "part").agg(
        F.max(F.struct("a", "x", "y")).alias("o"), *[F.sum(c).alias(f"_{c}") for c in ("a", "x", "y")]
    )
    moments = parts.groupBy("unit").agg(*[F.sum(F.col(f"o.{c}") * 2 - F.col(f"_{c}")).alias(f"_{c}") for c in ("a", "x", "y")])
    thrice = F.nullif(F.col("_a") * 3, F.lit(0.0))
    return moments.select("unit", (F.col("_y") / thrice).alias("lat"), (F.col("_x") / thrice).alias("lon"))


def filter_units_in_area(polygons: DataFrame, area: DataFrame) -> DataFrame:
    """Keep the units whose area centroid lies inside ``area`` (polygons of one territory)."""
    centroids = area_centroids(polygons).withColumnRenamed("unit", "cell")
    inside = containing_units(centroids, area).select(F.col("cell").alias("unit"))
    return polygons.join(inside.distinct(), "unit", "left_semi")


def dissolve_units(polygons: DataFrame, single: str | None = None) -> DataFrame:
    """Parts under one name become one unit; ``single`` merges everything.

    Containment tests each part by itself, so merging is a relabelling: parts
    get ids that stay distinct within the merged unit.
    """
    unit = F.lit(single) if single else F.col("unit")
    return polygons.select(
        unit.alias("unit"), F.concat_ws("/", F.col("source").cast("string"), F.col("part").cast("string")).alias("part"), "ring"
    )


def tile_bbox(boxes: DataFrame, step: float) -> DataFrame:
    """Split ``south, west, north, east`` into tiles; the last ones are clipped."""

    def starts(low: str, high: str) -> Column:
        count = F.ceil((F.col(high) - F.col(low)) / F.lit(step))
        return F.explode(F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0))))

    gridded = boxes.withColumn("row", starts("south", "north")).withColumn("col", starts("west", "east"))
    south, west = F.col("south") + F.col("row") * F.lit(step), F.col("west") + F.col("col") * F.lit(step)
    return gridded.withColumns(
        {
            "tile_south": south,
            "tile_west": west,
            "tile_north": F.least(south + F.lit(step), F.col("north")),
            "tile_east": F.least(west + F.lit(step), F.col("east")),
        }
    )


def extent(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"),
    )
