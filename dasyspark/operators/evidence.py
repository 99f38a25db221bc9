"""Binning evidence onto cells: fine grids, pixels and mapped elements.

An element has ``type, id, lat, lon, tags: map, geometry: array<struct<lat, lon>>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions import geo, h3id, hexgrid
from dasyspark.functions.numbers import safe_density, safe_ratio_clip
from dasyspark.operators.joins import lookup_fill

Bbox = tuple[float, float, float, float]  # minx, miny, maxx, maxy

# ------------------------------------------------------------------ fine grids


def filter_finer_than_grid(grid: DataFrame, level: int, h3: str = "h3") -> DataFrame:
    """Drop ids coarser than the grid: a value is never split downward."""
    return grid.where(F.col(h3).isNotNull() & (h3id.cell_resolution(F.col(h3)) >= level))


def assert_single_resolution(grid: DataFrame, h3: str = "h3") -> int:
    """The one resolution that all ids share; mixed ids anywhere in the table raise."""
    resolution = h3id.cell_resolution(F.col(h3))
    low, high = grid.where(F.col(h3).isNotNull()).agg(F.min(resolution), F.max(resolution)).first()
    if low is None or low != high:
        raise ValueError(f"ids have mixed or no resolution: {low} to {high}")
    return low


def rollup_population(children: DataFrame, parent: str = "parent", value: str = "population") -> DataFrame:
    return children.groupBy(parent).agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("population"), F.count(F.lit(1)).alias("children")
    )


def rollup_lights(
    children: DataFrame, parent: str = "parent", value: str = "night_lights", weight: str | None = "pixel_count"
) -> DataFrame:
    """Mean weighted by pixel count; a missing or zero weight counts as one pixel."""
    w = F.lit(1.0)
    if weight is not None and weight in children.columns:
        given = F.col(weight).cast("double")
        w = F.when(given != 0, given).otherwise(F.lit(1.0))
    known = children.where(F.col(value).isNotNull())
    return known.groupBy(parent).agg(
        (F.sum(F.col(value) * w) / F.sum(w)).alias("night_lights"), F.sum(w).alias("ntl_pixels")
    )


def h3_population(grid: DataFrame, level: int) -> DataFrame:
    """Population of a finer id grid rolled up to ``level``."""
    kept = filter_finer_than_grid(grid, level)
    return rollup_population(kept.withColumn("parent", h3id.cell_parent(F.col("h3"), level)))


def h3_lights(grid: DataFrame, level: int) -> DataFrame:
    kept = filter_finer_than_grid(grid, level)
    return rollup_lights(kept.withColumn("parent", h3id.cell_parent(F.col("h3"), level)))


# -------------------------------------------------------------------- pixels


def bin_pixels(pixels: DataFrame, level: int) -> DataFrame:
    """Sum, mean and count of pixel values (``x, y, value``) per cell."""
    cell = hexgrid.point_to_cell(F.col("y"), F.col("x"), level)
    return pixels.groupBy(cell.alias("cell")).agg(
        F.sum("value").alias("pixel_sum"), F.avg("value").alias("pixel_mean"), F.count(F.lit(1)).alias("pixels")
    )


def lights_coverage(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    lit = F.col("night_lights") > 0
    return cells.groupBy(*by).agg(
        F.avg(lit.cast("double")).alias("lit_share"),
        F.avg("night_lights").alias("mean_lights"),
        F.max("night_lights").alias("max_lights"),
        F.count_if(~lit).alias("n_missing"),
    )


def population_sanity(cells: DataFrame, ranges: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """Totals against half the low and 1.6 times the high expectation (millions)."""
    sums = cells.groupBy(*by).agg(F.sum("population").alias("total")).join(ranges, list(by))
    ok = F.col("total").between(F.col("pop_lo") * F.lit(0.5e6), F.col("pop_hi") * F.lit(1.6e6))
    return sums.withColumn("verdict", F.when(ok, "ok").otherwise("warn"))


# ------------------------------------------------------------------- elements


def has_any_key(tags: Column, keys: Sequence[str] = C.OSM_KEYS) -> Column:
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in keys]))


def filter_bbox(elements: DataFrame, bbox: Bbox) -> DataFrame:
    """Nodes inside the box (borders included); ways unless their envelope is apart."""
    minx, miny, maxx, maxy = (F.lit(v) for v in bbox)
    box = geo.ring_bounds(F.col("geometry"))
    way = (box["maxx"] >= minx) & (box["minx"] <= maxx) & (box["maxy"] >= miny) & (box["miny"] <= maxy)
    node = F.col("lon").between(minx, maxx) & F.col("lat").between(miny, maxy)
    return elements.where(F.when(F.col("type") == "way", way).when(F.col("type") == "node", node))


def positioned(elements: DataFrame) -> DataFrame:
    """Position of each element: its own, else the mean of its vertices."""
    centre = geo.ring_centroid(F.col("geometry"))
    return elements.withColumns(
        {"lat": F.coalesce(F.col("lat"), centre["lat"]), "lon": F.coalesce(F.col("lon"), centre["lon"])}
    )


def is_road(tags: Column) -> Column:
    return F.coalesce(tags["highway"].isin(*C.ROAD_CLASSES), F.lit(False))


def poi_hit(tags: Column, group: str) -> Column:
    key, values = C.POI_GROUPS[group]
    raw = tags[key]
    hit = F.lower(raw).isin(*values) if values else raw != ""
    return F.coalesce(hit, F.lit(False))


def any_poi(tags: Column) -> Column:
    """Whether the tags match any group."""
    return reduce(or_, [poi_hit(tags, g) for g in C.POI_GROUPS])


def classify_poi(tags: Column) -> Column:
    """All groups that the tags match, in configured order."""
    return F.array_compact(F.array(*[F.when(poi_hit(tags, g), F.lit(g)) for g in C.POI_GROUPS]))


def landuse_class(tags: Column) -> Column:
    value = F.lower(tags["landuse"])
    return F.when(value.isin(*C.LANDUSE_CLASSES), value)


def road_segments(elements: DataFrame, level: int) -> DataFrame:
    """Road segments by the cell of their midpoint, with length."""
    roads = elements.where((F.col("type") == "way") & is_road(F.col("tags")))
    pieces = roads.select("id", F.inline(geo.segments(F.col("geometry"))).alias("a", "b")).select("id", *geo.segment_columns())
    return pieces.select(
        "id",
        hexgrid.point_to_cell(F.col("mid_lat"), F.col("mid_lon"), level).alias("cell"),
        geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"),
    )


def road_length(elements: DataFrame, level: int) -> DataFrame:
    return road_segments(elements, level).groupBy("cell").agg(
        F.sum("km").alias("road_km"), F.count(F.lit(1)).alias("road_segments")
    )


def _ways_with_area(elements: DataFrame, level: int, wanted: Column) -> DataFrame:
    ways = positioned(elements.where((F.col("type") == "way") & wanted))
    return ways.select(
        "id", "tags",
        hexgrid.point_to_cell(F.col("lat"), F.col("lon"), level).alias("cell"),
        geo.ring_area_m2(F.col("geometry")).alias("m2"),
    )


def building_footprint(elements: DataFrame, level: int) -> DataFrame:
    ways = _ways_with_area(elements, level, F.map_contains_key("tags", "building"))
    # Flat rings add nothing; filtering them first would compute every area twice.
    sums = ways.groupBy("cell").agg(F.sum("m2").alias("building_area_m2"), F.count_if(F.col("m2") > 0).alias("building_count"))
    return sums.where(F.col("building_count") > 0)


def landuse_area(elements: DataFrame, level: int) -> DataFrame:
    ways = _ways_with_area(elements, level, landuse_class(F.col("tags")).isNotNull())
    of_class = {c: F.when(landuse_class(F.col("tags")) == c, F.col("m2")).otherwise(0.0) for c in C.LANDUSE_CLASSES}
    sums = ways.groupBy("cell").agg(*[F.sum(v).alias(f"landuse_{c}_m2") for c, v in of_class.items()])
    return sums.where(reduce(or_, [F.col(f"landuse_{c}_m2") > 0 for c in C.LANDUSE_CLASSES]))


def poi_counts(elements: DataFrame, level: int) -> DataFrame:
    """Elements per cell that match any group, and per group."""
    tags = F.col("tags")
    matched = positioned(elements.where(any_poi(tags)))
    cell = hexgrid.point_to_cell(F.col("lat"), F.col("lon"), level)
    return matched.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("poi_count"), *[F.count_if(poi_hit(tags, g)).alias(f"poi_{g}") for g in C.POI_GROUPS]
    )


HOME_MEASURES = (
    ["building_area_m2", "building_count"]
    + [f"landuse_{c}_m2" for c in C.LANDUSE_CLASSES]
    + [f"landuse_{c}_count" for c in C.LANDUSE_CLASSES]
    + ["poi_count"]
    + [f"poi_{g}" for g in C.POI_GROUPS]
)
MEASURES = ["road_km", "road_segments", *HOME_MEASURES]


def home_measures(elements: DataFrame, level: int) -> DataFrame:
    """Buildings, land use and POIs per cell of the element itself: one row for each element, one partial sum."""
    tags, way = F.col("tags"), F.col("type") == "way"
    building, landuse = F.map_contains_key(tags, "building"), landuse_class(tags)
    wide = positioned(elements).select(
        hexgrid.point_to_cell(F.col("lat"), F.col("lon"), level).alias("cell"),
        building.alias("_building"), landuse.alias("_class"), *[poi_hit(tags, g).alias(f"_{g}") for g in C.POI_GROUPS],
        F.when(way & (building | landuse.isNotNull()), geo.ring_area_m2(F.col("geometry"))).otherwise(F.lit(0.0)).alias("_m2"),
    )
    area = F.col("_m2")
    solid = area > 0
    # From the columns, not from the tags again: the planner compares every alias with every expression.
    matched = reduce(or_, [F.col(f"_{g}") for g in C.POI_GROUPS])
    measures = {
        "building_area_m2": F.when(F.col("_building"), area), "building_count": F.when(F.col("_building") & solid, 1.0),
        **{f"landuse_{c}_m2": F.when(F.col("_class") == c, area) for c in C.LANDUSE_CLASSES},
        **{f"landuse_{c}_count": F.when((F.col("_class") == c) & solid, 1.0) for c in C.LANDUSE_CLASSES},
        "poi_count": F.when(matched, 1.0), **{f"poi_{g}": F.when(F.col(f"_{g}"), 1.0) for g in C.POI_GROUPS},
    }
    # What has no position gathers in NO_CELL, which no cell table holds.
    return wide.groupBy("cell").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for n, v in measures.items()])


def join_measures(homes: DataFrame, roads: DataFrame) -> DataFrame:
    """``home_measures`` and ``road_length`` in one table."""
    return homes.join(roads, "cell", "full").na.fill(0.0, MEASURES).na.fill(0, ["road_segments"])


def bin_elements(elements: DataFrame, level: int) -> DataFrame:
    """All element measures per cell, from two narrow aggregates: elements where they lie, road segments where theirs do."""
    return join_measures(home_measures(elements, level), road_length(elements, level)).select("cell", *MEASURES)


def bin_with_counters(elements: DataFrame, level: int, valid: DataFrame) -> tuple[DataFrame, Callable[[], dict]]:
    """Measures of the ``valid`` cells, and a function that tells the counters of that same run, once it is through.

    Counters are observed while the rows stream by: elements in the scan, everything else on the
    binned cells. ``landuse_<class>`` counts areas, ``cells_with_...`` cells. The table has to be
    written or collected once before they are known.
    """
    scanned, binned = Observation(), Observation()
    seen = elements.observe(scanned, F.count(F.lit(1)).alias("objects_scanned"))
    homes = home_measures(seen, level)
    table = join_measures(homes, road_length(elements, level))
    kept = table.join(valid.select("cell"), "cell", "left_semi").select("cell", *MEASURES)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    counters = {
        "road_segments": total("road_segments"), "buildings": total("building_count"),
        **{f"landuse_{c}": total(f"landuse_{c}_count") for c in C.LANDUSE_CLASSES}, "pois": total("poi_count"),
        "cells_with_buildings": F.count_if(F.col("building_count") > 0), "cells_with_pois": F.count_if(F.col("poi_count") > 0),
        "cells_with_roads": F.count_if(F.col("road_segments") > 0),
    }
    watched = kept.observe(binned, *[v.alias(n) for n, v in counters.items()])
    return watched, lambda: scanned.get | binned.get


def finalise_cell_features(cells: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures, shares and densities on the cell table; a cell without evidence gets zeros."""
    filled = lookup_fill(cells, measures, "cell", MEASURES)
    area = F.col("area_km2")
    derived = {f"landuse_{c}": safe_ratio_clip(F.col(f"landuse_{c}_m2"), area) for c in C.LANDUSE_CLASSES}
    derived["building_share"] = safe_ratio_clip(F.col("building_area_m2"), area)
    derived |= {f"poi_{g}_density": safe_density(F.col(f"poi_{g}"), area) for g in C.POI_GROUPS}
    return filled.withColumns(derived)
