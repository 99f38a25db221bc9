"""Fine grids, pixels and mapped elements binned onto cells."""

from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions import hexgrid
from dasyspark.operators import evidence, joins
from dasyspark.session import materialize, scratch_path
from dasyspark.sources import grids
from registry.core import CELLS, ELEMENTS, FINE_GRID, HEXCELLS, LEVEL, cell_sql, cells, elements, fine_grid, hexcells
from registry.core import num, query, table, tiles, with_ctes
from registry.space import AREAS, _haversine_sql

ROAD = "highway IN (" + ", ".join(f"'{c}'" for c in C.ROAD_CLASSES) + ")"
LAND = "lower(landuse) IN (" + ", ".join(f"'{c}'" for c in C.LANDUSE_CLASSES) + ")"


def _poi_sql(group):
    key, values = C.POI_GROUPS[group]
    if key not in ("amenity", "shop", "office"):
        return "false"
    if not values:
        return f"coalesce({key} <> '', false)"
    return f"coalesce(lower({key}) IN ({', '.join(repr(v) for v in values)}), false)"


POI = {g: _poi_sql(g) for g in C.POI_GROUPS}
ANY_POI = "(" + " OR ".join(v for v in POI.values() if v != "false") + ")"

# ------------------------------------------------------------------ fine grids


@query("rollup_population", with_ctes(
    "SELECT parent7 AS parent, round(sum(coalesce(population, 0e0)), 2) AS population, count(*) AS children FROM fine_grid WHERE res >= 7 GROUP BY parent7", FINE_GRID))
def _(spark, sf):
    out = evidence.h3_population(fine_grid(spark, sf), 7)
    return out.select("parent", F.round("population", 2).alias("population"), "children")


@query("rollup_lights", with_ctes(
    """SELECT parent7 AS parent, round(sum(night_lights * w) / sum(w), 11) AS night_lights, sum(w) AS ntl_pixels FROM
    (SELECT *, CASE WHEN pixel_count <> 0 THEN pixel_count ELSE 1e0 END AS w FROM fine_grid WHERE res >= 7) GROUP BY parent7""", FINE_GRID))
def _(spark, sf):
    out = evidence.h3_lights(fine_grid(spark, sf), 7)
    return out.select("parent", F.round("night_lights", 11).alias("night_lights"), "ntl_pixels")


@query("scan_lights_projection", with_ctes("SELECT h3, night_lights, pixel_count FROM fine_grid", FINE_GRID))
def _(spark, sf):
    path = scratch_path(spark, "lights")
    wide = fine_grid(spark, sf).withColumnsRenamed({"h3": "h3_index", "night_lights": "nightlight_mean"})
    wide.withColumns({"median": F.lit(0.0), "std": F.lit(1.0)}).write.parquet(path)
    return grids.scan_lights_projection(spark, path, value="nightlight_sum")


# ---------------------------------------------------------------------- pixels

_TRANSFORM = (0.25, 0.0, 68.0, 0.0, -0.125, 36.0)
_BBOX = (70.0, 9.0, 86.0, 33.5)
_PIXELS = """pixels AS (SELECT l_orderkey % 230 AS row, l_partkey % 90 AS col, CASE WHEN l_linenumber = 6 THEN -9999e0 WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS value FROM lineitem),
band AS (SELECT 68e0 + (col + 0.5e0) * 0.25e0 AS x, 36e0 + (row + 0.5e0) * -0.125e0 AS y, value FROM pixels WHERE value IS NOT NULL AND value <> -9999),
window_px AS (SELECT * FROM band WHERE x BETWEEN 70 AND 86 AND y BETWEEN 9 AND 33.5)"""


def _band(spark, sf):
    line = F.col("l_linenumber")
    value = F.when(line == 6, -9999.0).when(line == 7, float("nan")).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 230).alias("row"), (F.col("l_partkey") % 90).alias("col"), value.alias("value"))


def _pixels(spark, sf):
    return grids.scan_pixels(_band(spark, sf), _TRANSFORM, _BBOX, nodata=-9999.0)


@query("scan_pixels", with_ctes("SELECT x, y, count(*) AS n, sum(value) AS total FROM window_px GROUP BY x, y", _PIXELS))
def _(spark, sf):
    return _pixels(spark, sf).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_BINNED = f"binned AS (SELECT {cell_sql('w.y', 'w.x', LEVEL)} AS cell, value FROM window_px w)"


@query("raster_sum", with_ctes("SELECT cell, sum(value) AS population FROM binned GROUP BY cell", _PIXELS, _BINNED))
def _(spark, sf):
    return evidence.bin_pixels(_pixels(spark, sf), LEVEL).select("cell", F.col("pixel_sum").alias("population"))


@query("raster_mean", with_ctes("SELECT cell, round(sum(value) / count(*), 8) AS night_lights, count(*) AS pixels FROM binned GROUP BY cell", _PIXELS, _BINNED))
def _(spark, sf):
    return evidence.bin_pixels(_pixels(spark, sf), LEVEL).select("cell", F.round("pixel_mean", 8).alias("night_lights"), "pixels")


@query("assert_coverage", with_ctes("SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, true AS covered FROM window_px", _PIXELS))
def _(spark, sf):
    return grids.assert_coverage(_pixels(spark, sf), _BBOX, "pixel band")


@query("lights_coverage", with_ctes(
    """SELECT state, round(avg((night_lights > 0)::INT), 8) AS lit_share, round(avg(night_lights), 8) AS mean_lights, round(max(night_lights), 8) AS max_lights,
    count(*) FILTER (NOT night_lights > 0) AS n_missing FROM cells GROUP BY state""", CELLS))
def _(spark, sf):
    base = cells(spark, sf)
    grids.assert_any_lit(base)
    out = evidence.lights_coverage(base, ("state",))
    return out.select("state", *[F.round(c, 8).alias(c) for c in ("lit_share", "mean_lights", "max_lights")], "n_missing")


# -------------------------------------------------------------------- elements


@query("scan_osm_elements", with_ctes(
    "SELECT type, id, part, supp FROM elements WHERE coalesce(highway, building, landuse, amenity, shop, office) IS NOT NULL", ELEMENTS))
def _(spark, sf):
    return grids.scan_osm_elements(elements(spark, sf)).select("type", "id", "part", "supp")


@query("scan_osm_tiles", """SELECT 'node' AS type, event_id AS id, user_id / 1e1 AS lat, event_type AS amenity, 0 AS n_vertices FROM events
  UNION ALL SELECT 'way', event_id, NULL, NULL, 2 FROM events""")
def _(spark, sf):
    point = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    value, user = F.col("value"), F.col("user_id") / 10.0
    node = F.struct(
        F.lit("node").alias("type"), F.col("event_id").alias("id"), user.alias("lat"), value.alias("lon"),
        F.create_map(F.lit("amenity"), F.col("event_type")).alias("tags"), F.lit(None).cast(geo_type()).alias("geometry"))
    way = F.struct(
        F.lit("way").alias("type"), F.col("event_id").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), F.array(point(user, value), point(value, user)).alias("geometry"))
    path = scratch_path(spark, "tiles")
    table(spark, sf, "events").select(F.to_json(F.struct(F.array(node, way).alias("elements"))).alias("value")).write.text(path)
    read = grids.scan_osm_tiles(spark, path, one_document_per_line=True)
    return read.select("type", "id", "lat", F.col("tags")["amenity"].alias("amenity"), F.coalesce(F.size("geometry"), F.lit(0)).alias("n_vertices"))


def geo_type():
    return "array<struct<lat: double, lon: double>>"


@query("dedupe_elements", with_ctes(
    """SELECT type, id, (min_by({'part': part}, (tile, part))).part AS part, count(*) AS copies FROM (SELECT type, id, part, 0 AS tile FROM elements
    UNION ALL SELECT type, id, part + 1000000, 1 FROM elements WHERE id % 3 = 0) GROUP BY type, id""", ELEMENTS))
def _(spark, sf):
    rows = tiles(spark, sf)
    kept = joins.dedupe_elements(rows, ["type", "id"], ["tile", "part"])
    copies = rows.groupBy("type", "id").agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(copies, ["type", "id"]).select("type", "id", "part", "copies")


@query("filter_bbox", with_ctes(
    """SELECT e.type, e.id, e.part, e.supp FROM elements e LEFT JOIN (SELECT uid, min(lat) AS miny, max(lat) AS maxy, min(lon) AS minx, max(lon) AS maxx FROM vertices GROUP BY uid) v USING (uid)
    WHERE CASE WHEN type = 'node' THEN lon0 BETWEEN 72 AND 80 AND lat0 BETWEEN 12 AND 25 ELSE maxx >= 72 AND minx <= 80 AND maxy >= 12 AND miny <= 25 END""", ELEMENTS))
def _(spark, sf):
    return evidence.filter_bbox(elements(spark, sf), (72.0, 12.0, 80.0, 25.0)).select("type", "id", "part", "supp")


@query("classify_poi", with_ctes(
    f"SELECT type, id, part, supp, concat_ws(',', {', '.join(f'CASE WHEN {v} THEN {g!r} END' for g, v in POI.items())}) AS groups FROM elements WHERE {ANY_POI}", ELEMENTS))
def _(spark, sf):
    hit = evidence.classify_poi(F.col("tags"))
    return elements(spark, sf).where(F.size(hit) > 0).select("type", "id", "part", "supp", F.array_join(hit, ",").alias("groups"))


@query("road_class_filter", with_ctes(f"SELECT highway, count(*) AS n FROM elements WHERE {ROAD} GROUP BY highway", ELEMENTS))
def _(spark, sf):
    roads = elements(spark, sf).where(evidence.is_road(F.col("tags")))
    return roads.groupBy(F.col("tags")["highway"].alias("highway")).agg(F.count(F.lit(1)).alias("n"))


_ROADS = f"""segs AS (SELECT {cell_sql('0.5e0 * (p.lat1 + p.lat2)', '0.5e0 * (p.lon1 + p.lon2)', LEVEL)} AS cell, {_haversine_sql('lat1', 'lon1', 'lat2', 'lon2')} AS km FROM pieces p JOIN elements USING (uid) WHERE {ROAD}),
roads AS (SELECT cell, sum(km) AS road_km, count(*) AS road_segments FROM segs GROUP BY cell)"""
_HOME = f"home AS (SELECT *, {cell_sql('a.lat', 'a.lon', LEVEL)} AS cell FROM areas a)"
_BUILDINGS = "blds AS (SELECT cell, sum(m2) AS building_area_m2, count(*) AS building_count FROM home WHERE type = 'way' AND building IS NOT NULL AND m2 > 0 GROUP BY cell)"
_LANDUSE = "lands AS (SELECT cell, " + ", ".join(
    f"sum(CASE WHEN lower(landuse) = '{c}' THEN m2 ELSE 0e0 END) AS landuse_{c}_m2" for c in C.LANDUSE_CLASSES
) + f" FROM home WHERE type = 'way' AND {LAND} AND m2 > 0 GROUP BY cell)"
_POIS = "pois AS (SELECT cell, count(*) AS poi_count, " + ", ".join(
    f"count(*) FILTER ({v}) AS poi_{g}" for g, v in POI.items()
) + f" FROM home WHERE {ANY_POI} GROUP BY cell)"


@query("road_length", with_ctes("SELECT cell, round(road_km, 6) AS road_km, road_segments FROM roads", ELEMENTS, _ROADS))
def _(spark, sf):
    return evidence.road_length(elements(spark, sf), LEVEL).select("cell", F.round("road_km", 6).alias("road_km"), "road_segments")


@query("building_footprint", with_ctes("SELECT cell, round(building_area_m2 / 1e6, 6) AS km2, building_count FROM blds", ELEMENTS, AREAS, _HOME, _BUILDINGS))
def _(spark, sf):
    out = evidence.building_footprint(elements(spark, sf), LEVEL)
    return out.select("cell", F.round(F.col("building_area_m2") / 1e6, 6).alias("km2"), "building_count")


@query("landuse_area", with_ctes("SELECT cell, " + ", ".join(f"round(landuse_{c}_m2 / 1e6, 6) AS {c}" for c in C.LANDUSE_CLASSES) + " FROM lands", ELEMENTS, AREAS, _HOME, _LANDUSE))
def _(spark, sf):
    out = evidence.landuse_area(elements(spark, sf), LEVEL)
    return out.select("cell", *[F.round(F.col(f"landuse_{c}_m2") / 1e6, 6).alias(c) for c in C.LANDUSE_CLASSES])


@query("poi_counts", with_ctes("SELECT * FROM pois", ELEMENTS, AREAS, _HOME, _POIS))
def _(spark, sf):
    return evidence.poi_counts(elements(spark, sf), LEVEL)


_BASE = f"base AS (SELECT DISTINCT cell, {num(hexgrid.cell_area(LEVEL) / 400)} AS area_km2 FROM home)"
_FINAL_COLUMNS = (
    ["round(coalesce(road_km, 0e0), 6) AS road_km", "round(coalesce(building_area_m2, 0e0) / 1e6, 6) AS building_km2", "coalesce(building_count, 0)::DOUBLE AS building_count",
     "coalesce(poi_count, 0)::DOUBLE AS poi_count", "round(least(coalesce(building_area_m2, 0e0) / (area_km2 * 1e6), 1.5e0), 8) AS building_share"]
    + [f"round(least(coalesce(landuse_{c}_m2, 0e0) / (area_km2 * 1e6), 1.5e0), 7) AS landuse_{c}" for c in C.LANDUSE_CLASSES]
    + [f"round(coalesce(poi_{g}, 0) / area_km2, 8) AS poi_{g}_density" for g in C.POI_GROUPS]
)


# Line items with one number are one element.
ONCE = ELEMENTS.replace("AS ship FROM lineitem)", "AS ship FROM lineitem QUALIFY row_number() OVER (PARTITION BY type, id ORDER BY ship, part, supp) = 1)")


@query("finalise_cell_features", with_ctes(
    f"SELECT cell, {', '.join(_FINAL_COLUMNS)} FROM base LEFT JOIN roads USING (cell) LEFT JOIN blds USING (cell) LEFT JOIN lands USING (cell) LEFT JOIN pois USING (cell)",
    ONCE, AREAS, _ROADS, _HOME, _BUILDINGS, _LANDUSE, _POIS, _BASE))
def _(spark, sf):
    """All measures from overlapping tiles, whose common elements count once, on the cells where any element that counts lies."""
    rows = joins.dedupe_elements(tiles(spark, sf), ["type", "id"], ["tile", "ship", "part", "supp"])
    # Copies that do not count make no cell either.
    home = materialize(evidence.home_measures(rows, LEVEL), "homes")
    measures = evidence.join_measures(home, evidence.road_length(rows, LEVEL))
    base = home.select("cell").withColumn("area_km2", F.lit(hexgrid.cell_area(LEVEL) / 400))
    out = evidence.finalise_cell_features(base, measures)
    return out.select(
        "cell", F.round("road_km", 6).alias("road_km"), F.round(F.col("building_area_m2") / 1e6, 6).alias("building_km2"), "building_count", "poi_count",
        F.round("building_share", 8).alias("building_share"), *[F.round(f"landuse_{c}", 7).alias(f"landuse_{c}") for c in C.LANDUSE_CLASSES],
        *[F.round(f"poi_{g}_density", 8).alias(f"poi_{g}_density") for g in C.POI_GROUPS])


_COUNTED = ", ".join(f"(SELECT count(*) FROM live WHERE type = 'way' AND lower(landuse) = '{c}' AND m2 > 0) AS landuse_{c}" for c in C.LANDUSE_CLASSES)


@query("osm_stats", with_ctes(
    f"""SELECT (SELECT count(*) FROM elements) AS objects_scanned, (SELECT count(*) FROM segs WHERE cell IN (SELECT cell FROM hexcells)) AS road_segments,
    (SELECT count(*) FROM live WHERE type = 'way' AND building IS NOT NULL AND m2 > 0) AS buildings, {_COUNTED}, (SELECT count(*) FROM live WHERE {ANY_POI}) AS pois,
    (SELECT count(DISTINCT cell) FROM live WHERE type = 'way' AND building IS NOT NULL AND m2 > 0) AS cells_with_buildings, (SELECT count(DISTINCT cell) FROM live WHERE {ANY_POI}) AS cells_with_pois,
    (SELECT count(DISTINCT cell) FROM segs WHERE cell IN (SELECT cell FROM hexcells)) AS cells_with_roads""",
    HEXCELLS, ELEMENTS, AREAS, _ROADS, _HOME, "live AS (SELECT * FROM home WHERE cell IN (SELECT cell FROM hexcells))"))
def _(spark, sf):
    """Counters of the binning run itself, on the occupied hexagons."""
    valid = materialize(hexcells(spark, sf).select("cell"), "valid")
    binned, counters = evidence.bin_with_counters(elements(spark, sf), LEVEL, valid)
    materialize(binned, "binned")
    found = counters()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{n} bigint" for n in found))
