"""Geometry, hexagon ids, containment and tiling."""

import math

from pyspark.sql import functions as F

from dasyspark.functions import geo, h3id, hexgrid
from dasyspark.session import materialize
from dasyspark.operators import evidence, spatial
from dasyspark import config as C
from registry.core import CELLS, ELEMENTS, FINE_GRID, HEXCELLS, LEVEL, MID, cell_sql, cells, center_sql, elements, fine_grid, hexcells
from registry.core import lat_of, lat_sql, lon_of, lon_sql, nations, num, parent_sql, plane_xy_sql, query, table, with_ctes


def _haversine_sql(lat1, lon1, lat2, lon2):
    return (
        f"2e0 * 6371e0 * asin(least(1e0, sqrt(power(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lon2} - {lon1}) / 2e0), 2))))")


_E = C.WGS84_ECCENTRICITY
_POLE = 1 + (1 - _E * _E) / (2 * _E) * math.log((1 + _E) / (1 - _E))


def authalic_sql(lat):
    s = f"sin(radians({lat}))"
    return (
        f"({num(1 - _E * _E)} * ({s} / (1e0 - {num(_E * _E)} * {s} * {s}) + {num(1 / (2 * _E))} * ln((1e0 + {num(_E)} * {s}) / (1e0 - {num(_E)} * {s}))) / {num(_POLE)})")


AREAS = f"""closed AS (SELECT * FROM pieces UNION ALL SELECT a.uid, -1, a.lat, a.lon, b.lat, b.lon FROM vertices a JOIN vertices b ON a.uid = b.uid
   JOIN elements e ON e.uid = a.uid WHERE a.i = e.n_vertices - 1 AND b.i = 0),
areas AS (SELECT e.*, CASE WHEN n_vertices >= 3 THEN abs(s) * {num(C.AUTHALIC_RADIUS_M ** 2 / 2)} ELSE 0e0 END AS m2 FROM placed e LEFT JOIN
  (SELECT uid, sum(radians(lon2 - lon1) * ({authalic_sql("lat1")} + {authalic_sql("lat2")})) AS s FROM closed GROUP BY uid) x USING (uid))"""


@query("haversine_km", f"""SELECT o_orderkey, round({_haversine_sql(lat_sql("o_orderkey"), lon_sql("o_orderkey"), lat_sql("o_custkey"), lon_sql("o_custkey"))}, 6) AS km FROM orders""")
def _(spark, sf):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(geo.haversine_km(lat_of(a), lon_of(a), lat_of(b), lon_of(b)), 6).alias("km"))


@query("ring_area_m2", with_ctes("SELECT id, part, supp, n_vertices, round(m2 / 1e6, 6) AS km2 FROM areas WHERE type = 'way'", ELEMENTS, AREAS))
def _(spark, sf):
    ways = elements(spark, sf).where(F.col("type") == "way")
    return ways.select("id", "part", "supp", F.size("geometry").alias("n_vertices"), F.round(geo.ring_area_m2(F.col("geometry")) / 1e6, 6).alias("km2"))


@query("ring_centroid", with_ctes("SELECT id, part, supp, round(lat, 9) AS lat, round(lon, 9) AS lon FROM placed WHERE type = 'way'", ELEMENTS))
def _(spark, sf):
    ways = elements(spark, sf).where(F.col("type") == "way").select("id", "part", "supp", geo.ring_centroid(F.col("geometry")).alias("c"))
    return ways.select("id", "part", "supp", F.round("c.lat", 9).alias("lat"), F.round("c.lon", 9).alias("lon"))


@query("segment_midpoint", with_ctes(
    "SELECT id, part, supp, round(0.5e0 * (lat1 + lat2), 9) AS mid_lat, round(0.5e0 * (lon1 + lon2), 9) AS mid_lon FROM pieces JOIN elements USING (uid)", ELEMENTS))
def _(spark, sf):
    ways = elements(spark, sf).where(F.col("type") == "way").select(
        "id", "part", "supp", F.inline(geo.segments(F.col("geometry"))).alias("a", "b")).select("id", "part", "supp", *geo.segment_columns())
    return ways.select("id", "part", "supp", F.round("mid_lat", 9).alias("mid_lat"), F.round("mid_lon", 9).alias("mid_lon"))


@query("cell_resolution", with_ctes("SELECT h3, res, count(*) AS n FROM fine_grid GROUP BY ALL", FINE_GRID))
def _(spark, sf):
    return fine_grid(spark, sf).groupBy("h3", h3id.cell_resolution(F.col("h3")).alias("res")).agg(F.count(F.lit(1)).alias("n"))


@query("cell_parent", with_ctes("SELECT h3, parent7, parent6, parent5, count(*) AS n FROM fine_grid WHERE res = 8 GROUP BY ALL", FINE_GRID))
def _(spark, sf):
    h3 = F.col("h3")
    fine = fine_grid(spark, sf).where(h3id.cell_resolution(h3) == 8)
    return fine.groupBy("h3", *[h3id.cell_parent(h3, k).alias(f"parent{k}") for k in (7, 6, 5)]).agg(F.count(F.lit(1)).alias("n"))


@query("point_to_cell", with_ctes(f"SELECT o_orderkey, {cell_sql('lat', 'lon', 7)} AS cell FROM p",
                                  f"p AS (SELECT o_orderkey, {lat_sql('o_orderkey')} AS lat, {lon_sql('o_orderkey')} AS lon FROM orders)"))
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", hexgrid.point_to_cell(lat_of(k), lon_of(k), 7).alias("cell"))


_LAT, _LON = center_sql("cell", LEVEL)


@query("cell_center", with_ctes(f"SELECT cell, round({_LAT}, 9) AS lat, round({_LON}, 9) AS lon FROM hexcells", HEXCELLS))
def _(spark, sf):
    lat, lon = hexgrid.cell_center(F.col("cell"), LEVEL)
    return hexcells(spark, sf).select("cell", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("cell_area", with_ctes(f"SELECT unit, count(*) AS n, round(count(*) * {num(hexgrid.cell_area(LEVEL))}, 3) AS km2 FROM hexcells GROUP BY unit", HEXCELLS))
def _(spark, sf):
    area = F.lit(hexgrid.cell_area(LEVEL))
    return hexcells(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(area), 3).alias("km2"))


_X, _Y = plane_xy_sql("cell", LEVEL)
_SIDE = hexgrid.side_km(LEVEL)


@query("cell_boundary", with_ctes(
    f"""SELECT cell, k, round(degrees(asin(({_Y} + {num(_SIDE)} * sin(radians(60e0 * k - 30))) / {num(hexgrid.RADIUS_KM)})), 8) AS lat,
    round(degrees(({_X} + {num(_SIDE)} * cos(radians(60e0 * k - 30))) / {num(hexgrid.RADIUS_KM)}), 8) AS lon FROM hexcells, (SELECT unnest(range(7)) AS k)""", HEXCELLS))
def _(spark, sf):
    ring = hexcells(spark, sf).select("cell", F.posexplode(hexgrid.cell_boundary(F.col("cell"), LEVEL)).alias("k", "v"))
    return ring.select("cell", F.col("k").cast("bigint").alias("k"), F.round("v.lat", 8).alias("lat"), F.round("v.lon", 8).alias("lon"))


@query("hex_cell_parent", with_ctes(f"SELECT cell, {parent_sql('cell', LEVEL, MID)} AS parent FROM hexcells", HEXCELLS))
def _(spark, sf):
    return hexcells(spark, sf).select("cell", hexgrid.cell_parent(F.col("cell"), LEVEL, MID).alias("parent"))


@query("filter_finer_than_grid", with_ctes("SELECT h3, count(*) AS n FROM fine_grid WHERE res >= 7 GROUP BY h3", FINE_GRID))
def _(spark, sf):
    return evidence.filter_finer_than_grid(fine_grid(spark, sf), 7).groupBy("h3").agg(F.count(F.lit(1)).alias("n"))


@query("assert_single_resolution", with_ctes("""SELECT max(res) AS resolution, count(*) AS n, min(res) < max(res) AS mixed FROM fine_grid WHERE res = 8
  UNION ALL SELECT NULL, count(*), min(res) < max(res) FROM fine_grid""", FINE_GRID))
def _(spark, sf):
    """The finest ids share one resolution; the whole grid, mixed, is refused."""
    parts = []
    for rows in (fine_grid(spark, sf).where(h3id.cell_resolution(F.col("h3")) == 8), fine_grid(spark, sf)):
        try:
            found, mixed = evidence.assert_single_resolution(rows), False
        except ValueError:
            found, mixed = None, True
        parts.append(rows.agg(
            F.lit(found).cast("int").alias("resolution"), F.count(F.lit(1)).alias("n"), F.lit(mixed).alias("mixed")))
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- containment

# Units are 5 x 5 boxes that overlap their eastern and northern neighbours a
# little; every third has a hole, every odd one lacks its north-east quarter.
_W, _H = 3.8, 5.4


def unit_polygons(spark, sf):
    k = F.col("n_nationkey")
    x0, y0 = F.lit(69.0) + (k % 5) * F.lit(_W), F.lit(8.0) + F.floor(k / 5) * F.lit(_H)
    x1, y1 = x0 + F.lit(_W + 0.3), y0 + F.lit(_H + 0.3)
    xm, ym = x0 + F.lit(_W / 2), y0 + F.lit(_H / 2)
    at = lambda x, y: F.struct(y.alias("lat"), x.alias("lon"))
    box = F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))
    ell = F.array(at(x0, y0), at(x1, y0), at(x1, ym), at(xm, ym), at(xm, y1), at(x0, y1), at(x0, y0))
    hx, hy = x0 + F.lit(0.5), y0 + F.lit(0.5)
    hole = F.array(at(hx, hy), at(hx + 1.0, hy), at(hx + 1.0, hy + 1.0), at(hx, hy + 1.0))
    outer = F.when(k % 2 == 1, ell).otherwise(box)
    rings = F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return nations(spark, sf).select(F.col("n_name").alias("unit"), F.lit("0").alias("part"), F.explode(rings).alias("ring"))


UNIT_BOXES = f"""boxes AS (SELECT n_name AS unit, n_nationkey AS k, 69e0 + (n_nationkey % 5) * {num(_W)} AS x0, 8e0 + (n_nationkey // 5) * {num(_H)} AS y0 FROM nation)"""
INSIDE = (
    f"lon BETWEEN x0 AND x0 + {num(_W + 0.3)} AND lat BETWEEN y0 AND y0 + {num(_H + 0.3)}"
    f" AND NOT (k % 2 = 1 AND lon > x0 + {num(_W / 2)} AND lat > y0 + {num(_H / 2)})"
    " AND NOT (k % 3 = 0 AND lon > x0 + 0.5e0 AND lon < x0 + 0.5e0 + 1e0 AND lat > y0 + 0.5e0 AND lat < y0 + 0.5e0 + 1e0)")
_POINTS = f"pts AS (SELECT o_orderkey AS cell, {lat_sql('o_orderkey')} AS lat, {lon_sql('o_orderkey')} AS lon FROM orders)"


def _points(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("cell"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


@query("pip_join", with_ctes(f"SELECT cell, min(unit) AS unit FROM pts, boxes WHERE {INSIDE} GROUP BY cell", _POINTS, UNIT_BOXES))
def _(spark, sf):
    return spatial.pip_join(_points(spark, sf), unit_polygons(spark, sf))


@query("containing_units", with_ctes(f"SELECT cell, unit FROM pts, boxes WHERE {INSIDE}", _POINTS, UNIT_BOXES))
def _(spark, sf):
    return spatial.containing_units(_points(spark, sf), unit_polygons(spark, sf)).select("cell", "unit")


def _supplier_boxes(spark, sf):
    """A triangle or box per supplier."""
    k = F.col("s_suppkey")
    y, x = lat_of(k), lon_of(k)
    at = lambda dx, dy: F.struct((y + F.lit(dy)).alias("lat"), (x + F.lit(dx)).alias("lon"))
    box = F.array(at(0.0, 0.0), at(0.8, 0.0), at(0.8, 0.6), at(0.0, 0.6))
    tri = F.array(at(0.0, 0.0), at(0.8, 0.0), at(0.0, 0.6))
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("unit"), F.lit("0").alias("part"), F.when(k % 2 == 0, box).otherwise(tri).alias("ring"))


_FILL_LEVEL = 6
_S = hexgrid.side_km(_FILL_LEVEL)
_R = num(hexgrid.RADIUS_KM)


@query("polyfill", with_ctes(
    f"""SELECT {_FILL_LEVEL * 2 ** 56} + (q::BIGINT + {2 ** 27}) * 268435456 + r::BIGINT + {2 ** 27} AS cell, min(unit) AS unit, round(min(lat), 9) AS lat, round(min(lon), 9) AS lon
    FROM centres WHERE lon BETWEEN x AND x + 0.8e0 AND lat BETWEEN y AND y + 0.6e0 AND (k % 2 = 0 OR (lon - x) / 0.8e0 + (lat - y) / 0.6e0 <= 1e0) GROUP BY q, r""",
    f"""b AS (SELECT s_name AS unit, s_suppkey AS k, {lat_sql('s_suppkey')} AS y, {lon_sql('s_suppkey')} AS x FROM supplier),
    rows AS (SELECT *, unnest(range(floor(sin(radians(y)) * {_R} / {num(_S * 1.5)})::BIGINT - 1, ceil(sin(radians(y + 0.6e0)) * {_R} / {num(_S * 1.5)})::BIGINT + 2)) AS r FROM b),
    grid AS (SELECT *, unnest(range(floor(radians(x) * {_R} / {num(_S * 3 ** 0.5)} - r / 2e0)::BIGINT - 1, ceil(radians(x + 0.8e0) * {_R} / {num(_S * 3 ** 0.5)} - r / 2e0)::BIGINT + 2)) AS q FROM rows),
    centres AS (SELECT *, degrees(asin({num(_S * 1.5)} * r / {_R})) AS lat, degrees({num(_S * 3 ** 0.5)} * (q + r / 2e0) / {_R}) AS lon FROM grid)"""))
def _(spark, sf):
    out = spatial.polyfill(_supplier_boxes(spark, sf), _FILL_LEVEL)
    return out.select("cell", "unit", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("filter_units_in_state", with_ctes(
    f"SELECT s_name AS unit FROM c, boxes WHERE k = 7 AND {INSIDE.replace('k %', '7 %')}",
    f"""c AS (SELECT s_name, {lat_sql('s_suppkey')} + CASE WHEN s_suppkey % 2 = 0 THEN 0.3e0 ELSE 0.2e0 END AS lat,
    {lon_sql('s_suppkey')} + CASE WHEN s_suppkey % 2 = 0 THEN 0.4e0 ELSE 0.8e0 / 3 END AS lon FROM supplier)""", UNIT_BOXES))
def _(spark, sf):
    area = unit_polygons(spark, sf).where(F.col("unit") == "NATION_7")
    return spatial.filter_units_in_area(_supplier_boxes(spark, sf), area).select("unit").distinct()


@query("dissolve_units", """SELECT n_name AS unit, count(*) AS parts, count(*) * 3 + count(*) FILTER (s_suppkey % 2 = 0) AS vertices FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
  UNION ALL SELECT 'ALL', count(*), count(*) * 3 + count(*) FILTER (s_suppkey % 2 = 0) FROM supplier""")
def _(spark, sf):
    owner = table(spark, sf, "supplier").join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("source"), "n_name")
    named = _supplier_boxes(spark, sf).withColumnRenamed("unit", "source").join(owner, "source").withColumn("unit", F.col("n_name"))
    both = spatial.dissolve_units(named).unionByName(spatial.dissolve_units(named, single="ALL"))
    return both.groupBy("unit").agg(F.count_distinct("part").alias("parts"), F.sum(F.size("ring")).alias("vertices"))


@query("tile_bbox", with_ctes(
    """SELECT s_suppkey, i, j, round(south + i * 0.7e0, 9) AS tile_south, round(west + j * 0.7e0, 9) AS tile_west,
    round(least(south + i * 0.7e0 + 0.7e0, north), 9) AS tile_north, round(least(west + j * 0.7e0 + 0.7e0, east), 9) AS tile_east
    FROM b, (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j) WHERE south + i * 0.7e0 < north AND west + j * 0.7e0 < east""",
    f"""b AS (SELECT s_suppkey, {lat_sql('s_suppkey')} AS south, {lat_sql('s_suppkey')} + 1e0 + s_acctbal / 4000e0 + 1.5e0 AS north, {lon_sql('s_suppkey')} AS west, {lon_sql('s_suppkey')} + 1.25e0 AS east FROM supplier)"""))
def _(spark, sf):
    k = F.col("s_suppkey")
    boxes = table(spark, sf, "supplier").select(
        "s_suppkey", lat_of(k).alias("south"), (lat_of(k) + 1.0 + F.col("s_acctbal") / 4000.0 + 1.5).alias("north"),
        lon_of(k).alias("west"), (lon_of(k) + 1.25).alias("east"))
    out = spatial.tile_bbox(boxes, 0.7)
    return out.select(
        "s_suppkey", F.col("row").cast("bigint").alias("i"), F.col("col").cast("bigint").alias("j"),
        *[F.round(c, 9).alias(c) for c in ("tile_south", "tile_west", "tile_north", "tile_east")])


@query("extent", with_ctes("SELECT unit, round(min(lon), 9) AS min_lon, round(min(lat), 9) AS min_lat, round(max(lon), 9) AS max_lon, round(max(lat), 9) AS max_lat FROM cells GROUP BY unit", CELLS))
def _(spark, sf):
    out = spatial.extent(cells(spark, sf), ("unit",))
    return out.select("unit", *[F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


# ------------------------------------------------- from raw sources to cells

# Suppliers are the boundary features, nations the territories. Numbers that end in 1 or 2 have one canonical name per
# territory, so those features merge; every fifth territory reports as one unit.
_PLAN_CTES = (
    f"""feats AS (SELECT s_suppkey AS k, s_name, {lat_sql('s_suppkey')} AS y, {lon_sql('s_suppkey')} AS x FROM supplier)""",
    UNIT_BOXES,
    f"""owned AS (SELECT f.k AS f, f.y, f.x, s_name, b.unit AS state, b.k AS n FROM (SELECT *, y + CASE WHEN k % 2 = 0 THEN 0.3e0 ELSE 0.2e0 END AS lat, x + CASE WHEN k % 2 = 0 THEN 0.4e0 ELSE 0.8e0 / 3 END AS lon FROM feats) f,
      boxes b WHERE {INSIDE.replace('k %', 'b.k %')})""",
    """named AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'Whole of ' || state WHEN f % 10 IN (1, 2) THEN 'Merged ' || state ELSE upper(s_name[1]) || lower(s_name[2:]) END AS unit,
      CASE WHEN f % 10 IN (1, 2) THEN 'Merged ' || state ELSE upper(s_name[1]) || lower(s_name[2:]) END AS own FROM (SELECT * REPLACE (replace(s_name, '#', '') AS s_name) FROM owned))""",
    f"""rows AS (SELECT *, unnest(range(floor(sin(radians(y)) * {_R} / {num(_S * 1.5)})::BIGINT - 1, ceil(sin(radians(y + 0.6e0)) * {_R} / {num(_S * 1.5)})::BIGINT + 2)) AS r FROM named)""",
    f"""grid AS (SELECT *, unnest(range(floor(radians(x) * {_R} / {num(_S * 3 ** 0.5)} - r / 2e0)::BIGINT - 1, ceil(radians(x + 0.8e0) * {_R} / {num(_S * 3 ** 0.5)} - r / 2e0)::BIGINT + 2)) AS q FROM rows)""",
    f"""centres AS (SELECT *, degrees(asin({num(_S * 1.5)} * r / {_R})) AS lat, degrees({num(_S * 3 ** 0.5)} * (q + r / 2e0) / {_R}) AS lon FROM grid)""",
    f"""filled AS (SELECT {_FILL_LEVEL * 2 ** 56} + (q::BIGINT + {2 ** 27}) * 268435456 + r::BIGINT + {2 ** 27} AS cell, min({{'s': state, 'u': unit}}) AS o FROM centres
      WHERE lon BETWEEN x AND x + 0.8e0 AND lat BETWEEN y AND y + 0.6e0 AND (f % 2 = 0 OR (lon - x) / 0.8e0 + (lat - y) / 0.6e0 <= 1e0) GROUP BY q, r)""",
    f"people AS (SELECT {cell_sql('c.lat', 'c.lon', _FILL_LEVEL)} AS cell, sum(population) AS population, max(night_lights) AS night_lights FROM cells c GROUP BY 1)",
    """rich AS (SELECT DISTINCT state FROM named WHERE f % 4 = 0),
    totals AS (SELECT state, CASE WHEN n % 5 = 0 THEN 'Whole of ' || state ELSE own END AS unit, sum(y) AS y_crore FROM (
      SELECT state, n, own, CASE WHEN f % 4 = 0 THEN 2e0 * f ELSE NULL END AS y FROM named WHERE state IN (SELECT state FROM rich)
      UNION ALL SELECT state, n, own, 0.01e0 * f FROM named WHERE state NOT IN (SELECT state FROM rich) AND f % 3 <> 0) GROUP BY ALL HAVING sum(y) > 0)""",
)


@query("build_cells", with_ctes(
    """SELECT cell, o.s AS state, o.u AS unit, round(coalesce(population, 0), 2) AS population, round(coalesce(night_lights, 0), 8) AS night_lights, round(y_crore, 4) AS y_crore
    FROM filled JOIN totals ON state = o.s AND unit = o.u LEFT JOIN people USING (cell)""", CELLS, *_PLAN_CTES))
def _(spark, sf):
    """Boundaries, names, totals of two kinds of source and evidence, to one cell table."""
    from dasyspark.plans.cells import build_cells
    from dasyspark.sources.totals import feature_rings

    name = F.regexp_replace("unit", "#", "")
    as_pairs = lambda ring: F.array(F.transform(ring, lambda v: F.array(v["lon"], v["lat"])))
    boxes = _supplier_boxes(spark, sf).withColumn("f", F.regexp_extract("unit", r"(\d+)$", 1).cast("bigint"))
    features = materialize(boxes.select(name.alias("name"), "f", F.array(as_pairs(F.col("ring"))).alias("polygons")), "suppliers")
    borders = unit_polygons(spark, sf)
    nation = nations(spark, sf)
    territories = nation.select(F.col("n_name").alias("code"), F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("Whole of "), "n_name")).alias("dissolve_to"))
    merged = F.concat(F.lit("Merged "), F.col("code")).alias("canonical")
    one = F.array(F.struct(F.lit(1.0).alias("x")))
    listed = features.where(F.col("f") % 10 < 3).where(F.col("f") % 10 > 0).select(F.lower("name").alias("alias"), F.explode(one).alias("_o"))
    aliases = materialize(listed.select("alias", F.explode(F.array(*[F.lit(f"NATION_{i}") for i in range(25)])).alias("code")).select("code", "alias", merged), "aliases")
    # Where a feature lies, as the published tables know it.
    rings = feature_rings(features.withColumn("_id", F.col("f").cast("string")), "_id", F.lit(""))
    owned = spatial.containing_units(spatial.area_centroids(rings).withColumnRenamed("unit", "cell"), borders)
    told = materialize(owned.select(F.col("cell").cast("bigint").alias("f"), F.col("unit").alias("code")).join(features.select("f", "name"), "f"), "told")
    whole = F.col("code").isin([f"NATION_{i}" for i in range(0, 25, 5)])
    source_name = F.when(whole, F.concat(F.lit("Whole of "), "code")).otherwise(F.col("name"))
    dissolved = territories.where("dissolve_to IS NOT NULL").select("code", F.lower("dissolve_to").alias("alias"), F.col("dissolve_to").alias("canonical"))
    rows = told.select("code", source_name.alias("source_name"), "f", F.col("f").alias("position"))
    csv = rows.where("f % 4 = 0").select("code", "source_name", (F.col("f") * 2.0).alias("y_crore"), "position")
    parsed = rows.select("code", "source_name", F.col("f").cast("double").alias("y_crore"), "position", F.lit(True).alias("raw"))
    parsed = parsed.withColumn("source_name", F.when(F.col("position") % 3 == 0, F.lit(" Total")).otherwise(F.col("source_name")))
    settings = territories.select("code", F.lit(0.01).alias("value_scale"), F.array(F.lit("TOTAL")).alias("drop_names"))
    base = cells(spark, sf)
    people = base.groupBy(hexgrid.point_to_cell(F.col("lat"), F.col("lon"), _FILL_LEVEL).alias("cell")).agg(
        F.sum("population").alias("population"), F.max("night_lights").alias("night_lights"))
    out = build_cells(features, borders, [csv, parsed], settings, aliases.unionByName(dissolved), territories, _FILL_LEVEL, [people], check=False)
    return out.select("cell", "state", "unit", F.round("population", 2).alias("population"), F.round("night_lights", 8).alias("night_lights"), F.round("y_crore", 4).alias("y_crore"))
