import math
import random

import pytest
from pyspark.sql import functions as F

from dasyspark.functions import geo, h3id, hexgrid
from dasyspark.operators import evidence, graph, spatial

GEO = "array<struct<lat: double, lon: double>>"


def ring(*points):
    return [{"lat": lat, "lon": lon} for lat, lon in points]


def test_ring_area_is_close_to_the_ellipsoid_quad(spark):
    # One degree at the equator: 110.574 km x 111.320 km on WGS84 (12308.78 km2).
    quad = ring((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0))
    rows = spark.createDataFrame([(quad,), (quad + quad[:1],), (quad[::-1],), (quad[:2],), ([],)], f"g {GEO}")
    areas = [r[0] for r in rows.select(geo.ring_area_m2(F.col("g"))).collect()]
    assert areas[0] == pytest.approx(12308.78e6, rel=1e-4)
    assert areas[1] == pytest.approx(areas[0]) and areas[2] == pytest.approx(areas[0])
    assert areas[3:] == [0.0, 0.0]


def test_centroid_counts_a_closing_vertex_twice(spark):
    closed = ring((0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0))
    row = spark.createDataFrame([(closed,)], f"g {GEO}").select(geo.ring_centroid(F.col("g")).alias("c")).first()
    assert (row.c.lat, row.c.lon) == (1.0, 2.0)
    assert spark.createDataFrame([([],)], f"g {GEO}").select(geo.ring_centroid(F.col("g"))).first()[0] is None


def test_h3_parent_bits(spark):
    # Public examples of the id layout: a resolution-9 cell and its ancestors.
    row = spark.createDataFrame([("89283082837ffff",)], "h string").select(
        h3id.cell_resolution(F.col("h")), h3id.cell_parent(F.col("h"), 8), h3id.cell_parent(F.col("h"), 7)).first()
    assert tuple(row) == (9, "8828308283fffff", "872830828ffffff")


def grid_points(spark, n=40):
    return spark.range(n * n).select(
        F.col("id").alias("cell"), (F.floor(F.col("id") / n) / n * 2 + 10.0123).alias("lat"), (F.col("id") % n / n * 2 + 70.0371).alias("lon"))


def test_cells_hold_their_centres_and_have_one_parent(spark):
    cells = grid_points(spark).select(hexgrid.point_to_cell(F.col("lat"), F.col("lon"), 6).alias("cell")).distinct()
    lat, lon = hexgrid.cell_center(F.col("cell"), 6)
    back = cells.select("cell", hexgrid.point_to_cell(lat, lon, 6).alias("again"), hexgrid.cell_level(F.col("cell")).alias("lv"))
    assert back.where("cell <> again or lv <> 6").count() == 0
    nested = cells.select(
        hexgrid.cell_parent(F.col("cell"), 6, 4).alias("a"),
        hexgrid.cell_parent(hexgrid.cell_parent(F.col("cell"), 6, 5), 5, 4).alias("b"))
    assert nested.where("a <> b").count() == 0
    assert hexgrid.cell_area(5) == pytest.approx(7 * hexgrid.cell_area(6))


def test_nearest_centre_wins(spark):
    """A point lies in the hexagon whose centre is nearest on the plane."""
    pts = grid_points(spark, 15)
    cell = hexgrid.point_to_cell(F.col("lat"), F.col("lon"), 5)
    x, y = F.radians("lon") * hexgrid.RADIUS_KM, F.sin(F.radians("lat")) * hexgrid.RADIUS_KM
    wide = pts.select(x.alias("x"), y.alias("y"), cell.alias("c"))
    cand = wide.select("x", "y", "c", F.explode(hexgrid.cell_neighbors(F.col("c"), 5)).alias("n"))
    cx, cy = hexgrid.plane_center(F.col("c"), 5)
    nx, ny = hexgrid.plane_center(F.col("n"), 5)
    dist = lambda a, b: F.hypot(F.col("x") - a, F.col("y") - b)
    assert cand.where(dist(cx, cy) > dist(nx, ny) + 1e-9).count() == 0


def test_no_position_gives_no_cell(spark):
    row = spark.createDataFrame([(None, 70.0)], "lat double, lon double").select(hexgrid.point_to_cell(F.col("lat"), F.col("lon"), 5)).first()
    assert row[0] == hexgrid.NO_CELL


def test_edges_are_symmetric_without_loops(spark):
    cells = grid_points(spark).select(hexgrid.point_to_cell(F.col("lat"), F.col("lon"), 6).alias("cell")).distinct()
    edges = {(r.src, r.dst) for r in graph.adjacency_join(cells, 6).collect()}
    assert edges and all(a != b and (b, a) in edges for a, b in edges)
    lat, lon = hexgrid.cell_center(F.col("cell"), 6)
    spots = cells.select("cell", lat.alias("lat"), lon.alias("lon"))
    # Near the equator the plane is almost undistorted: centre distance finds the same ring.
    spacing = math.sqrt(2 * hexgrid.cell_area(6) / math.sqrt(3))
    near = {(r.src, r.dst) for r in graph.adjacency_by_distance(spots, 1.35 * spacing, tile=0.5).collect()}
    assert near == edges


def test_edges_by_distance_cross_the_meridian_and_the_poles(spark):
    rng = random.Random(5)
    spots = [(i, lat, lon) for i, (lat, lon) in enumerate([
        *((rng.uniform(-1.5, 1.5), rng.choice((-180.0, 180.0, 540.0)) + rng.uniform(-1.5, 1.5)) for _ in range(80)),
        *((sign * rng.uniform(88, 90), rng.uniform(-180, 180)) for sign in (1, -1) for _ in range(80)),
        *((rng.uniform(59, 61), rng.uniform(9, 13)) for _ in range(80)), (90.0, 0.0), (-90.0, 7.0), (30.0, 5.0), (30.0, 5.0),
    ])]
    cells = spark.createDataFrame([*spots, (900, None, 1.0), (901, 1.0, float("nan"))], "cell int, lat double, lon double")
    a, b = (cells.select(*[F.col(c).alias(c + n) for c in cells.columns]) for n in "12")
    near = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    met = a.crossJoin(b).where("cell1 <> cell2").select("cell1", "cell2", near.alias("km")).where("km is not null and not isnan(km)").collect()
    for reach in (0.0, 60.0, 130.0):
        edges = sorted((r.src, r.dst) for r in graph.adjacency_by_distance(cells, reach, tile=1.0).collect())
        assert edges and edges == sorted((r.cell1, r.cell2) for r in met if r.km <= reach)


def test_registered_edges_by_distance_read_customers_only(spark, monkeypatch):
    from registry import core, learning

    read = []
    for module in (core, learning):
        monkeypatch.setattr(module, "table", lambda s, sf, name: read.append(name) or s.read.parquet(f"{sf}/{name}.parquet"))
    assert core.QUERIES["adjacency_by_distance"](spark, "/root/testdata/sf0.01").count() > 0
    assert set(read) == {"customer", "nation"}


def polygons(spark, *rows):
    return spark.createDataFrame(rows, f"unit string, part string, ring {GEO}")


def test_containment_boundary_hole_and_claim(spark):
    square = ring((0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0))
    hole = ring((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0))
    other = ring((0.0, 3.0), (0.0, 6.0), (4.0, 6.0), (4.0, 3.0))
    shapes = polygons(spark, ("b", "0", square), ("b", "0", hole), ("a", "0", other))
    pts = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 0.0, 2.0), (4, 4.0, 4.0), (5, 2.0, 3.5), (6, 5.0, 5.0), (7, 1.0, 1.5), (8, 2.0, 6.0), (9, 4.0, 0.0), (10, 1.0, 0.5)]
    points = spark.createDataFrame(pts, "cell int, lat double, lon double")
    got = {r.cell: r.unit for r in spatial.pip_join(points, shapes, band=0.3, slot=1.0).collect()}
    assert got == {1: "b", 3: "b", 4: "a", 5: "a", 7: "b", 8: "a", 9: "b", 10: "b"}


def test_adjacent_parts_of_a_dissolved_unit_cover_both(spark):
    left, right = ring((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)), ring((0.0, 1.0), (0.0, 3.0), (2.0, 3.0), (2.0, 1.0))
    raw = spark.createDataFrame([("x", "x1", "0", left), ("x", "x2", "0", right)], f"unit string, source string, part string, ring {GEO}")
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.0, 1.5), (3, 1.0, 2.5)], "cell int, lat double, lon double")
    got = {r.cell for r in spatial.pip_join(points, spatial.dissolve_units(raw)).collect()}
    assert got == {1, 2, 3}


def test_polyfill_finds_every_centre(spark):
    """Against all lattice centres around the box, enumerated on their own."""
    box = ring((10.0, 70.0), (10.0, 71.0), (11.0, 71.0), (11.0, 70.0))
    cells = spatial.polyfill(polygons(spark, ("u", "0", box)), 7)
    s = hexgrid.side_km(7)
    want = 0
    for r in range(500, 620):
        lat = math.degrees(math.asin(1.5 * s * r / hexgrid.RADIUS_KM))
        for q in range(1500, 3500):
            lon = math.degrees(math.sqrt(3) * s * (q + r / 2) / hexgrid.RADIUS_KM)
            want += 10 <= lat <= 11 and 70 <= lon <= 71
    assert want > 2000
    assert cells.count() == cells.select("cell").distinct().count() == want


def test_tiles_clip_at_the_far_edge(spark):
    box = spark.createDataFrame([(0.0, 0.0, 1.0, 2.5)], "south double, west double, north double, east double")
    rows = spatial.tile_bbox(box, 1.0).collect()
    assert sorted((r.tile_west, r.tile_east) for r in rows) == [(0.0, 1.0), (1.0, 2.0), (2.0, 2.5)]


def test_one_pass_binning_equals_the_separate_measures(spark):
    way = ring((10.0, 70.0), (10.0, 70.2), (10.2, 70.2), (10.2, 70.0))
    rows = [
        ("way", 1, None, None, {"highway": "primary"}, way), ("way", 2, None, None, {"building": "no", "landuse": "Retail"}, way),
        ("node", 3, 10.1, 70.1, {"amenity": "CAFE", "office": "x"}, None), ("node", 4, 10.1, 70.1, {"office": ""}, None),
        ("way", 5, None, None, {"building": "yes"}, way[:2]), ("way", 6, None, None, {"highway": "footway"}, way),
        ("way", 7, None, None, {"highway": "trunk"}, []),
    ]
    elements = spark.createDataFrame(rows, f"type string, id bigint, lat double, lon double, tags map<string,string>, geometry {GEO}")
    level = 5
    got = {r.cell: r.asDict() for r in evidence.bin_elements(elements, level).collect()}
    parts = [evidence.road_length(elements, level), evidence.building_footprint(elements, level), evidence.landuse_area(elements, level), evidence.poi_counts(elements, level)]
    for part in parts:
        for r in part.collect():
            for name, value in r.asDict().items():
                assert got[r.cell][name] == pytest.approx(value)
    total = lambda name: sum(r[name] for r in got.values())
    assert (total("road_segments"), total("building_count"), total("poi_count"), total("poi_office"), total("poi_amenity_cafe")) == (3, 1, 1, 1, 1)


def test_rollup_weights_and_coarse_ids(spark):
    rows = [("8828308283fffff", 2.0, 3), ("8828308281fffff", 4.0, 0), ("862830827ffffff", 99.0, 1), (None, 1.0, 1)]
    grid = spark.createDataFrame(rows, "h3 string, night_lights double, pixel_count int").withColumn("population", F.col("night_lights"))
    got = evidence.h3_lights(grid, 7).collect()
    assert len(got) == 1 and got[0].night_lights == pytest.approx(2.5) and got[0].ntl_pixels == 4.0
    assert evidence.h3_population(grid, 7).first().population == 6.0
    with pytest.raises(ValueError):
        evidence.assert_single_resolution(grid)


def _even_odd(lat, lon, rings):
    """On an edge, or an odd number of edges to the east."""
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            turn = (d - b) * (lat - a) - (c - a) * (lon - b)
            if turn == 0 and min(a, c) <= lat <= max(a, c) and min(b, d) <= lon <= max(b, d):
                return True
            if (a > lat) != (c > lat) and (turn > 0) == (c > a):
                odd = not odd
    return odd


def _star(rng, lat, lon, size, corners):
    angles = sorted(rng.uniform(0, 6.283) for _ in range(corners))
    return [(lat + rng.uniform(0.3, 1) * size * math.sin(t), lon + rng.uniform(0.3, 1) * size * math.cos(t)) for t in angles]


@pytest.fixture(scope="module")
def shapes():
    """Stars with holes and islands, and boxes whose corners, edges and the points on them have round coordinates."""
    rng = random.Random(4)
    out = {}
    for k in range(12):
        lat, lon = rng.uniform(10, 11), rng.uniform(70, 71)
        outer = _star(rng, lat, lon, 0.4, rng.randint(3, 40))
        out[f"star{k}", "0"] = [outer, [(lat, lon), (lat + 0.05, lon), (lat, lon + 0.05)]]
        out[f"star{k}", "1"] = [_star(rng, lat - 0.5, lon, 0.03, 5)]
    for k in range(4):
        a, b = 10.0 + 0.25 * k, 70.0 + 0.25 * k
        out[f"box{k}", "0"] = [[(a, b), (a, b + 0.5), (a + 0.5, b + 0.5), (a + 0.5, b)], [(a + 0.25, b + 0.25), (a + 0.25, b + 0.3), (a + 0.3, b + 0.25)]]
    return out


def _table(spark, shapes):
    rows = [(u, p, [(float(a), float(b)) for a, b in ring]) for (u, p), rings in shapes.items() for ring in rings]
    return spark.createDataFrame(rows, "unit string, part string, ring array<struct<lat: double, lon: double>>")


@pytest.mark.parametrize("band, slot, broadcast", [(0.05, 0.05, True), (0.05, 0.05, False), (0.3, 0.02, False), (2.0, 3.0, True)])
def test_containment_matches_even_odd(spark, shapes, band, slot, broadcast):
    rng = random.Random(9)
    spots = [(i, rng.uniform(9.3, 11.7), rng.uniform(69.3, 71.7)) for i in range(600)]
    spots += [(1000 + 41 * i + j, 10 + i * 0.05, 70 + j * 0.05) for i in range(30) for j in range(30)]
    # Corners of the stars, and points straight above and beside them.
    corners = [v for (u, _), rings in shapes.items() if u < "t" for v in rings[0]][:60]
    spots += [(5000 + i, a + d, b) for i, (a, b) in enumerate(corners) for d in (0.0,)] + [(6000 + i, a + 0.01, b) for i, (a, b) in enumerate(corners)]
    points = spark.createDataFrame(spots, "cell long, lat double, lon double")
    want = {(c, u) for c, lat, lon in spots for (u, _), rings in shapes.items() if _even_odd(lat, lon, rings)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {(r.cell, r.unit) for r in spatial.containing_units(points, _table(spark, shapes), band, slot).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and len(want) > 300


def test_filling_matches_a_test_of_every_centre(spark, shapes):
    level = 8
    cells = spatial.polyfill(_table(spark, shapes), level)
    got = {r.cell: (r.unit, r.lat, r.lon) for r in cells.collect()}
    s = hexgrid.side_km(level)
    want = {}
    for r in range(int(math.sin(math.radians(9.2)) * hexgrid.RADIUS_KM / (1.5 * s)), int(math.sin(math.radians(11.9)) * hexgrid.RADIUS_KM / (1.5 * s)) + 1):
        lat = math.degrees(math.asin(1.5 * s * r / hexgrid.RADIUS_KM))
        for q in range(int(math.radians(69.2) * hexgrid.RADIUS_KM / (s * math.sqrt(3)) - r / 2), int(math.radians(71.9) * hexgrid.RADIUS_KM / (s * math.sqrt(3)) - r / 2) + 1):
            lon = math.degrees(s * math.sqrt(3) * (q + r / 2) / hexgrid.RADIUS_KM)
            units = [u for (u, _), rings in shapes.items() if _even_odd(lat, lon, rings)]
            if units:
                want[q, r] = min(units)
    assert len(got) == len(want) > 1000
    found = {}
    for cell, (unit, _, _) in got.items():
        found[(cell >> 28) % (1 << 28) - (1 << 27), cell % (1 << 28) - (1 << 27)] = unit
    assert found == want


def test_filling_meets_centres_on_the_outline(spark):
    """A box whose sides run through centres keeps them."""
    level = 4
    s = hexgrid.side_km(level)
    lat = [math.degrees(math.asin(1.5 * s * r / hexgrid.RADIUS_KM)) for r in (10, 12)]
    lon = [math.degrees(s * math.sqrt(3) * (q + 5.0) / hexgrid.RADIUS_KM) for q in (40, 43)]
    shape = {("u", "0"): [[(lat[0], lon[0]), (lat[0], lon[1]), (lat[1], lon[1]), (lat[1], lon[0])]]}
    rows = spatial.polyfill(_table(spark, shape), level).collect()
    got = sorted(((c.cell >> 28) % (1 << 28) - (1 << 27), c.cell % (1 << 28) - (1 << 27)) for c in rows)
    centres = [(q, r) for r in (10, 11, 12) for q in range(30, 60) if _even_odd(
        math.degrees(math.asin(min(1.0, s * 1.5 * r / hexgrid.RADIUS_KM))), math.degrees(s * math.sqrt(3) * (q + r / 2.0) / hexgrid.RADIUS_KM), shape["u", "0"])]
    assert got == sorted(centres) and (40, 10) in got


def test_elements_are_derived_where_their_lines_lie(spark, monkeypatch):
    """A large table is neither dealt out nor written again before elements are read off it."""
    from registry import core

    monkeypatch.setattr(core, "ONE_FILE", 0)
    for rows in (core.elements(spark, "/root/testdata/sf0.001"), core.tiles(spark, "/root/testdata/sf0.001")):
        assert all(f.endswith("lineitem.parquet") for f in rows.inputFiles())
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_copies_that_do_not_count_make_no_cell(spark, tmp_path):
    """Two line items with one number lie in different cells; the one shipped first is the element."""
    import datetime

    from dasyspark.functions import hexgrid
    from registry import binning, core

    assert binning.LEVEL == core.LEVEL
    k = F.col("id")
    at = lambda i, j: hexgrid.point_to_cell(core.lat_of(k) + i * 0.01, core.lon_of(k) + j * 0.01, core.LEVEL)
    key, cell = spark.range(1, 3000).where(at(0, 0) != at(4, 6)).select("id", at(0, 0)).first()
    rows = [(key, part, supp, 1, 10.0, "A", "O", datetime.datetime(year, 1, 1)) for part, supp, year in ((0, 0, 1996), (4, 6, 1997))]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.cell for r in core.QUERIES["finalise_cell_features"](spark, str(tmp_path)).collect()] == [cell]
