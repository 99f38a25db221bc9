import pytest
from pyspark.sql import functions as F

from dasyspark.functions import hexgrid
from dasyspark.operators import graph
from dasyspark.plans import cells as plan
from dasyspark.plans.disaggregate import disaggregate

LEVEL = 6
RING = "array<struct<lat: double, lon: double>>"


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


@pytest.fixture(scope="module")
def raw(spark):
    """Two territories side by side: A has three named features, two of one unit; B reports as a whole."""
    features = spark.createDataFrame(
        [
            ("Ålpha ", [[box(70.0, 10.0, 1.0, 1.0)]]), ("Beta#", [[box(71.0, 10.0, 1.0, 1.0)]]), ("OLD BETA", [[box(71.0, 11.0, 1.0, 0.5)]]),
            ("Gamma", [[box(74.0, 10.0, 1.0, 1.0)], [box(76.0, 10.0, 0.5, 0.5)]]), ("Delta", [[box(75.0, 10.0, 0.8, 1.0)]]),
            ("Nowhere", [[box(90.0, 10.0, 1.0, 1.0)]]), ("Empty", []),
        ],
        "name string, polygons array<array<array<array<double>>>>",
    )
    borders = spark.createDataFrame(
        [(c, "0", [{"lat": y, "lon": x} for x, y in box(*b)]) for c, b in (("A", (69.9, 9.9, 3.0, 3.0)), ("B", (73.9, 9.9, 3.0, 3.0)))],
        f"unit string, part string, ring {RING}",
    )
    aliases = spark.createDataFrame([("A", "old beta", "Beta"), ("B", "old beta", "Other")], "code string, alias string, canonical string")
    territories = spark.createDataFrame([("A", None), ("B", "Bland")], "code string, dissolve_to string")
    settings = spark.createDataFrame([("A", 0.01, ["A total"]), ("B", 1.0, [])], "code string, value_scale double, drop_names array<string>")
    rows = "code string, source_name string, y_crore double, position int"
    dropin = spark.createDataFrame([("B", "bland", 50.0, 0), ("B", "BLAND", 5.0, 1), ("B", "Bland", -1.0, 2)], rows)
    sheet = spark.createDataFrame(
        [("A", "ålpha", 1000.0, 0), ("A", "Beta", 2000.0, 1), ("A", "Old Beta", 500.0, 2), ("A", "a TOTAL", 9999.0, 3), ("B", "Bland", 7.0, 0)], rows
    ).withColumn("raw", F.lit(True))
    return features, borders, [dropin, sheet], settings, aliases, territories


def test_units_take_names_and_merge_as_reported(raw):
    features, borders, _, _, aliases, territories = raw
    units = plan.reporting_units(features, borders, aliases, territories)
    parts = {(r.state, r.unit): r.n for r in units.groupBy("state", "unit").agg(F.count_distinct("part").alias("n")).collect()}
    assert parts == {("A", "Alpha"): 1, ("A", "Beta"): 2, ("B", "Bland"): 3}
    cells = plan.fill_cells(units, LEVEL, (LEVEL - 1,)).collect()
    area = {k: sum(c.area_km2 for c in cells if (c.state, c.unit) == k) for k in parts}
    degree = 6371.007181**2 * 0.0174532925**2 * 0.98
    for key, size in (("A", "Alpha"), 1.0), (("A", "Beta"), 1.5), (("B", "Bland"), 2.05):
        assert area[key] == pytest.approx(size * degree, rel=0.08)
    assert all(c.parent_5 // 2**56 == LEVEL - 1 for c in cells) and len({c.cell for c in cells}) == len(cells)


def test_totals_come_from_the_best_source_in_its_scale(raw):
    _, _, sources, settings, aliases, _ = raw
    got = {(r.state, r.unit): (r.y_crore, r.source_name) for r in plan.published_totals(sources, settings, aliases).collect()}
    assert got == {("A", "Alpha"): (10.0, "ålpha"), ("A", "Beta"): (25.0, "Beta"), ("B", "Bland"): (55.0, "bland")}


def test_from_raw_sources_to_allocations(spark, raw):
    features, borders, sources, settings, aliases, territories = raw
    cell = hexgrid.point_to_cell(F.col("lat"), F.col("lon"), LEVEL)
    spots = spark.createDataFrame([(10.05 + 0.1 * i, 70.05 + 0.1 * j, 1.0 + i + j) for i in range(10) for j in range(60)], "lat double, lon double, p double")
    people = spots.groupBy(cell.alias("cell")).agg(F.sum("p").alias("population"), F.max("p").alias("night_lights"))
    road = [{"lat": 10.2, "lon": 70.1}, {"lat": 10.2, "lon": 70.9}]
    tile = [("way", 1, None, None, {"highway": "primary"}, road, t) for t in (0, 1)] + [("node", 2, 10.5, 74.5, {"amenity": "bank"}, None, 0)]
    elements = spark.createDataFrame(tile, f"type string, id int, lat double, lon double, tags map<string,string>, geometry {RING}, tile int")
    cells = plan.build_cells(features, borders, sources, settings, aliases, territories, LEVEL, [people], elements, (LEVEL - 1,))
    rows = cells.collect()
    assert sum(r.road_segments for r in rows) == 1 and sum(r.poi_amenity_bank for r in rows) == 1
    assert {r.unit for r in rows} == {"Alpha", "Beta", "Bland"} and min(r.population for r in rows) == 0
    totals = plan.published_totals(sources, settings, aliases)
    base = cells.drop("y_crore", "y_inr", "source_name")
    edges = graph.within_territories(graph.adjacency_join(base, LEVEL), base)
    links = base.select(F.col("cell").alias("child"), F.concat_ws(":", "state", F.col("parent_5").cast("string")).alias("parent"))
    out, fit = disaggregate(base, totals, epochs=3, seeds=(0, 1), units=totals, territories=territories, edges=edges, links=links)
    sums = {(r.state, r.unit): r.y for r in out.groupBy("state", "unit").agg(F.sum("gdp_crore").alias("y")).collect()}
    assert sums == {("A", "Alpha"): pytest.approx(10.0), ("A", "Beta"): pytest.approx(25.0), ("B", "Bland"): pytest.approx(55.0)}
    assert set(fit.weights) == {(s, k) for s in "AB" for k in (0, 1)}
    # A published unit without cells is told.
    sources = [*sources[:1], sources[1].unionByName(spark.createDataFrame([("A", "Atlantis", 1.0, 9, True)], sources[1].schema))]
    with pytest.raises(ValueError, match="Atlantis"):
        plan.build_cells(features, borders, sources, settings, aliases, territories, LEVEL)
