import json

import pytest
from pyspark.sql import functions as F

from dasyspark.functions import hexgrid
from dasyspark.operators import evidence, joins, publish
from dasyspark.session import materialize
from dasyspark.sources import grids, sheets, sinks, totals


def test_geojson_names_fall_through_empty_values(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"shapeName": "", "NAME_1": "One"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
        {"type": "Feature", "properties": None, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    rows = totals.scan_geojson_features(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted(r.name for r in rows) == ["", "One"]
    assert {r.name: r.properties for r in rows}[""] == {}


def test_records_in_either_layout(spark, tmp_path):
    recs = [{"_id": 1, "District": "Pune", "v": "2,28,623"}, {"District": "Nashik Div.", "v": "5"}, {"district": "Low", "v": "7"}, {"District": "None", "v": None}]
    (tmp_path / "a.json").write_text(json.dumps({"result": {"records": recs}}))
    (tmp_path / "b.json").write_text(json.dumps({"records": recs[:1]}, indent=2))
    got = sorted((r.source_name, r.y_crore) for r in totals.scan_ckan_records(spark, str(tmp_path), "District", "v").collect())
    assert got == [("Low", 7.0), ("Pune", 228623.0), ("Pune", 228623.0)]


def test_csv_falls_back_to_the_first_two_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('place,amount\n"Unit, ""A""","1,200"\nB,\n')
    assert [tuple(r) for r in totals.scan_dropin_csv(spark, str(tmp_path / "a.csv")).collect()] == [('Unit, "A"', 1200.0), ("B", None)]
    (tmp_path / "b.csv").write_text("x,y_crore,district\n9,3,C\n")
    assert [tuple(r) for r in totals.scan_dropin_csv(spark, str(tmp_path / "b.csv")).collect()] == [("C", 3.0)]


def sheet(spark, rows):
    return spark.createDataFrame([(1, i, c) for i, c in enumerate(rows)], "sheet_id int, row_idx int, cells array<string>")


def test_matrix_takes_first_best_header_and_last_match(spark):
    names = ["Agra", "Western Region", " Uttar  Pradesh ", "Kheri", "Zero", "Extra"]
    rows = [["t"], ["", "", *names], ["", "", *names[::-1]], ["1", "Gross Product", *["1"] * 6], ["2", "GROSS  PRODUCT (MP)", "1,000", "5", "6", "7.5", "0"]]
    got = {r.district: (r.y_crore, r.source_name) for r in sheets.matrix_to_long(sheet(spark, rows), "gross product", ["uttar pradesh"]).collect()}
    assert got == {"Agra": (1000.0, "Agra — GROSS PRODUCT (MP)"), "Kheri": (7.5, "Kheri — GROSS PRODUCT (MP)")}
    few = [["", "", "a", "b", "c", "d"], ["", "gross product", "1", "2", "3", "4"]]
    assert sheets.matrix_to_long(sheet(spark, few), "gross product").count() == 0


def test_caption_may_span_lines_and_last_row_wins(spark):
    text = "Table 3: Gross\n  Product\nYear 2021-22 2022-23\n1 Ajmer 10 1,000.5\nKota 5 6 7\n2 Ajmer 11 2000\n33 Sri Ganganagar (N) 1 2"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, text.replace("Table 3", "Table 4")), (2, 1, text.replace("2022-23", "2019-20"))], "doc_id int, page int, text string")
    got = {r.district: r.y_crore for r in sheets.text_line_table(pages, "table 3: gross product", "2022-23", value_scale=0.5).collect()}
    assert got == {"Ajmer": 1000.0, "Sri Ganganagar (N)": 1.0}


def test_quote_has_no_fallback(spark):
    pages = spark.createDataFrame([(1, 3, "GSDP at constant prices 5,000 Crore in 2021-22 then 6,000 Crore in 2023-24"), (1, 2, "GSDP at constant: 1 Crore in 2023-24"), (2, 1, "GSDP at constant " + "x" * 600 + " 7,000 Crore in 2023-24")],
                                  "doc_id int, page int, text string")
    assert [tuple(r) for r in sheets.labelled_value(pages, "GSDP at constant", "constant", "2023-24").collect()] == [(1, 3, 6000.0)]


def test_pixels_at_the_border_count(spark):
    pixels = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (0, 2, float("nan")), (1, 0, 5.0), (9, 9, 7.0), (0, 3, float("inf"))], "row int, col int, value double")
    got = [tuple(r) for r in grids.scan_pixels(pixels, (1.0, 0.0, 0.0, 0.0, -1.0, 2.0), (0.5, 0.5, 3.0, 1.5), nodata=-1.0).collect()]
    assert sorted(got) == [(0.5, 0.5, 5.0), (0.5, 1.5, 1.0)]
    with pytest.raises(Exception, match="does not cover"):
        grids.assert_coverage(pixels.select(F.col("col").alias("x"), F.col("row").alias("y")), (50.0, 50.0, 60.0, 60.0)).collect()
    with pytest.raises(ValueError):
        grids.assert_any_lit(spark.createDataFrame([(0.0,)], "night_lights double"))
    with pytest.raises(ValueError):
        grids.resolve_aliased_columns(pixels)


def test_unreadable_sheets_are_told_with_the_reason(spark):
    names = ["Aa", "Bb", "Cc", "Dd", "Ee"]
    sheet = lambda k, *cells: [(k, i, list(c)) for i, c in enumerate(cells)]
    rows = (
        sheet("good", ["no", "x", *names], ["1", "the label", "5", "6", "", "0", "1"])
        + sheet("headless", ["no", "x", "Aa", "Bb"], ["1", "the label", "5", "6"])
        + sheet("no row", ["no", "x", *names], ["1", "other", "5"]) + sheet("label above", ["1", "the label", "5"], ["no", "x", *names])
        + sheet("all nought", ["no", "x", *names], ["1", "the label", "0", "-", None, "", "0"])
    )
    table = spark.createDataFrame(rows, "sheet_id string, row_idx int, cells array<string>")
    assert {r.sheet_id for r in sheets.matrix_to_long(table, "the label").collect()} == {"good"}
    told = {r.sheet_id: r.reason for r in sheets.unreadable_matrices(table, "the label").collect()}
    assert told == {"headless": "no_header", "no row": "no_value_row", "label above": "no_value_row", "all nought": "no_values"}
    rows = sheet("good", ["Name", "Val"], ["a", "1"]) + sheet("late", *[["x"]] * 12, ["Name", "Val"], ["a", "1"]) + sheet("dropped", ["Val", " name "], ["3", "Total"])
    table = spark.createDataFrame(rows, "sheet_id string, row_idx int, cells array<string>")
    got = sheets.headed_table(table, "name", "Val", ["total"]).collect()
    assert [(r.sheet_id, r.district, r.source_name) for r in got] == [("good", "a", "Val")]
    told = {r.sheet_id: r.reason for r in sheets.unreadable_tables(table, "name", "Val", ["total"]).collect()}
    assert told == {"late": "no_header", "dropped": "no_values"}


def test_tiles_are_deduplicated_in_file_order(spark, tmp_path):
    node = lambda lat: {"type": "node", "id": 1, "lat": lat, "lon": 2.0, "tags": {"shop": "mall"}}
    (tmp_path / "tile_1.json").write_text(json.dumps({"elements": [node(5.0), node(6.0)]}))
    (tmp_path / "tile_0.json").write_text(json.dumps({"elements": [{"type": "way", "id": 1, "geometry": [{"lat": 1.0, "lon": 1.0}]}, node(4.0)]}))
    rows = grids.scan_osm_tiles(spark, f"{tmp_path}/tile_*.json")
    kept = joins.dedupe_elements(rows, ["type", "id"], ["tile", "position"]).collect()
    assert {r.type: r.lat for r in kept} == {"node": 4.0, "way": None}
    assert [r.type for r in grids.scan_osm_elements(rows.where("tile = 'tile_0.json'")).collect()] == ["node"]


def test_copies_go_without_moving_the_wide_rows(spark):
    """Null keys, copies alike in the order, many copies of one key; the plan shuffles no wide column."""
    rows = [("node", 1, 2, "b"), ("node", 1, 1, "a"), (None, 1, 1, "n1"), (None, 1, 2, "n2"), ("way", None, 1, "w")]
    rows += [("node", 7, 3, f"c{i}") for i in range(500)] + [("node", i, 1, f"d{i}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "type string, id int, tile int, wide string").repartition(7)
    kept = joins.dedupe_elements(materialize(df, "copies"), ["type", "id"], ["tile"]).collect()
    found = {(r.type, r.id): r.wide for r in kept}
    assert len(kept) == len(found) == 304 and found["node", 1] == "a" and found[None, 1] == "n1" and found["way", None] == "w"


def test_counters_come_from_the_binning_run(spark):
    point = lambda a, b: {"lat": a, "lon": b}
    way = [point(10.0, 70.0), point(10.0, 70.001), point(10.001, 70.001)]
    rows = [
        ("way", {"highway": "primary"}, None, None, way), ("way", {"building": "yes", "landuse": "Retail"}, None, None, way),
        ("node", {"amenity": "cafe"}, 10.0, 70.0, None), ("node", {"amenity": "cafe"}, 40.0, 70.0, None), ("node", {"shop": "mall"}, None, None, None),
    ]
    geo = "array<struct<lat: double, lon: double>>"
    elements = spark.createDataFrame(rows, f"type string, tags map<string,string>, lat double, lon double, geometry {geo}").withColumn("id", F.lit(1))
    valid = spark.createDataFrame([(10.0, 70.0)], "a double, b double").select(hexgrid.point_to_cell(F.col("a"), F.col("b"), 5).alias("cell"))
    binned, counters = evidence.bin_with_counters(elements, 5, valid)
    assert materialize(binned, "binned").count() == 1
    assert counters() == {
        "objects_scanned": 5, "road_segments": 2, "buildings": 1, "landuse_residential": 0, "landuse_commercial": 0, "landuse_industrial": 0,
        "landuse_retail": 1, "pois": 1, "cells_with_buildings": 1, "cells_with_pois": 1, "cells_with_roads": 1}


def test_way_outside_by_envelope_only(spark):
    geometry = [{"lat": 0.0, "lon": 0.0}, {"lat": 10.0, "lon": 10.0}]
    rows = [("way", 1, None, None, geometry), ("way", 2, None, None, geometry[:1]), ("node", 3, 4.0, 6.0, None), ("node", 4, 4.0, 6.01, None), ("relation", 5, 5.0, 5.0, None)]
    elements = spark.createDataFrame(rows, "type string, id int, lat double, lon double, geometry array<struct<lat: double, lon: double>>")
    assert sorted(r.id for r in evidence.filter_bbox(elements, (2.0, 4.0, 6.0, 5.0)).collect()) == [1, 3]


def test_sinks_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1, "Añ B", 2.0), (2, "C", 3.0), (3, "C", 1.0)], "hex int, unit string, population double")
    sinks.sink_cells(cells, f"{tmp_path}/cells", ["hex", "unit", "population"], ["unit", "hex"], partition="unit")
    assert spark.read.parquet(f"{tmp_path}/cells").where("unit = 'C'").count() == 2
    sinks.sink_gzip_csv(cells, f"{tmp_path}/csv")
    assert any(f.name.endswith(".csv.gz") for f in (tmp_path / "csv").iterdir())
    packed = publish.pack_columnar(cells.withColumn("block", F.lit(1)), ["unit"], "block", "hex", ["population"])
    sinks.sink_by_unit(publish.payload_json(packed, ["unit"]), f"{tmp_path}/units")
    assert sorted(f.name for f in (tmp_path / "units").iterdir() if f.is_dir()) == ["unit_slug=an-b", "unit_slug=c"]
    assert sinks.export_columns(["h3_r7", "road_km_z", "poi_x", "other", "district"]) == ["h3_r7", "district", "road_km_z", "poi_x"]


def test_catalog_keeps_what_was_not_rebuilt(spark):
    new = spark.createDataFrame([("MH", 2)], "state string, n int")
    old = spark.createDataFrame([("MH", 1), ("UP", 5)], "state string, n int")
    assert sorted(tuple(r) for r in publish.build_catalog(new, old).collect()) == [("MH", 2), ("UP", 5)]


def test_multipolygons_and_winding(spark, tmp_path):
    from dasyspark.operators import spatial

    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = [
        ("one", {"type": "Polygon", "coordinates": [box(0, 0, 4), box(1, 1, 1)[::-1]]}),
        ("same", {"type": "Polygon", "coordinates": [box(0, 0, 4), box(1, 1, 1)]}),
        ("turned", {"type": "Polygon", "coordinates": [box(0, 0, 4)[::-1], box(1, 1, 1)]}),
        ("two", {"type": "MultiPolygon", "coordinates": [[box(0, 0, 1)], [box(10, 0, 3)[::-1]]]}),
        ("point", {"type": "Point", "coordinates": [1, 2]}), ("none", None),
    ]
    (tmp_path / "m.geojson").write_text(json.dumps({
        "type": "FeatureCollection",
        "features": [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in features],
    }))
    read = totals.scan_geojson_features(spark, str(tmp_path / "m.geojson"))
    assert {r["name"]: len(r.polygons) for r in read.collect()} == {"one": 1, "same": 1, "turned": 1, "two": 2, "point": 0, "none": 0}
    rings = totals.feature_rings(read)
    assert {(r.unit, r["count"]) for r in rings.groupBy("unit").count().collect()} == {("one", 2), ("same", 2), ("turned", 2), ("two", 2)}
    # Centroids: (2.0333, 2.0333) whatever the winding, and (9.1..., 1.4) for the pair.
    area = lambda x, y, s: spark.createDataFrame([("a", "0", [(q, p) for p, q in box(x, y, s)])], "unit string, part string, ring array<struct<lat: double, lon: double>>")
    kept = lambda a: {r.unit for r in spatial.filter_units_in_area(rings, a).collect()}
    assert kept(area(2.0, 2.0, 0.1)) == {"one", "same", "turned"}
    assert kept(area(10.3, 1.3, 0.2)) == {"two"}


def test_sheets_made_from_a_small_file_are_never_broadcast_on_a_guess(spark, tmp_path):
    """A few bytes a sheet in the file become many rows; the guess of their size must not lead to a broadcast of them."""
    spark.range(3000).write.parquet(f"{tmp_path}/ids")
    row = lambda i, *c: F.struct(F.lit(i).alias("row_idx"), F.array(*[F.lit(x) for x in c]).alias("cells"))
    rows = F.array(row(0, "Name", "Val"), row(1, "one", "5"), row(2, "two", "6"), *[row(i, "total", "9") for i in range(3, 9)])
    table = spark.read.parquet(f"{tmp_path}/ids").select(F.col("id").alias("sheet_id"), F.inline(rows))
    matrix = F.array(row(0, "no", "name", *[f"Unit {c}" for c in "abcde"]), row(1, "1", "label", "1", "2", "3", "4", "0"))
    across = spark.read.parquet(f"{tmp_path}/ids").select(F.col("id").alias("sheet_id"), F.inline(matrix))
    for out, n in ((sheets.headed_table(table, "name", "val", ["total"]), 6000), (sheets.unreadable_tables(table, "name", "val", ["total"]), 0),
                   (sheets.matrix_to_long(across, "label"), 12000), (sheets.unreadable_matrices(across, "label"), 0)):
        assert out.count() == n
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
