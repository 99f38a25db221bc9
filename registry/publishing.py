"""Roll-ups, metrics, payloads, catalogues, sinks and cell context."""

from pyspark.sql import functions as F

from dasyspark.functions import hexgrid
from dasyspark.operators import explain, publish
from dasyspark.operators import graph as G
from dasyspark.session import materialize, scratch_path
from dasyspark.sources import sinks
from registry.core import ALLOCATED, CELLS, HEXCELLS, LEVEL, RANKED, TOTALS, allocated, axial_sql_neighbors, cell_sql, cells, center_sql, hexcells
from registry.core import nations, parent_sql, query, ranked, table, with_ctes
from registry.learning import FEATURES, LATTICE, Z, _BASE, _EDGES, featured, lattice, lattice_totals

SPLIT = (CELLS, TOTALS, ALLOCATED)
WEALTH = (*SPLIT, RANKED)
BLOCK = LEVEL - 2


def r(name, digits=4, col=None):
    return F.round(col if col is not None else F.col(name), digits).alias(name)


def published(spark, sf):
    """Allocated hexagons under the export names: one row per hexagon, with its parent and unit."""
    base = allocated(spark, sf).withColumn("hex", hexgrid.point_to_cell(F.col("lat"), F.col("lon"), LEVEL))
    out = base.groupBy("hex").agg(
        F.min(F.struct("unit", "state")).alias("_u"), F.min("unit").alias("district"), (F.sum("population") / 7).alias("population"), (F.avg("night_lights") / 7).alias("night_lights"),
        (F.sum("road_km") / 7).alias("road_km"), F.sum("poi_count").alias("poi_count"), (F.max("building_share") / 7).alias("building_share"),
        F.round(F.sum("gdp_crore"), 4).alias("gdp_crore"), (F.avg("intensity_raw") / 7).alias("intensity_raw"),
        F.max("pci").alias("gdp_per_capita_inr"), F.round(F.max("y_crore"), 2).alias("y_crore"))
    return out.withColumns({"state": F.col("_u.state"), "parent": hexgrid.cell_parent(F.col("hex"), LEVEL, LEVEL - 1)}).drop("_u")


PUBLISHED = f"""pub AS (SELECT *, {parent_sql("hex", LEVEL, LEVEL - 1)} AS parent FROM (SELECT hex, min(unit) AS district, min_by(state, (unit, state)) AS state, sum(population) / 7 AS population,
  avg(night_lights) / 7 AS night_lights, sum(road_km) / 7 AS road_km, sum(poi_count) AS poi_count, max(building_share) / 7 AS building_share, round(sum(gdp_crore), 4) AS gdp_crore,
  avg(intensity_raw) / 7 AS intensity_raw, max(pci) AS gdp_per_capita_inr, round(max(y_crore), 2) AS y_crore
  FROM (SELECT *, {cell_sql("a.lat", "a.lon", LEVEL)} AS hex FROM allocated a) GROUP BY hex))"""


@query("rollup_r6", with_ctes(
    """SELECT parent, min_by(district, (district, hex)) AS district, round(sum(population), 2) AS population, round(avg(night_lights), 12) AS night_lights,
    round(sum(road_km), 7) AS road_km, sum(poi_count) AS poi_count, round(avg(building_share), 12) AS building_share, round(median(gdp_per_capita_inr), 5) AS gdp_per_capita_inr,
    round(sum(gdp_crore), 4) AS gdp_crore, round(avg(intensity_raw), 12) AS intensity_raw, min_by(y_crore, (district, hex)) AS y_crore FROM pub GROUP BY parent""", *SPLIT, PUBLISHED))
def _(spark, sf):
    out = publish.rollup_parents(published(spark, sf), "parent", ("district", "hex"))
    return out.select(
        "parent", "district", r("population", 2), r("night_lights", 12), r("road_km", 7), "poi_count", r("building_share", 12),
        r("gdp_per_capita_inr", 5), r("gdp_crore", 4), r("intensity_raw", 12), "y_crore")


@query("unit_table", with_ctes(
    """SELECT state, unit, count(*) AS n_cells, round(sum(population), 2) AS population, round(max(y_inr) / 1e7, 2) AS y_crore, round(sum(gdp_inr) / 1e7, 2) AS gdp_crore,
    round(median(pci), 5) AS median_pci FROM allocated GROUP BY state, unit""", *SPLIT))
def _(spark, sf):
    out = publish.unit_table(allocated(spark, sf).withColumn("gdp_per_capita_inr", F.col("pci")))
    return out.select(
        "state", "unit", "n_cells", r("population", 2), r("y_crore", 2, F.col("y_inr") / 1e7), r("gdp_crore", 2, F.col("gdp_inr") / 1e7),
        r("median_pci", 5, F.col("median_gdp_per_capita_inr")))


_METRICS = ["night_lights", "road_km", "poi_count", "building_area_m2", "building_count", "building_share", "intensity_raw", "population"]


@query("available_metrics", with_ctes(
    " UNION ALL ".join(
        f"SELECT state, '{m}' AS metric, round(avg((coalesce({m}, 0) <> 0)::INT), 8) AS share FROM sparse GROUP BY state HAVING '{m}' = 'population' OR avg((coalesce({m}, 0) <> 0)::INT) >= 0.005"
        for m in _METRICS + [f"landuse_{c}" for c in ("residential", "commercial", "industrial", "retail")] + ["poi_amenity_bank", "poi_office"])
    + " UNION ALL SELECT DISTINCT state, unnest(['wealth_index', 'gdp_per_capita_inr']), 0e0 FROM sparse",
    CELLS, "sparse AS (SELECT * REPLACE (CASE WHEN poi_office > 10 THEN poi_office ELSE 0e0 END AS poi_office, CASE WHEN poi_amenity_bank > 6 THEN poi_amenity_bank ELSE 0e0 END AS poi_amenity_bank) FROM cells)"))
def _(spark, sf):
    base = cells(spark, sf)
    for name, floor in (("poi_office", 10), ("poi_amenity_bank", 6)):
        base = base.withColumn(name, F.when(F.col(name) > floor, F.col(name)).otherwise(0.0))
    return publish.available_metrics(base).select("state", "metric", r("share", 8))


@query("metric_union", "SELECT p_type AS metric, (min_by({'l': p_name}, (p_brand, p_partkey))).l AS label FROM part GROUP BY p_type")
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_type").alias("metric"), F.col("p_brand").alias("state"), F.col("p_partkey").alias("position"), F.col("p_name").alias("label"))
    return publish.metric_union(rows).select("metric", "label")


@query("map_filter", with_ctes(
    "SELECT 'unit' AS how, cell FROM cells WHERE population >= 5000 AND unit = 'NATION_3' UNION ALL SELECT 'metro', cell FROM cells WHERE population >= 5000 AND unit IN ('NATION_1', 'NATION_8') "
    "UNION ALL SELECT 'all', cell FROM cells WHERE population >= 9000", CELLS))
def _(spark, sf):
    base = cells(spark, sf).select("cell", "unit", "population")
    parts = [
        publish.map_filter(base, 5000.0, unit="NATION_3").select(F.lit("unit").alias("how"), "cell"),
        publish.map_filter(base, 5000.0, metro=["NATION_1", "NATION_8"]).select(F.lit("metro").alias("how"), "cell"),
        publish.map_filter(base, 9000.0).select(F.lit("all").alias("how"), "cell"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PACKED = ["population", "night_lights", "road_km", "poi_count", "building_share", "gdp_crore", "gdp_per_capita_inr", "intensity_raw"]


def to_pack(spark, sf):
    base = published(spark, sf).withColumn("block", hexgrid.cell_parent(F.col("hex"), LEVEL, BLOCK)).withColumnRenamed("district", "unit")
    # A seventh of whole cents may be a tie of the last digit kept, which the order of the sum must not break.
    people = F.round("population", 6).alias("population")
    return base.withColumns({"population": people, **{c: F.round(c, 9) for c in ("night_lights", "road_km", "intensity_raw", "building_share")}})


def constants(spark, sf):
    base = allocated(spark, sf).withColumns({"y_crore": F.round("y_crore", 2), "dasymetric_scale": F.round(F.col("dasymetric_scale") / 1e7, 6)})
    return materialize(publish.unit_constants(base).select("state", "unit", "y", "s"), "constants")


def packed(spark, sf, payload=("state", "unit")):
    return publish.pack_columnar(materialize(to_pack(spark, sf), "to-pack"), list(payload), "block", "hex", PACKED, constants=constants(spark, sf), res=LEVEL)


_DECIMALS = {"p": 1, "nl": 3, "rd": 2, "poi": 0, "bsh": 4, "c": 4, "g": 0, "sr": 6}
_ROUNDED = """round_even(population, 1) AS p, round_even(round(night_lights, 9), 3) AS nl, round_even(round(road_km, 9), 2) AS rd, round_even(poi_count, 0) AS poi,
  round_even(round(building_share, 9), 4) AS bsh, round_even(gdp_crore, 4) AS c, round_even(gdp_per_capita_inr, 0) AS g, round_even(round(intensity_raw, 9), 6) AS sr"""
_BLOCKED = f"""rounded AS (SELECT state, district AS unit, hex, {parent_sql('hex', LEVEL, BLOCK)} AS block, {_ROUNDED} FROM pub),
constants AS (SELECT state, unit, round_even(round(max(y_crore), 2), 2) AS y, round_even(round(max(dasymetric_scale) / 1e7, 6), 8) AS s FROM allocated GROUP BY state, unit)"""
_BLOCKED_EVEN = _BLOCKED.replace("round_even(population, 1)", "round_even(round(population, 6), 1)")
_USED = "used AS (SELECT {0}, " + ", ".join(f"bool_or(coalesce({k}, 0) <> 0) AS has_{k}" for k in _DECIMALS) + " FROM rounded GROUP BY {0})"


def _pack_sql(keys, unit_sql):
    whole = ", ".join(
        f"CASE WHEN any_value(has_{k}) THEN array_to_string(list(coalesce(round({k} * {10 ** d})::BIGINT::VARCHAR, '-') ORDER BY hex), ',') END AS {k}" for k, d in _DECIMALS.items())
    return with_ctes(
        f"""SELECT {keys}, block, {LEVEL} AS res, count(*) AS n, {unit_sql}, array_to_string(list(hex ORDER BY hex), ',') AS h,
        array_to_string(list_sort(list(DISTINCT unit || '=' || round(y * 100)::BIGINT || '/' || round(s * 1000000)::BIGINT)), ',') AS per_district, {whole}
        FROM rounded JOIN used USING ({keys}) JOIN constants USING (state, unit) GROUP BY {keys}, block""", *SPLIT, PUBLISHED, _BLOCKED_EVEN, _USED.format(keys))


def _whole(out, *keys):
    """Every array, the dictionary and the map as text, numbers as integers of their last decimal."""
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    whole = lambda d: lambda v: F.coalesce(F.round(v * 10**d).cast("bigint").cast("string"), F.lit("-"))
    scaled = {k: F.array_join(F.transform(k, whole(d)), ",") for k, d in _DECIMALS.items()}
    entry = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]["y"] * 100).cast("bigint").cast("string"), F.lit("/"), F.round(e["value"]["s"] * 1000000).cast("bigint").cast("string"))
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("per_district"), entry)), ",")
    own = [F.array_join("d_vals", ",").alias("d_vals"), text("d").alias("d")] if "d_vals" in out.columns else [F.col("district")]
    return out.select(
        *keys, "block", "res", F.col("n").cast("bigint").alias("n"), *own, text("h").alias("h"), facts.alias("per_district"), *[v.alias(k) for k, v in scaled.items()])


@query("pack_columnar", _pack_sql("state, unit", "unit AS district"))
def _(spark, sf):
    """Payloads of units, whole: header, constants of the unit, arrays of all fields."""
    return _whole(packed(spark, sf), "state", "unit")


@query("pack_overview", _pack_sql(
    "state", """array_to_string(list_sort(list(DISTINCT unit)), ',') AS d_vals, array_to_string(list_transform(list(unit ORDER BY hex), lambda u: list_position(list_sort(list(DISTINCT unit)), u) - 1), ',') AS d"""))
def _(spark, sf):
    """Payloads of territories: units by a dictionary, constants in a map by unit."""
    return _whole(packed(spark, sf, ("state",)), "state")


_UNPACKED = ", ".join(f"CASE WHEN has_{k} THEN {k}{'::BIGINT' if d == 0 else ''} END AS {k}" for k, d in _DECIMALS.items())


@query("unpack_columnar", with_ctes(
    f"SELECT 'unit' AS source, state, unit, block, hex AS h, {_UNPACKED}, y, s FROM rounded JOIN used USING (state, unit) JOIN constants USING (state, unit) "
    f"UNION ALL SELECT 'overview', state, unit, block, hex AS h, {_UNPACKED}, y, s FROM rounded JOIN over USING (state) JOIN constants USING (state, unit)",
    *SPLIT, PUBLISHED, _BLOCKED, _USED.format("state, unit"), _USED.format("state").replace("used AS", "over AS")))
def _(spark, sf):
    """Cells from both kinds of payload, with unit, fields and the unit's constants."""
    parts = []
    for source, payload in (("unit", ("state", "unit")), ("overview", ("state",))):
        rows = publish.unpack_columnar(materialize(packed(spark, sf, payload), "packed"), payload)
        parts.append(rows.select(F.lit(source).alias("source"), "state", "unit", "block", "h", *_DECIMALS, "y", "s"))
    return parts[0].unionByName(parts[1])


@query("unit_constants", with_ctes("SELECT state, unit, round_even(round(max(y_crore), 2), 2) AS y FROM allocated GROUP BY state, unit", *SPLIT))
def _(spark, sf):
    base = allocated(spark, sf).withColumn("y_crore", F.round("y_crore", 2))
    return publish.unit_constants(base).select("state", "unit", "y")


_SOURCES = "sources AS (SELECT r_regionkey AS state, r_name AS name, (2020 + r_regionkey)::VARCHAR AS year, CASE WHEN r_regionkey % 2 = 0 THEN 'constant' ELSE 'current' END AS price_basis FROM region)"


def _sources(spark, sf):
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select(
        k.alias("state"), F.col("r_name").alias("name"), (k + 2020).cast("string").alias("year"), F.when(k % 2 == 0, "constant").otherwise("current").alias("price_basis"))


def _report(spark, sf):
    """Rows of an evaluation: losses and coverage of every territory."""
    base = allocated(spark, sf)
    from dasyspark.operators.allocate import log_loss

    losses = log_loss(base, ["state"]).select("state", F.lit("ensemble").alias("section"), F.lit("log_loss").alias("item"), F.round("log_loss", 6).alias("value"))
    lit = base.groupBy("state").agg(F.round(F.avg((F.col("night_lights") > 0).cast("double")), 6).alias("value"))
    return losses.unionByName(lit.select("state", F.lit("coverage").alias("section"), F.lit("lit_share").alias("item"), "value"))


@query("run_manifest", with_ctes(
    """SELECT a.state, count(*) AS n_cells, round(sum(population), 2) AS total_population, count(*) FILTER (population > 0) AS n_inhabited, count(DISTINCT unit) AS n_units,
    round((SELECT sum(y_crore) FROM (SELECT DISTINCT unit, y_crore, state FROM allocated) d WHERE d.state = a.state), 2) AS total_crore, true AS exact, round(avg(pci), 5) AS mean_pci, sum(night_lights) > 0 AS lit,
    any_value(s.name) AS name, any_value(year) AS year, any_value(price_basis) AS price_basis, round(avg((night_lights > 0)::INT), 6) AS lit_share,
    (SELECT round(avg(power(log10(h + 1e-6) - log10(y + 1e-6), 2)), 6) FROM (SELECT state, unit, sum(intensity_raw * population) AS h, max(y_inr) AS y FROM allocated GROUP BY ALL) l WHERE l.state = a.state) AS log_loss
    FROM allocated a JOIN sources s ON s.state = a.state GROUP BY a.state""", *SPLIT, _SOURCES))
def _(spark, sf):
    """Manifests with provenance and evaluation, read back from their JSON."""
    base = materialize(allocated(spark, sf).withColumn("gdp_per_capita_inr", F.col("pci")), "allocated")
    out = publish.run_manifest(base, sources=_sources(spark, sf), evaluation=_report(spark, sf))
    schema = """n_cells bigint, total_population double, n_inhabited bigint, n_units bigint, total_y_inr double, max_abs_rel_recon_error double, mean_gdp_per_capita_inr double,
        night_lights_used boolean, source struct<name: string, year: string, price_basis: string>, evaluation map<string, string>"""
    read = out.select("state", F.from_json("manifest", schema).alias("m")).select("state", "m.*")
    item = lambda section, name: F.get_json_object(F.col("evaluation")[section], f"$.{name}").cast("double").alias(name)
    return read.select(
        "state", "n_cells", r("total_population", 2), "n_inhabited", "n_units", r("total_crore", 2, F.col("total_y_inr") / 1e7),
        (F.col("max_abs_rel_recon_error") < 1e-9).alias("exact"), r("mean_pci", 5, F.col("mean_gdp_per_capita_inr")), F.col("night_lights_used").alias("lit"),
        "source.name", "source.year", "source.price_basis", item("coverage", "lit_share"), item("ensemble", "log_loss"))


def _metros(spark, sf):
    k = F.col("r_regionkey")
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    return table(spark, sf, "region").select(k.alias("state"), F.col("r_name").alias("metro"), F.array(name(k), name(k + 5), name(k + 15), F.lit("X")).alias("units"))


_OFFERED = [m for m in ("gdp_crore", *_METRICS, *[f"landuse_{c}" for c in ("residential", "commercial", "industrial", "retail")], "poi_amenity_bank", "poi_office")]
_SUMMARY = f"""SELECT c.state, count(*) AS n_cells, round(sum(population), 2) AS population, count(DISTINCT {cell_sql("c.lat", "c.lon", LEVEL - 1)}) AS n_parents,
  array_to_string(list_sort(list(DISTINCT unit)), ',') AS units, array_to_string(list_transform(list_sort(list(DISTINCT unit)), lambda u: 'r7/' || lower(replace(u, '_', '-')) || '.json'), ',') AS files,
  (SELECT string_agg(unit || ':' || n || ':' || round(y / 1e7)::BIGINT || ':' || round(p)::BIGINT || ':' || round(g / 1e7)::BIGINT || ':' || round(m * 100)::BIGINT, ',' ORDER BY y DESC, unit) FROM
    (SELECT state, unit, count(*) AS n, max(y_inr) AS y, sum(population) AS p, sum(gdp_inr) AS g, median(pci) AS m FROM allocated GROUP BY ALL) t WHERE t.state = c.state) AS unit_table,
  (SELECT r_name || ':' || array_to_string(list(u ORDER BY p), '+') FROM (SELECT r_name, unnest(['NATION_' || r_regionkey, 'NATION_' || (r_regionkey + 5), 'NATION_' || (r_regionkey + 15), 'X']) AS u, unnest(range(4)) AS p FROM region WHERE r_regionkey = c.state)
   WHERE u IN (SELECT unit FROM cells d WHERE d.state = c.state) GROUP BY r_name) AS metros,
  sum(night_lights) > 0 AS lit, any_value(s.name) AS name, any_value(year) AS year, any_value(price_basis) AS price_basis, 2 + {" + ".join(f"(CASE WHEN '{m}' = 'population' OR avg((coalesce({m}, 0) <> 0)::INT) >= 0.005 THEN 1 ELSE 0 END)" for m in _OFFERED)} AS n_metrics
  FROM allocated c JOIN sources s ON s.state = c.state GROUP BY c.state"""


def summaries(spark, sf):
    base = allocated(spark, sf).withColumns({
        "gdp_per_capita_inr": F.col("pci"), "parent": hexgrid.point_to_cell(F.col("lat"), F.col("lon"), LEVEL - 1)})
    return publish.state_summary(materialize(base, "allocated"), _metros(spark, sf), parent="parent", sources=_sources(spark, sf))


@query("state_summary", with_ctes(_SUMMARY, *SPLIT, _SOURCES))
def _(spark, sf):
    """Territories with their units, files, table, metros, metrics and source."""
    out = summaries(spark, sf)
    listed = F.transform("metros", lambda m: F.concat(m["metro"], F.lit(":"), F.array_join(m["members"], "+")))
    whole = lambda c: F.round(c).cast("bigint").cast("string")
    row = F.transform("unit_table", lambda u: F.concat_ws(
        ":", u["unit"], u["n_cells"].cast("string"), whole(u["y_inr"] / 1e7), whole(u["population"]), whole(u["gdp_inr"] / 1e7), whole(u["median_gdp_per_capita_inr"] * 100)))
    return out.select(
        "state", "n_cells", r("population", 2), "n_parents", F.array_join("units", ",").alias("units"),
        F.array_join(F.transform("units", lambda u: F.element_at("unit_files", u)), ",").alias("files"), F.array_join(row, ",").alias("unit_table"),
        F.array_join(listed, ";").alias("metros"), F.col("night_lights_used").alias("lit"), "name", "year", "price_basis", F.size("metrics").alias("n_metrics"))


@query("catalog_metrics", with_ctes(
    "SELECT metric, label, units, grouping, min(state) AS first_state FROM (" + " UNION ALL ".join(
        [f"SELECT state, '{m}' AS metric, '{label}' AS label, '{units}' AS units, '{grouping}' AS grouping FROM allocated GROUP BY state HAVING {'true' if m in ('wealth_index', 'gdp_per_capita_inr', 'population') else f'avg((coalesce({m}, 0) <> 0)::INT) >= 0.005'}"
         for m, label, units, grouping in publish.metric_columns([*_OFFERED, "gdp_per_capita_inr", "wealth_index"])]) + ") GROUP BY ALL", *SPLIT))
def _(spark, sf):
    """The metrics of all summaries, each once with its first definition."""
    out = publish.catalog_metrics(materialize(summaries(spark, sf), "summaries"))
    return out.select("metric", "label", "units", "grouping", F.col("place.state").alias("first_state"))


@query("build_catalog", """SELECT CASE WHEN s_acctbal > 6000 THEN s_nationkey ELSE 100 + s_nationkey END AS state, count(*) AS n, 'new' AS made FROM supplier GROUP BY ALL
  UNION ALL SELECT c_nationkey, count(*), 'old' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000) GROUP BY ALL""")
def _(spark, sf):
    """Nations of rich suppliers are made anew, under their number; the poorer ones make territories beyond."""
    nation = F.col("s_nationkey")
    fresh = table(spark, sf, "supplier").groupBy(F.when(F.col("s_acctbal") > 6000, nation).otherwise(nation + 100).alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.lit("new").alias("made"))
    old = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.lit("old").alias("made"))
    return publish.build_catalog(fresh, old)


# ----------------------------------------------------------------------- sinks


@query("sink_cells", with_ctes("SELECT cell, unit, round(population, 2) AS population FROM cells", CELLS))
def _(spark, sf):
    path = scratch_path(spark, "cells")
    sinks.sink_cells(cells(spark, sf), path, ["cell", "unit", "population"], ["unit", "cell"], partition="unit")
    return spark.read.parquet(path).select("cell", "unit", r("population", 2))


@query("sort_export", with_ctes("SELECT cell, unit FROM cells", CELLS))
def _(spark, sf):
    return sinks.sort_export(cells(spark, sf).select("cell", "unit"), "unit", "cell")


@query("sink_gzip_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.sink_gzip_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.option("header", True).schema("c_custkey bigint, c_name string, c_acctbal double").csv(path)


@query("sink_by_unit", with_ctes(
    "SELECT state, lower(replace(unit, '_', '-')) AS unit_slug, unit, count(*) AS blocks, sum(n)::BIGINT AS n FROM (SELECT state, unit, block, count(*) AS n FROM rounded GROUP BY ALL) GROUP BY state, unit",
    *SPLIT, PUBLISHED, _BLOCKED))
def _(spark, sf):
    path = scratch_path(spark, "units")
    payload = publish.payload_json(packed(spark, sf), ["state", "unit"])
    sinks.sink_by_unit(payload, path, "unit")
    read = spark.read.json(path).withColumn("n", F.get_json_object("payload", "$.n").cast("bigint"))
    return read.groupBy("state", "unit_slug", "unit").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"))


@query("unit_files", "SELECT s_name AS unit, lower(replace(s_name, '#', '-')) AS unit_slug, 'r7/' || lower(replace(s_name, '#', '-')) || '.json' AS file FROM supplier")
def _(spark, sf):
    return publish.unit_files(table(spark, sf, "supplier").select(F.col("s_name").alias("unit")))


# --------------------------------------------------------------------- context


@query("unit_context", with_ctes(
    """SELECT state, unit, count(*) AS n_cells, round(max(y_inr) / 1e7, 2) AS y_crore, round(sum(gdp_inr_raw), 3) AS raw, round(max(dasymetric_scale) / 1e7, 6) AS scale,
    round(sum(population), 2) AS population, round(sum(gdp_inr) / 1e7, 2) AS gdp_crore FROM allocated GROUP BY state, unit""", *SPLIT))
def _(spark, sf):
    out = explain.unit_context(allocated(spark, sf))
    return out.select(
        "state", "unit", "n_cells", r("y_crore", 2, F.col("y_inr") / 1e7), r("raw", 3, F.col("unit_sum_raw")), r("scale", 6, F.col("dasymetric_scale") / 1e7),
        r("population", 2), r("gdp_crore", 2, F.col("gdp_inr_after_scale") / 1e7))


@query("pick_presets", with_ctes(
    """SELECT state, coalesce(min_by(cell, (-w, cell)) FILTER (population >= p80), min_by(cell, (-w, cell))) AS rich_urban,
    coalesce(min_by(cell, (w, cell)) FILTER (population BETWEEN p20 AND p60 AND road_km <= rm), min_by(cell, (w, cell))) AS poor_rural
    FROM (SELECT *, round(wealth_index, 6) AS w FROM ranked) JOIN (SELECT state, quantile_cont(population, 0.2) AS p20, quantile_cont(population, 0.6) AS p60, quantile_cont(population, 0.8) AS p80,
    quantile_cont(road_km, 0.5) AS rm FROM cells GROUP BY state) USING (state) GROUP BY state""", *WEALTH))
def _(spark, sf):
    return explain.pick_presets(ranked(spark, sf).withColumn("wealth_index", F.round("wealth_index", 6)))


@query("top_features", with_ctes(
    "SELECT cell, rank, feature, z FROM (SELECT cell, feature, z, row_number() OVER (PARTITION BY cell ORDER BY abs(z) DESC, feature) AS rank FROM "
    "(UNPIVOT (SELECT cell, " + ", ".join(f"round({z}, 4) AS {z}" for z in Z) + " FROM zs) ON " + ", ".join(Z) + " INTO NAME feature VALUE z)) WHERE rank <= 10", CELLS, FEATURES))
def _(spark, sf):
    wide, names = featured(spark, sf)
    return explain.top_features(wide, names).select("cell", F.col("rank").cast("bigint").alias("rank"), "feature", "z")


@query("neighbor_profile", with_ctes(
    """SELECT src AS cell, array_to_string(list(dst || ':' || poi_count::BIGINT ORDER BY dst), ',') AS neighbors, round(sum(population), 2) AS population
    FROM edges JOIN hexcells ON dst = cell GROUP BY src""", HEXCELLS, _EDGES))
def _(spark, sf):
    base = materialize(hexcells(spark, sf), "hexcells")
    out = explain.neighbor_profile(base, G.adjacency_join(base, LEVEL), ["population", "night_lights", "road_km", "poi_count"])
    text = F.transform("neighbors", lambda n: F.concat(n["dst"].cast("string"), F.lit(":"), n["poi_count"].cast("bigint").cast("string")))
    people = F.aggregate("neighbors", F.lit(0.0), lambda a, n: a + n["population"])
    return out.select("cell", F.array_join(text, ",").alias("neighbors"), r("population", 2, people))


_CHAIN = f"""runs AS (SELECT l.*, seed, 1e0 + night_lights + poi_count * 0.1e0 + seed * poi_count * 0.05e0 AS s FROM lattice l, (SELECT unnest(range(3)) AS seed) WHERE (state, unit) IN (SELECT (state, unit) FROM totals)),
seeded AS (SELECT *, CASE WHEN population > 0 THEN s * y_inr / greatest(sum(s * population) OVER (PARTITION BY seed, state, unit), 1e-9) END AS g FROM runs JOIN totals USING (state, unit)),
seed_rank AS (SELECT seed, cell, (rank() OVER (PARTITION BY seed, state ORDER BY g) + (count(*) OVER (PARTITION BY seed, state, g) - 1) / 2e0) / count(*) OVER (PARTITION BY seed, state) * 100 AS w FROM seeded WHERE population > 0),
ranges AS (SELECT cell, avg(s) AS s, min(s) AS s_min, max(s) AS s_max, min(coalesce(w, 0)) AS w_min, max(coalesce(w, 0)) AS w_max FROM seeded LEFT JOIN seed_rank USING (seed, cell) GROUP BY cell),
chain AS (SELECT l.*, r.* EXCLUDE (cell), y_inr / greatest(sum(s * population) OVER (PARTITION BY l.state, l.unit), 1e-9) AS scale FROM lattice l JOIN ranges r USING (cell) JOIN totals t ON t.state = l.state AND t.unit = l.unit),
chain_rank AS (SELECT cell, (rank() OVER (PARTITION BY state ORDER BY s * scale) + (count(*) OVER (PARTITION BY state, s * scale) - 1) / 2e0) / count(*) OVER (PARTITION BY state) * 100 AS w FROM chain WHERE population > 0),
told AS (SELECT c.*, round(coalesce(w, 0), 6) AS w FROM chain c LEFT JOIN chain_rank USING (cell)),
presets AS (SELECT DISTINCT unnest([coalesce(min_by(cell, (-w, cell)) FILTER (population >= p80), min_by(cell, (-w, cell))),
    coalesce(min_by(cell, (w, cell)) FILTER (population BETWEEN p20 AND p60 AND road_km <= rm), min_by(cell, (w, cell)))]) AS cell
    FROM told JOIN (SELECT state, quantile_cont(population, 0.2) AS p20, quantile_cont(population, 0.6) AS p60, quantile_cont(population, 0.8) AS p80,
    quantile_cont(road_km, 0.5) AS rm FROM told GROUP BY state) USING (state) GROUP BY state),
steps AS (SELECT cell AS src, unnest({axial_sql_neighbors('cell', LEVEL)}) AS dst FROM told),
near AS (SELECT src AS cell, count(*) AS n, sum(population) AS people, sum(w) AS w_near FROM steps JOIN told ON dst = cell GROUP BY src),
feats AS (SELECT cell, state, {", ".join(f"{v} AS {k}" for k, v in _BASE.items())} FROM told),
tops AS (SELECT cell, min_by(feature, (-abs(round(z, 4)), feature)) AS feature FROM (UNPIVOT (SELECT cell, {", ".join(f"({k} - avg({k}) OVER s) / CASE WHEN stddev_pop({k}) OVER s > 1e-9 THEN stddev_pop({k}) OVER s ELSE 1e0 END AS {k}_z" for k in _BASE)}
  FROM feats WINDOW s AS (PARTITION BY state)) ON {", ".join(f"{k}_z" for k in _BASE)} INTO NAME feature VALUE z) GROUP BY cell)"""


@query("cell_dossier", with_ctes(
    f"""SELECT t.cell, t.unit, round(population, 2) AS population, round(w, 4) AS wealth_index, round(w_min, 4) AS wealth_min, round(w_max, 4) AS wealth_max, round(s_min, 6) AS s_min, round(s_max, 6) AS s_max,
    round(s * population * scale / 1e7, 2) AS gdp_crore, coalesce(n, 0)::BIGINT AS neighbors, round(people, 2) AS people, feature AS top_feature, (SELECT count(*) FROM told c WHERE c.state = t.state AND c.unit = t.unit) AS unit_cells,
    round({center_sql("t.cell", LEVEL)[0]}, 6) AS lat, round({center_sql("t.cell", LEVEL)[1]}, 6) AS lon, {parent_sql("t.cell", LEVEL, LEVEL - 1)} AS parent_1, {parent_sql("t.cell", LEVEL, LEVEL - 2)} AS parent_2,
    CASE WHEN population > 0 THEN round(log10(population), 6) ELSE 0e0 END AS population_log, (CASE WHEN road_km > 0 THEN 1e0 ELSE 0e0 END) AS road_km_exists
    FROM told t JOIN presets USING (cell) LEFT JOIN near USING (cell) JOIN tops USING (cell)""", LATTICE, TOTALS, _CHAIN))
def _(spark, sf):
    """Dossiers of the preset cells of every territory, from the whole chain over the lattice, read back from their JSON."""
    from dasyspark.operators.allocate import ensemble_allocate
    from dasyspark.operators.features import engineer_features

    nodes = lattice(spark, sf)
    known = lattice_totals(spark, sf, nodes)
    kept = materialize(nodes.join(known.select("state", "unit"), ["state", "unit"], "left_semi"), "kept")
    seeds = F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("seed")
    runs = kept.select("*", seeds).withColumn("intensity_raw", F.lit(1.0) + F.col("night_lights") + F.col("poi_count") * 0.1 + F.col("seed") * F.col("poi_count") * 0.05)
    runs = runs.select("cell", "seed", "state", "unit", "population", "intensity_raw")
    told = ensemble_allocate(runs, kept, known, nations(spark, sf), 3).withColumn("wealth_index", F.round("wealth_index", 6))
    wide, names = engineer_features(kept, ("state",), table(spark, sf, "region"), keep=["cell"])
    lat, lon = hexgrid.cell_center(F.col("cell"), LEVEL)
    coarse = {f"parent_{i}": hexgrid.cell_parent(F.col("cell"), LEVEL, LEVEL - i) for i in (1, 2)}
    logged = [c for c in wide.columns if c.endswith(("_log", "_exists"))]
    base = told.join(wide.select("cell", *logged, *names), "cell").withColumns({"lat": lat, "lon": lon, **coarse})
    base = materialize(base, "dossier")
    presets = explain.pick_presets(base)
    chosen = materialize(presets.select(F.explode(F.array("rich_urban", "poor_rural")).alias("cell")).distinct(), "chosen")
    edges = G.adjacency_join(base, LEVEL)
    attributes = ["population", "night_lights", "road_km", "poi_count", "wealth_index"]
    out = explain.cell_dossier(base, edges, chosen, attributes, names, nations(spark, sf), list(coarse))
    schema = """inputs struct<population: double, wealth_index: double>, neighbors array<struct<population: double>>, unit_context struct<n_cells: bigint>,
        allocation struct<gdp_inr: double, wealth_index_min: double, wealth_index_max: double, intensity_raw_min: double, intensity_raw_max: double>,
        top_features array<struct<feature: string>>, position struct<lat: double, lon: double>, parents struct<parent_1: bigint, parent_2: bigint>,
        logged_values struct<population_log: double, road_km_exists: double>"""
    read = out.select("cell", "unit", F.from_json("dossier", schema).alias("d")).select("cell", "unit", "d.*")
    people = F.aggregate("neighbors", F.lit(0.0), lambda a, n: a + n["population"])
    return read.select(
        "cell", "unit", r("population", 2, F.col("inputs.population")), r("wealth_index", 4, F.col("inputs.wealth_index")),
        r("wealth_min", 4, F.col("allocation.wealth_index_min")), r("wealth_max", 4, F.col("allocation.wealth_index_max")),
        r("s_min", 6, F.col("allocation.intensity_raw_min")), r("s_max", 6, F.col("allocation.intensity_raw_max")),
        r("gdp_crore", 2, F.col("allocation.gdp_inr") / 1e7), F.coalesce(F.size("neighbors"), F.lit(0)).cast("bigint").alias("neighbors"),
        r("people", 2, people), F.col("top_features")[0]["feature"].alias("top_feature"), F.col("unit_context.n_cells").alias("unit_cells"),
        r("lat", 6, F.col("position.lat")), r("lon", 6, F.col("position.lon")), "parents.parent_1", "parents.parent_2",
        r("population_log", 6, F.col("logged_values.population_log")), F.col("logged_values.road_km_exists").alias("road_km_exists"))
