"""Registry of checked queries, and the given tables in the roles the operators expect.

Each role exists twice: as a DataFrame and as a SQL common table expression, so
a query and its SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark.functions import hexgrid
from dasyspark.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LEVEL, MID, COARSE = 4, 3, 2


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def num(value: float) -> str:
    """A double literal that no engine types as a decimal."""
    text = repr(float(value))
    return text if "e" in text or "E" in text else text + "e0"


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def written(spark: SparkSession, sf: str, name: str, make: Query) -> DataFrame:
    """A derived input table, written once per session, as a job would read it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(make(spark, sf), name)
    return _WRITTEN[key]


ONE_FILE = 4_000_000


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table to derive wider rows from, on all cores.

    The small given files are one row group each, which one task would read: their narrow rows
    are dealt out. Larger ones are scanned in many parts as they lie; no wide row ever moves.
    """
    rows = table(spark, sf, name)
    return rows.repartition(spark.sparkContext.defaultParallelism) if rows.count() <= ONE_FILE else rows


# ------------------------------------------------------------------ positions


def lat_of(key: Column) -> Column:
    return F.lit(8.0) + (key * 7919) % 1000003 / F.lit(1000003.0) * F.lit(27.0)


def lon_of(key: Column) -> Column:
    return F.lit(69.0) + (key * 104729) % 1000003 / F.lit(1000003.0) * F.lit(19.0)


def lat_sql(key: str) -> str:
    return f"(8e0 + (({key}) * 7919) % 1000003 / 1000003e0 * 27e0)"


def lon_sql(key: str) -> str:
    return f"(69e0 + (({key}) * 104729) % 1000003 / 1000003e0 * 19e0)"


# ----------------------------------------------------------- hex grid in SQL


def plane_cell_sql(x: str, y: str, level: int) -> str:
    """SQL for the packed cell id of a plane point, as a scalar subquery over named steps."""
    s = hexgrid.side_km(level)
    q0 = f"(({x}) * {num(3 ** 0.5 / 3)} - ({y}) * {num(1 / 3)}) / {num(s)}"
    r0 = f"({y}) * {num(2 / 3)} / {num(s)}"
    return (
        f"(SELECT {level * 2**56} + (CASE WHEN dq > dr AND dq > dt THEN -rr - rt ELSE rq END)::BIGINT * 268435456 + {2**55}"
        f" + (CASE WHEN dq > dr AND dq > dt THEN rr WHEN dr > dt THEN -rq - rt ELSE rr END)::BIGINT + {2**27}"
        f" FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rt - t) AS dt FROM"
        f" (SELECT *, floor(q + 0.5e0) AS rq, floor(r + 0.5e0) AS rr, floor(t + 0.5e0) AS rt FROM"
        f" (SELECT q, r, -q - r AS t FROM (SELECT {q0} AS q, {r0} AS r)))))"
    )


def cell_sql(lat: str, lon: str, level: int) -> str:
    x = f"radians({lon}) * {num(hexgrid.RADIUS_KM)}"
    y = f"sin(radians({lat})) * {num(hexgrid.RADIUS_KM)}"
    return plane_cell_sql(x, y, level)


def q_sql(cell: str) -> str:
    return f"((({cell}) // 268435456) % 268435456 - {2**27})"


def r_sql(cell: str) -> str:
    return f"(({cell}) % 268435456 - {2**27})"


def plane_xy_sql(cell: str, level: int) -> tuple[str, str]:
    s = hexgrid.side_km(level)
    q, r = q_sql(cell), r_sql(cell)
    return f"({num(s * 3 ** 0.5)} * ({q} + {r} / 2e0))", f"({num(s * 1.5)} * {r})"


def center_sql(cell: str, level: int) -> tuple[str, str]:
    x, y = plane_xy_sql(cell, level)
    return f"degrees(asin({y} / {num(hexgrid.RADIUS_KM)}))", f"degrees({x} / {num(hexgrid.RADIUS_KM)})"


def parent_sql(cell: str, level: int, parent_level: int) -> str:
    x, y = plane_xy_sql(cell, level)
    parent = plane_cell_sql(x, y, level - 1)
    return parent if level - 1 == parent_level else parent_sql(parent, level - 1, parent_level)


def axial_sql_neighbors(cell: str, level: int) -> str:
    """SQL list of the six neighbouring ids: a step in q or r is a fixed step of the packed id."""
    return "[" + ", ".join(f"{cell} + ({dq * 2**28 + dr})" for dq, dr in hexgrid.NEIGHBOUR_OFFSETS) + "]"


# ---------------------------------------------------------------- cells, units

PRIORITY_OF = {
    "residential": "1-URGENT", "commercial": "2-HIGH", "industrial": "3-MEDIUM", "retail": "4-NOT SPECIFIED",
}


# One unit has the name of another in a different territory.
TWIN, NAMESAKE = "NATION_24", "NATION_3"


def unit_name() -> Column:
    return F.when(F.col("n_name") == TWIN, NAMESAKE).otherwise(F.col("n_name"))


UNIT_NAME = f"CASE WHEN n_name = '{TWIN}' THEN '{NAMESAKE}' ELSE n_name END"


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation")


def cell_places(customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Cells with unit, people and position, without the evidence from orders."""
    key = F.col("c_custkey")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("cell"), unit_name().alias("unit"), F.col("n_regionkey").alias("state"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("population"), lat_of(key).alias("lat"), lon_of(key).alias("lon"),
        F.lit(5.0).alias("area_km2"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell table: a customer is a cell, its nation the unit, the region the territory."""
    orders = table(spark, sf, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    evidence = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("poi_count"),
        (F.avg(price) / 1e4).alias("night_lights"),
        (F.sum(price) / 1e5).alias("road_km"),
        F.sum(F.when(status == "F", price).otherwise(0.0)).alias("building_area_m2"),
        F.count_if(status == "F").cast("double").alias("building_count"),
        F.count_if(status == "O").cast("double").alias("poi_amenity_bank"),
        F.count_if(status == "P").cast("double").alias("poi_office"),
        *[
            F.least(F.sum(F.when(F.col("o_orderpriority") == p, price).otherwise(0.0)) / 5e5, F.lit(1.5)).alias(f"landuse_{c}")
            for c, p in PRIORITY_OF.items()
        ],
    )
    names = [c for c in evidence.columns if c != "o_custkey"]
    placed = cell_places(table(spark, sf, "customer"), nations(spark, sf))
    filled = placed.join(evidence, F.col("cell") == F.col("o_custkey"), "left").drop("o_custkey").fillna(0.0, subset=names)
    return filled.withColumn(
        "building_share", F.least(F.col("building_area_m2") / F.lit(2e6), F.lit(1.5))
    ).withColumn("intensity_raw", F.lit(1.0) + F.col("night_lights") + F.col("poi_count") * 0.1)


_EVIDENCE_COLUMNS = [
    "poi_count", "night_lights", "road_km", "building_area_m2", "building_count", "poi_amenity_bank", "poi_office",
    *[f"landuse_{c}" for c in PRIORITY_OF],
]

CELLS = f"""ev AS (SELECT o_custkey, count(*)::DOUBLE AS poi_count, avg(o_totalprice) / 1e4 AS night_lights,
  sum(o_totalprice) / 1e5 AS road_km,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0e0 END) AS building_area_m2,
  (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS building_count,
  (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE AS poi_amenity_bank,
  (count(*) FILTER (o_orderstatus = 'P'))::DOUBLE AS poi_office,
  {", ".join(f"least(sum(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice ELSE 0e0 END) / 5e5, 1.5e0) AS landuse_{c}" for c, p in PRIORITY_OF.items())}
  FROM orders GROUP BY o_custkey),
cells AS (SELECT *, 1e0 + night_lights + poi_count * 0.1e0 AS intensity_raw FROM (SELECT c_custkey AS cell, {UNIT_NAME} AS unit, n_regionkey AS state,
  greatest(c_acctbal, 0e0) AS population, {lat_sql("c_custkey")} AS lat, {lon_sql("c_custkey")} AS lon, 5e0 AS area_km2,
  {", ".join(f"coalesce({c}, 0e0) AS {c}" for c in _EVIDENCE_COLUMNS)},
  least(coalesce(building_area_m2, 0e0) / 2e6, 1.5e0) AS building_share
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ev ON o_custkey = c_custkey))"""


def total_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Published rows before aggregation: one per order, under the customer's nation."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        unit_name().alias("unit"), F.col("n_regionkey").alias("state"), F.col("o_orderkey").alias("ord"),
        F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("source_name"),
        F.col("o_totalprice").alias("y_crore"),
    )


TOTAL_ROWS = f"""total_rows AS (SELECT {UNIT_NAME} AS unit, n_regionkey AS state, o_orderkey AS ord,
  o_orderpriority || '/' || o_orderkey AS source_name, o_totalprice AS y_crore
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Published totals; amounts are decimals and summed as such, so that the order of the rows does not show."""
    total = F.sum(F.col("y_crore").cast("decimal(28,10)")).cast("double")
    return total_rows(spark, sf).groupBy("state", "unit").agg(total.alias("y_crore")).withColumn("y_inr", F.col("y_crore") * 1e7)


TOTALS = (
    TOTAL_ROWS
    + ",\ntotals AS (SELECT state, unit, sum(y_crore) AS y_crore, sum(y_crore) * 1e7 AS y_inr FROM total_rows GROUP BY ALL)"
)

ALLOCATED = """factors AS (SELECT state, unit, y_crore, y_inr, y_inr / greatest(z, 1e-9) AS dasymetric_scale FROM
  (SELECT state, unit, sum(intensity_raw * population) AS z FROM cells GROUP BY ALL) JOIN totals USING (state, unit)),
allocated AS (SELECT c.*, y_crore, y_inr, dasymetric_scale, intensity_raw * population AS gdp_inr_raw,
  intensity_raw * population * dasymetric_scale AS gdp_inr,
  intensity_raw * population * dasymetric_scale / 1e7 AS gdp_crore,
  CASE WHEN population > 0 THEN round(intensity_raw * population * dasymetric_scale / population / 1e7, 4) END AS pci
  FROM cells c JOIN factors USING (state, unit))"""

RANKED = """live AS (SELECT cell, state, pci, rank() OVER (PARTITION BY state ORDER BY pci) AS rk,
  count(*) OVER (PARTITION BY state, pci) AS ties, count(*) OVER (PARTITION BY state) AS n FROM allocated WHERE population > 0),
ranked AS (SELECT a.*, coalesce((rk + (ties - 1) / 2e0) / n * 100e0, 0e0) AS wealth_index
  FROM allocated a LEFT JOIN live l ON a.cell = l.cell)"""


def allocated(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with the published totals split over them; ``pci`` in crore, rounded so that ties are ties."""
    from dasyspark.operators.allocate import dasymetric_allocate

    out = dasymetric_allocate(cells(spark, sf), totals(spark, sf), units=nations(spark, sf))
    return out.withColumn("y_crore", F.col("y_inr") / 1e7).withColumn("pci", F.round(F.col("gdp_per_capita_inr") / 1e7, 4))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    from dasyspark.operators.ranks import wealth_index

    return wealth_index(materialize(allocated(spark, sf), "allocated"), ("state",), "pci")


# --------------------------------------------------------------- hexagon cells


def hexcells(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied hexagons of the grid, with the people living there."""
    base = cells(spark, sf)
    hexagon = hexgrid.point_to_cell(F.col("lat"), F.col("lon"), LEVEL)
    return base.groupBy(hexagon.alias("cell")).agg(
        F.sum("population").alias("population"), F.sum("poi_count").alias("poi_count"),
        F.max("night_lights").alias("night_lights"), F.sum("road_km").alias("road_km"), F.min("unit").alias("unit"),
    )


HEXCELLS = (
    CELLS
    + f""",
hexcells AS (SELECT cell, sum(population) AS population, sum(poi_count) AS poi_count, max(night_lights) AS night_lights,
  sum(road_km) AS road_km, min(unit) AS unit FROM
  (SELECT {cell_sql("c.lat", "c.lon", LEVEL)} AS cell, population, poi_count, night_lights, road_km, unit FROM cells c) GROUP BY cell)"""
)

# ------------------------------------------------------------------- fine grid


def fine_grid(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "fine-grid", _fine_grid)


def _fine_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Finer id grid: line items as children (resolution 8), some given only at resolution 6."""
    okey, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    digits = [F.floor(okey / F.lit(7**k)) % 7 for k in range(6, -1, -1)] + [line % 7]
    number = F.lit((1 << 59) + (1 << 21) - 1).cast("bigint") + F.shiftleft(okey % 122, 45)
    fine, rough = number + F.lit(8 << 52), number + F.lit(6 << 52)
    for i, d in enumerate(digits):
        fine = fine + F.shiftleft(d.cast("bigint"), 42 - 3 * i)
        rough = rough + F.shiftleft(d.cast("bigint") if i < 6 else F.lit(7).cast("bigint"), 42 - 3 * i)
    number = F.when(line == 5, rough).otherwise(fine)
    weight = F.when(line == 3, None).when(line == 4, 0.0).otherwise(F.col("l_quantity"))
    return dealt(spark, sf, "lineitem").select(
        F.lower(F.hex(number)).alias("h3"), F.col("l_extendedprice").alias("population"),
        (F.col("l_extendedprice") / 3e3).alias("night_lights"), weight.alias("pixel_count"),
    )


def _id_sql(resolution: int, known: int) -> str:
    digits = [f"((l_orderkey // {7**k}) % 7)" for k in range(6, -1, -1)] + ["(l_linenumber % 7)"]
    parts = [f"({(1 << 59) + (resolution << 52) + (1 << 21) - 1})::BIGINT", "((l_orderkey % 122)::BIGINT << 45)"]
    parts += [f"(({d if i < known else '7'})::BIGINT << {42 - 3 * i})" for i, d in enumerate(digits)]
    return "lower(to_hex(" + " + ".join(parts) + "))"


FINE_GRID = f"""fine_grid AS (SELECT CASE WHEN l_linenumber = 5 THEN {_id_sql(6, 6)} ELSE {_id_sql(8, 8)} END AS h3,
  CASE WHEN l_linenumber = 5 THEN 6 ELSE 8 END AS res, {_id_sql(7, 7)} AS parent7, {_id_sql(6, 6)} AS parent6, {_id_sql(5, 5)} AS parent5,
  l_extendedprice AS population, l_extendedprice / 3e3 AS night_lights,
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0e0 ELSE l_quantity END AS pixel_count FROM lineitem)"""

# -------------------------------------------------------------------- elements

_TAGS = {
    "highway": ("l_returnflag = 'A'", ("primary", "residential", "trunk_link", "footway", "motorway")),
    "building": ("l_returnflag <> 'A' AND l_suppkey % 2 = 0", ("yes", "no", "house", "shed", "hut")),
    "landuse": ("l_returnflag = 'R'", ("residential", "Commercial", "farmland", "RETAIL", "industrial")),
    "amenity": ("l_partkey % 3 = 0", ("cafe", "Bank", "parking", "theater", "")),
    "shop": ("l_partkey % 4 = 1", ("mall", "Jewellery", "bakery", "supermarket", "convenience")),
    "office": ("l_suppkey % 5 = 2", ("company", "", "ngo", "yes", "lawyer")),
    "surface": ("l_suppkey % 3 = 0", ("paved", "gravel", "sand", "asphalt", "dirt")),
}


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return _elements(dealt(spark, sf, "lineitem"))


def _elements(lines: DataFrame) -> DataFrame:
    """Mapped elements: each line item is a way of up to seven vertices, or a node; row by row, so nothing is written or moved."""
    k = F.col("l_orderkey")
    line = F.col("l_linenumber")
    entries = []
    for key, (condition, values) in _TAGS.items():
        choice = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("l_quantity").cast("int") % 5 + 1))
        entries.append(F.when(F.expr(condition), F.struct(F.lit(key).alias("key"), choice.alias("value"))))
    tags = F.map_from_entries(F.array_compact(F.array(*entries)))
    way = F.col("l_linestatus") == "O"
    ring = F.transform(
        F.sequence(F.lit(0), line - 1),
        lambda i: F.struct(
            (lat_of(k) + ((F.col("l_partkey") + i * 3) % 5) * F.lit(0.01)).alias("lat"),
            (lon_of(k) + ((F.col("l_suppkey") + i * i) % 7) * F.lit(0.01)).alias("lon"),
        ),
    )
    # Tags come out of a generator, since a filter on them would else make the map anew for every tag it looks at.
    return lines.select("*", F.explode_outer(F.array(tags)).alias("tags")).select(
        F.when(way, "way").otherwise("node").alias("type"),
        (k * 10 + line).alias("id"),
        F.when(~way, lat_of(k)).alias("lat"), F.when(~way, lon_of(k)).alias("lon"),
        "tags", F.when(way, ring).alias("geometry"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("ship"),
    )


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The elements of two overlapping tiles: a third of them lie in both, there without tags and geometry.

    Derived row by row from the written table, not dealt out, so that a row has one place in every scan.
    """
    first = _elements(table(spark, sf, "lineitem")).withColumn("tile", F.lit(0))
    again = first.where(F.col("id") % 3 == 0).withColumns({
        "tile": F.lit(1), "part": F.col("part") + 1_000_000, "lat": F.lit(20.0), "lon": F.lit(75.0),
        "tags": F.create_map(F.lit("amenity"), F.lit("cafe")), "geometry": F.lit(None).cast(first.schema["geometry"].dataType),
    })
    return again.unionByName(first)


def _tag_sql(key: str) -> str:
    condition, values = _TAGS[key]
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN {condition} THEN ([{listed}])[(l_quantity::INT % 5) + 1] END AS {key}"


ELEMENTS = f"""elements AS (SELECT row_number() OVER () AS uid, CASE WHEN l_linestatus = 'O' THEN 'way' ELSE 'node' END AS type,
  l_orderkey * 10 + l_linenumber AS id, {", ".join(_tag_sql(k) for k in _TAGS)},
  CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END AS n_vertices,
  {lat_sql("l_orderkey")} AS lat0, {lon_sql("l_orderkey")} AS lon0, l_partkey AS part, l_suppkey AS supp, l_shipdate AS ship FROM lineitem),
vertices AS (SELECT uid, i, lat0 + ((part + i * 3) % 5) * 0.01e0 AS lat, lon0 + ((supp + i * i) % 7) * 0.01e0 AS lon
  FROM (SELECT *, unnest(range(n_vertices)) AS i FROM elements)),
placed AS (SELECT e.*, coalesce(v.clat, CASE WHEN type = 'node' THEN lat0 END) AS lat, coalesce(v.clon, CASE WHEN type = 'node' THEN lon0 END) AS lon
  FROM elements e LEFT JOIN (SELECT uid, avg(lat) AS clat, avg(lon) AS clon FROM vertices GROUP BY uid) v USING (uid)),
pieces AS (SELECT a.uid, a.i, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM vertices a JOIN vertices b ON a.uid = b.uid AND b.i = a.i + 1)"""
