"""Names, numbers, scalar helpers, settings and readers of published tables."""

from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions import names as S
from dasyspark.functions import numbers as N
from dasyspark.session import scratch_path
from dasyspark.sources import grids, sheets, totals
from registry.core import CELLS, cells, dealt, nations, num, query, table, with_ctes


def documents(spark, sf):
    return table(spark, sf, "documents")


_FOLD = "lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g')))"


@query("fold_name", f"SELECT doc_id, md5({_FOLD}) AS folded, length({_FOLD}) AS n FROM documents")
def _(spark, sf):
    folded = documents(spark, sf).select("doc_id", S.fold_name(F.col("text")).alias("f"))
    return folded.select("doc_id", F.md5("f").alias("folded"), F.length("f").cast("bigint").alias("n"))


_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), '')"
_RAW_NAME = "'  ' || p_name || '#  ' || replace(p_brand, '#', '-') || (CASE WHEN p_size % 2 = 0 THEN '$*+' ELSE '' END)"
_KEY = f"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))), '[#$*+]+', '', 'g'), '\\s+', ' ', 'g'))"


def _raw_names(spark, sf):
    marks = F.when(F.col("p_size") % 2 == 0, "$*+").otherwise("")
    raw = F.concat(F.lit("  "), "p_name", F.lit("#  "), F.regexp_replace("p_brand", "#", "-"), marks)
    return table(spark, sf, "part").select("p_partkey", _code(), raw.alias("raw"))


def _code():
    """Two territories, each with aliases of its own for the same spellings."""
    return F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("code")


def _aliases(spark, sf):
    part = table(spark, sf, "part").where(F.col("p_size") > 40)
    alias = F.lower(F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "#", "-")))
    return part.groupBy(_code(), alias.alias("alias")).agg(F.min("p_type").alias("canonical"))


_CODE = "CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS code"
_ALIASES = f"al AS (SELECT {_CODE}, lower(p_name || ' ' || replace(p_brand, '#', '-')) AS alias, min(p_type) AS canonical FROM part WHERE p_size > 40 GROUP BY ALL)"


@query("norm_unit_name", with_ctes(
    f"SELECT p_partkey, coalesce(canonical, {_TITLE.format('k')}) AS unit FROM keyed LEFT JOIN al ON k = alias AND keyed.code = al.code", _ALIASES,
    f"keyed AS (SELECT p_partkey, code, {_KEY} AS k FROM (SELECT p_partkey, {_CODE}, {_RAW_NAME} AS raw FROM part))"))
def _(spark, sf):
    return S.norm_unit_name(_raw_names(spark, sf), "raw", _aliases(spark, sf)).select("p_partkey", "unit")


@query("join_rename", with_ctes(
    f"SELECT p_partkey, coalesce(canonical, lower(p_name || ' ' || replace(p_brand, '#', '-'))) AS unit FROM (SELECT *, {_CODE} FROM part) p LEFT JOIN al ON alias = lower(p_name || ' ' || replace(p_brand, '#', '-')) AND p.code = al.code", _ALIASES))
def _(spark, sf):
    from dasyspark.operators.joins import attach

    name = F.lower(F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "#", "-")))
    parts = table(spark, sf, "part").select("p_partkey", _code(), name.alias("alias"))
    out = attach(parts, _aliases(spark, sf), ["code", "alias"], "left", bound=table(spark, sf, "part"))
    return out.select("p_partkey", F.coalesce("canonical", "alias").alias("unit"))


_MONEY = "CASE WHEN o_orderkey % 11 = 0 THEN '-' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE '₹ ' || format('{:,.2f}', o_totalprice) || ' Cr' END"


def _money(spark, sf):
    key = F.col("o_orderkey")
    text = F.when(key % 11 == 0, "-").when(key % 13 == 0, None).when(key % 17 == 0, "n/a").otherwise(
        F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2), F.lit(" Cr")))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query("parse_inr_number", f"SELECT o_orderkey, try_cast(nullif(regexp_replace({_MONEY}, '[^0-9.\\-eE]', '', 'g'), '-') AS DOUBLE) AS value FROM orders")
def _(spark, sf):
    return _money(spark, sf).select("o_orderkey", N.parse_inr_number(F.col("text")).alias("value"))


@query("to_float_lenient", f"SELECT o_orderkey, try_cast(regexp_replace({_MONEY}, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value FROM orders")
def _(spark, sf):
    return _money(spark, sf).select("o_orderkey", N.to_float_lenient(F.col("text")).alias("value"))


@query("clean_ws", """SELECT doc_id, md5(trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))) AS cleaned FROM
  (SELECT doc_id, CASE WHEN lang <> 'de' THEN text END AS t FROM documents)""")
def _(spark, sf):
    text = F.when(F.col("lang") != "de", F.col("text"))
    return documents(spark, sf).select("doc_id", F.md5(S.clean_ws(text)).alias("cleaned"))


@query("slug", r"""SELECT doc_id, md5(CASE WHEN s = '' THEN 'unknown' ELSE s END) AS slug FROM
  (SELECT doc_id, lower(trim(regexp_replace(strip_accents(text), '[^A-Za-z0-9]+', '-', 'g'), '-')) AS s FROM documents)""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(S.slug(F.col("text"))).alias("slug"))


_METRICS = ["population", "poi_count", "wealth_index", "gdp_crore", "landuse_residential", "poi_amenity_guest_house2x", "custom", "building_share"]


@query("short_key", f"""SELECT event_id, CASE WHEN m = 'population' THEN 'p' WHEN m = 'poi_count' THEN 'poi' WHEN m = 'wealth_index' THEN 'w' WHEN m = 'gdp_crore' THEN 'c'
  WHEN m = 'building_share' THEN 'bsh' WHEN m LIKE 'landuse_%' THEN 'lu_' || substr(m, 9, 3)
  WHEN m LIKE 'poi_%' THEN 'pg_' || substr(regexp_replace(substr(m, 5), '[^a-z]', '', 'g'), 1, 10) ELSE m END AS short FROM
  (SELECT event_id, ({_METRICS})[(user_id % 8)::INT + 1] || CASE WHEN value > 50 AND user_id % 8 IN (4, 5) THEN event_type ELSE '' END AS m FROM events)""")
def _(spark, sf):
    base = F.element_at(F.array(*[F.lit(m) for m in _METRICS]), (F.col("user_id") % 8 + 1).cast("int"))
    tail = F.when((F.col("value") > 50) & (F.col("user_id") % 8).isin(4, 5), F.col("event_type")).otherwise("")
    return table(spark, sf, "events").select("event_id", N.short_key(F.concat(base, tail)).alias("short"))


@query("source_line", """SELECT o_orderkey, concat_ws(', ', 'FY ' || y, b || ' prices' || coalesce(' (base ' || base || ')', '')) AS line FROM
  (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) || '-' || substr((year(o_orderdate) + 1)::VARCHAR, 3, 2) END AS y,
   CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderstatus = 'F' THEN 'constant' ELSE 'current' END END AS b,
   CASE WHEN o_totalprice > 200000 THEN '2011-12' END AS base FROM orders)""")
def _(spark, sf):
    year = F.year("o_orderdate")
    fy = F.when(F.col("o_orderstatus") != "P", F.concat(year.cast("string"), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2)))
    basis = F.when(F.col("o_orderpriority") != "5-LOW", F.when(F.col("o_orderstatus") == "F", "constant").otherwise("current"))
    base = F.when(F.col("o_totalprice") > 200000, "2011-12")
    return table(spark, sf, "orders").select("o_orderkey", S.source_line(fy, basis, base).alias("line"))


@query("unit_scale", "SELECT o_orderkey, o_totalprice * 1e7 AS inr, o_totalprice * 1e7 / 1e7 AS crore, o_totalprice * 0.01e0 AS from_lakh FROM orders")
def _(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", N.crore_to_inr(price).alias("inr"), N.inr_to_crore(N.crore_to_inr(price)).alias("crore"), N.lakh_to_crore(price).alias("from_lakh"))


_Z = "(l_extendedprice - 50000e0) / 10000e0"


@query("softplus", f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN {_Z} > 0 THEN {_Z} + ln(1 + exp(-({_Z}))) ELSE ln(1 + exp({_Z})) END, 9) AS s FROM lineitem")
def _(spark, sf):
    z = (F.col("l_extendedprice") - 50000.0) / 10000.0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(N.softplus(z), 9).alias("s"))


@query("elu", f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN {_Z} > 0 THEN {_Z} ELSE exp({_Z}) - 1 END, 9) AS s FROM lineitem")
def _(spark, sf):
    z = (F.col("l_extendedprice") - 50000.0) / 10000.0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(N.elu(z), 9).alias("s"))


@query("exists_flag", with_ctes("SELECT cell, CASE WHEN building_area_m2 > 0 THEN 1e0 ELSE 0e0 END AS flag FROM cells", CELLS))
def _(spark, sf):
    return cells(spark, sf).select("cell", N.exists_flag(F.col("building_area_m2")).alias("flag"))


@query("log_magnitude", with_ctes("SELECT cell, round(CASE WHEN population > 0 THEN log10(population) ELSE 0e0 END, 9) AS mag FROM cells", CELLS))
def _(spark, sf):
    return cells(spark, sf).select("cell", F.round(N.log_magnitude(F.col("population")), 9).alias("mag"))


_AREA = "CASE WHEN l_linenumber = 7 THEN 0e0 ELSE l_quantity / 100e0 END"


@query("safe_ratio_clip", f"SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(least(greatest(l_extendedprice / nullif({_AREA} * 1e6, 0), 0e0), 1.5e0), 0e0), 13) AS share FROM lineitem")
def _(spark, sf):
    area = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") / 100.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(N.safe_ratio_clip(F.col("l_extendedprice"), area), 13).alias("share"))


@query("safe_density", f"SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_quantity / nullif({_AREA}, 0), 0e0), 9) AS density FROM lineitem")
def _(spark, sf):
    area = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") / 100.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(N.safe_density(F.col("l_quantity"), area), 9).alias("density"))


@query("round_pack", """SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2e0, 0) AS poi, round_even(l_quantity / 4e0, 1) AS p,
  round_even(l_quantity / 16e0, 3) AS nl, l_tax AS other FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.round_pack(F.col("l_quantity") / 2.0, "poi").alias("poi"),
        N.round_pack(F.col("l_quantity") / 4.0, "p").alias("p"), N.round_pack(F.col("l_quantity") / 16.0, "nl").alias("nl"),
        N.round_pack(F.col("l_tax"), "unknown").alias("other"))


# ------------------------------------------------------------------- settings

_TERRITORY = "CASE n_regionkey WHEN 0 THEN 'MH' WHEN 1 THEN 'UP' WHEN 2 THEN 'BR' WHEN 3 THEN 'DL' ELSE 'WB' END"
_SETTINGS = "t AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', {num(r[3][0])}, {num(r[3][1])}, {'NULL' if r[6] is None else repr(r[6])}, {r[8] is not None})" for r in C.TERRITORIES
) + ") v(code, name, pop_lo, pop_hi, dissolve_to, skipped))"


def _coded(spark, sf):
    k = F.col("n_regionkey")
    code = F.when(k == 0, "MH").when(k == 1, "UP").when(k == 2, "BR").when(k == 3, "DL").otherwise("WB")
    return table(spark, sf, "customer").join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        code.alias("code"), "n_name", "c_acctbal")


@query("read_config", with_ctes(
    f"""SELECT code, name, coalesce(dissolve_to, n_name) AS unit, skipped, count(*) AS customers, pop_lo, pop_hi FROM
    (SELECT {_TERRITORY} AS code, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN t USING (code) GROUP BY ALL""", _SETTINGS))
def _(spark, sf):
    """Territory settings applied to the customers of each territory."""
    joined = _coded(spark, sf).join(C.territory_table(spark), "code")
    unit = F.coalesce("dissolve_to", "n_name").alias("unit")
    return joined.groupBy("code", "name", unit, F.col("skip_reason").isNotNull().alias("skipped"), "pop_lo", "pop_hi").agg(
        F.count(F.lit(1)).alias("customers"))


@query("population_sanity", with_ctes(
    f"""SELECT code, round(p, 2) AS total, CASE WHEN p BETWEEN pop_lo * 0.5e6 AND pop_hi * 1.6e6 THEN 'ok' ELSE 'warn' END AS verdict FROM
    (SELECT {_TERRITORY} AS code, sum(greatest(c_acctbal, 0) * 1e2) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) JOIN t USING (code)""", _SETTINGS))
def _(spark, sf):
    from dasyspark.operators.evidence import population_sanity

    people = _coded(spark, sf).select("code", (F.greatest("c_acctbal", F.lit(0.0)) * 1e2).alias("population"))
    out = population_sanity(people, C.territory_table(spark).select("code", "pop_lo", "pop_hi"), ["code"])
    return out.select("code", F.round("total", 2).alias("total"), "verdict")


# ---------------------------------------------------- readers of written files


@query("scan_geojson_features", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN c_name WHEN c_custkey % 4 = 2 THEN c_custkey::VARCHAR ELSE '' END AS name,
  CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 3 END AS n_properties, CASE WHEN c_custkey % 3 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS n_parts, CASE WHEN c_custkey % 3 = 1 THEN 10 ELSE 5 END AS n_vertices FROM customer""")
def _(spark, sf):
    """Customers written as FeatureCollections, then read back as features."""
    k = F.col("c_custkey")
    properties = F.when(k % 4 == 0, F.create_map(F.lit("shapeName"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("id"), k.cast("string")))
    properties = properties.when(k % 4 == 1, F.create_map(F.lit("shapeName"), F.lit(""), F.lit("name"), F.col("c_name"), F.lit("id"), k.cast("string")))
    properties = properties.when(k % 4 == 2, F.create_map(F.lit("NAME_1"), k.cast("string"), F.lit("shapeISO"), F.lit("X"), F.lit("id"), k.cast("string")))
    x, y = (k % 360).cast("double"), F.col("c_nationkey").cast("double")
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1), F.array(x, k.cast("double")))
    several = k % 3 == 1
    other = F.transform(ring, lambda p: F.array(p[0] + 2, p[1]))
    coordinates = F.when(several, F.to_json(F.array(F.array(other), F.array(ring)))).otherwise(F.to_json(F.array(ring)))
    document = F.concat(
        F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": '),
        F.coalesce(F.to_json(properties), F.lit("null")), F.lit(', "geometry": {"type": "'),
        F.when(several, "MultiPolygon").otherwise("Polygon"), F.lit('", "coordinates": '), coordinates, F.lit("}}]}"))
    path = scratch_path(spark, "geojson")
    table(spark, sf, "customer").select(document.alias("value")).write.text(path)
    read = totals.scan_geojson_features(spark, path, one_document_per_line=True)
    ring = F.element_at(F.col("polygons"), -1)[0]
    vertices = F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p[0]))
    return read.select(
        F.element_at(F.element_at(ring, -1), 2).cast("bigint").alias("c_custkey"), "name", F.size("properties").alias("n_properties"),
        F.col("geometry.type").alias("kind"), F.size("polygons").alias("n_parts"), vertices.alias("n_vertices"))


@query("feature_rings", """SELECT s_name AS unit, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END AS rings, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END - (s_suppkey % 2) AS parts,
  CASE WHEN s_suppkey % 3 = 0 THEN 9 ELSE 6 END AS vertices FROM supplier""")
def _(spark, sf):
    """Suppliers as features of two or three triangles, in polygons of their own or as holes, then as ring rows."""
    k = F.col("s_suppkey")
    triangle = lambda i: F.array(*[F.array(k * 1.0 + i + x, F.lit(y)) for x, y in ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5))])
    alone = F.array(triangle(1))
    first = F.when(k % 2 == 1, F.array(triangle(0), triangle(3))).otherwise(F.array(triangle(0)))
    rest = F.when(k % 2 == 1, F.when(k % 3 == 0, F.array(alone)).otherwise(F.array().cast("array<array<array<array<double>>>>")))
    rest = rest.otherwise(F.when(k % 3 == 0, F.array(alone, alone)).otherwise(F.array(alone)))
    features = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.concat(F.array(first), rest).alias("polygons"))
    rings = totals.feature_rings(features)
    return rings.groupBy("unit").agg(
        F.count(F.lit(1)).cast("int").alias("rings"), F.count_distinct("part").cast("int").alias("parts"), F.sum(F.size("ring")).cast("int").alias("vertices"))


@query("scan_ckan_records", f"""SELECT nm AS source_name, v AS y_crore, p AS note FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'Grand TOTAL ' || o_orderkey WHEN o_orderkey % 7 = 0 THEN 'Nashik Div. ' || o_orderkey
    WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'Unit ' || o_orderkey END AS nm,
    try_cast(nullif(regexp_replace(m, '[^0-9.\\-eE]', '', 'g'), '-') AS DOUBLE) AS v, m, o_orderpriority AS p FROM (SELECT *, {_MONEY} AS m FROM orders))
  WHERE nm IS NOT NULL AND m IS NOT NULL AND NOT regexp_matches(lower(nm), 'div\\.|includes|revised|estimates|total|state')""")
def _(spark, sf):
    """Orders written as record documents (both layouts), then read back as totals."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("Grand TOTAL "), k.cast("string"))).when(
        k % 7 == 0, F.concat(F.lit("Nashik Div. "), k.cast("string"))).when(k % 8 == 0, None).otherwise(F.concat(F.lit("Unit "), k.cast("string")))
    rows = table(spark, sf, "orders").join(_money(spark, sf), "o_orderkey")
    record = F.array(F.struct(k.alias("_id"), name.alias("District"), F.col("text").alias("Real value"), F.col("o_orderpriority").alias("note")))
    nested = F.to_json(F.struct(F.struct(record.alias("records")).alias("result")))
    flat = F.to_json(F.struct(record.alias("records")))
    path = scratch_path(spark, "ckan")
    rows.select(F.when(k % 2 == 0, nested).otherwise(flat).alias("value")).write.text(path)
    read = totals.scan_ckan_records(spark, path, "District", "Real value", fields=["note"], one_document_per_line=True)
    return read.select("source_name", "y_crore", "note")


@query("scan_dropin_csv", f"SELECT 'Unit, \"' || o_orderkey || '\"' AS source_name, try_cast(nullif(regexp_replace({_MONEY}, '[^0-9.\\-eE]', '', 'g'), '-') AS DOUBLE) AS y_crore FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "dropin")
    name = F.concat(F.lit('Unit, "'), F.col("o_orderkey").cast("string"), F.lit('"'))
    _money(spark, sf).select(name.alias("place"), F.col("text").alias("amount"), F.lit(1).alias("other")).write.option(
        "header", True).option("escape", '"').csv(path)
    return totals.scan_dropin_csv(spark, path)


@query("scan_parsed_records", """SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS district, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS source_name, c_acctbal AS y_crore FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    even = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("district"), F.col("c_acctbal").alias("y_crore"), F.col("c_mktsegment").alias("source_name"))).alias("records"), F.lit("2023-24").alias("year")))
    odd = F.to_json(F.struct(F.array(F.struct(F.col("c_mktsegment").alias("District"), F.col("c_acctbal").alias("y_crore"))).alias("records")))
    path = scratch_path(spark, "parsed")
    table(spark, sf, "customer").select(F.when(k % 2 == 0, even).otherwise(odd).alias("value")).write.text(path)
    return totals.scan_parsed_records(spark, path, one_document_per_line=True)


@query("resolve_aliased_columns", "SELECT c_custkey::VARCHAR AS h3, c_acctbal AS population FROM customer")
def _(spark, sf):
    odd = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("Hex_ID"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("POP"))
    return grids.resolve_aliased_columns(odd)


# -------------------------------------------------------- sheets and documents


def _matrix(spark, sf):
    """One sheet per customer group of eight columns: a title, a header row of names, sub-totals, totals."""
    order = dealt(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice")
    names = [F.concat(F.lit(f"  Unit  {i} of "), k) for i in range(5)] + [F.lit("Western Region"), F.lit("ALL"), F.lit("")]
    values = [F.format_number(price * (i + 1), 2) for i in range(4)] + [F.lit("-"), F.lit("9"), F.lit("8"), F.lit("7")]
    label = F.lit("GROSS  DOMESTIC PRODUCT (sub)")
    row = lambda i, *c: F.struct(F.lit(i).alias("row_idx"), F.array(*c).alias("cells"))
    rows = F.array(
        row(0, F.lit("Title"), F.lit("of the sheet"), F.lit("x"), F.lit("y")),
        row(1, F.lit("no"), F.lit("name"), *names),
        row(2, F.lit("1"), label, *[F.lit("1")] * 8),
        row(3, F.lit("2"), F.lit("agriculture"), *[F.lit("2")] * 8),
        row(4, F.lit("3"), F.lit("Gross domestic product"), *values),
    )
    return order.select(F.col("o_orderkey").alias("sheet_id"), F.inline(rows))


@query("matrix_to_long", """SELECT o_orderkey AS sheet_id, 'Unit ' || i || ' of ' || o_orderkey AS district, round(round(o_totalprice * (i + 1), 2) * 0.01e0, 6) AS y_crore,
  'Unit ' || i || ' of ' || o_orderkey || ' — Gross domestic product' AS source_name FROM orders, (SELECT unnest(range(4)) AS i)""")
def _(spark, sf):
    out = sheets.matrix_to_long(_matrix(spark, sf), "gross domestic product", ["all"], 0.01)
    return out.select("sheet_id", "district", F.round("y_crore", 6).alias("y_crore"), "source_name")


def _uneven(spark, sf):
    """The same sheets, of which every fifth has no header, every seventh no value row, and every eleventh no values."""
    k, i = F.col("sheet_id"), F.col("row_idx")
    rows = _matrix(spark, sf)
    cells = F.when((k % 5 == 0) & (i == 1), F.slice("cells", 1, 4)).when((k % 7 == 0) & (i.isin(2, 4)), F.array(F.lit("4"), F.lit("other"))).when(
        (k % 11 == 0) & (i == 4), F.slice("cells", 1, 2)).otherwise(F.col("cells"))
    return rows.withColumn("cells", cells)


@query("unreadable_matrices", """SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 5 = 0 THEN 'no_header' WHEN o_orderkey % 7 = 0 THEN 'no_value_row' ELSE 'no_values' END AS reason
  FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def _(spark, sf):
    """Sheets that give no totals, with the reason, beside those that do."""
    return sheets.unreadable_matrices(_uneven(spark, sf), "gross domestic product", ["all"])


def _tables(spark, sf):
    row = lambda i, *c: F.struct(F.lit(i).alias("row_idx"), F.array(*c).alias("cells"))
    k = F.col("c_custkey").cast("string")
    rows = F.array(
        row(0, F.lit("A title"), F.lit(None).cast("string"), F.lit("")),
        row(1, F.lit("No"), F.lit(" District "), F.lit("Nominal  GDP")),
        row(2, F.lit("1"), F.col("c_name"), F.col("c_acctbal").cast("string")),
        row(3, F.lit("2"), F.concat(F.lit(" Second  of "), k), F.lit("12,345.5")),
        row(4, F.lit("3"), F.lit("Total"), F.lit("99")), row(5, F.lit("4"), F.lit(""), F.lit("5")), row(6, F.lit("5"), F.lit("short")),
    )
    return dealt(spark, sf, "customer").select(F.col("c_custkey").alias("sheet_id"), F.inline(rows))


@query("headed_table", """SELECT c_custkey AS sheet_id, 2 AS row_idx, c_name AS district, c_acctbal AS y_crore, 'nominal gdp' AS source_name FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_custkey, 3, 'Second of ' || c_custkey, 12345.5e0, 'nominal gdp' FROM customer""")
def _(spark, sf):
    return sheets.headed_table(_tables(spark, sf), "District", "nominal gdp", ["total"])


@query("unreadable_tables", """SELECT c_custkey AS sheet_id, CASE WHEN c_custkey % 5 = 0 THEN 'no_header' ELSE 'no_values' END AS reason FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0""")
def _(spark, sf):
    k, i = F.col("sheet_id"), F.col("row_idx")
    rows = _tables(spark, sf).withColumn("cells", F.when((k % 5 == 0) & (i == 1), F.slice("cells", 1, 2)).when(
        (k % 7 == 0) & i.isin(2, 3), F.slice("cells", 1, 2)).otherwise(F.col("cells")))
    return sheets.unreadable_tables(rows, "District", "nominal gdp", ["total"])


def _pages(spark, sf):
    """A page per customer, its table rows built from the customer and one repeated name."""
    k = F.col("c_custkey").cast("string")
    letters = F.translate(k, "0123456789", "abcdefghij")
    amount = F.format_number(F.abs("c_acctbal"), 2)
    lines = F.concat_ws(
        "\n", F.lit("Report page"), F.lit("Table 3:  District Product"), F.lit("No. Name 2021-22  2022-23 2023-24"), F.lit("Base 2011-12 2012-13"),
        F.concat(F.lit(" 1 Unit "), letters, F.lit("  1 22 "), amount), F.lit("2 Shared Name 5 6 "), F.lit("3 Short row 5 6"),
        F.concat(F.lit("4 Shared name 7 8 "), k, F.lit(".25")), F.lit("5 State 1 2 3"), F.lit("6 Ab 1 2 3"), F.lit("7 Zero 1 2 0"), F.lit("free text 12"))
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page"), F.when(F.col("c_mktsegment") != "BUILDING", lines).otherwise(F.regexp_replace(lines, "Table 3", "Table 4")).alias("text"))


@query("text_line_table", """WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
  SELECT c_nationkey AS doc_id, 'Unit ' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS district, round(abs(c_acctbal) * 0.01e0, 6) AS y_crore FROM c WHERE c_acctbal <> 0
  UNION ALL SELECT c_nationkey, 'Shared name', round((max(c_custkey) || '.25')::DOUBLE * 0.01e0, 6) FROM c GROUP BY c_nationkey""")
def _(spark, sf):
    out = sheets.text_line_table(_pages(spark, sf), "Table 3: District Product", "2023-24", ["state"], 0.01)
    return out.select("doc_id", "district", F.round("y_crore", 6).alias("y_crore"))


@query("labelled_value", """SELECT doc_id, page, y_crore FROM (SELECT c_nationkey AS doc_id, min_by(c_custkey, c_custkey) AS page, min_by((c_custkey * 1000 + 1234)::DOUBLE, c_custkey) AS y_crore
  FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 GROUP BY c_nationkey)""")
def _(spark, sf):
    k = F.col("c_custkey")
    number = F.format_number(k * 1000 + 1234, 0)
    label = F.when(F.col("c_mktsegment") == "BUILDING", "GSDP at  Constant").otherwise("GSDP at current")
    year = F.when(F.col("c_acctbal") > 0, "2023-24").otherwise("2019-20")
    text = F.concat(F.lit("Summary\n 9999 Crore in 2023-24 "), label, F.lit(" (2011-12) prices rose from ₹ 1,111 Crore in 2022-23 to\n₹"), number, F.lit(" Crore in "), year)
    pages = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), k.alias("page"), text.alias("text"))
    return sheets.labelled_value(pages, "gsdp at constant", "constant", "2023-24")
