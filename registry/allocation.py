"""Targets, allocation, ranking and validation."""

from pyspark.sql import functions as F

from dasyspark.functions import numbers as N
from dasyspark.operators import allocate, joins, ranks, targets
from dasyspark.plans.disaggregate import allocate_and_rank
from registry.core import ALLOCATED, CELLS, RANKED, TOTAL_ROWS, TOTALS, UNIT_NAME, allocated, cells, nations, query, ranked, table
from registry.core import total_rows, totals, with_ctes

SPLIT = (CELLS, TOTALS, ALLOCATED)
WEALTH = (*SPLIT, RANKED)


def r(col, digits=4):
    return F.round(col, digits)


@query("agg_targets", with_ctes(
    """SELECT state, unit, round(sum(y_crore), 2) AS y_crore, min_by(source_name, ord) AS source_name, round(sum(y_crore) * 1e7 / 1e9, 3) AS y_inr_bn
    FROM total_rows WHERE y_crore > 0 GROUP BY state, unit""", TOTAL_ROWS))
def _(spark, sf):
    out = targets.agg_targets(total_rows(spark, sf), order=["ord"])
    return out.select("state", "unit", r("y_crore", 2).alias("y_crore"), "source_name", r(F.col("y_inr") / 1e9, 3).alias("y_inr_bn"))


@query("filter_positive_targets",
       "SELECT c_custkey AS id, c_acctbal AS y_crore FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal > 0")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y_crore"))
    return targets.filter_positive_targets(rows)


# Territories 0 and 3 have all three kinds of source, 1 and 2 two, 4 one; what a kind lacks it lists under a territory of its own.
@query("resolve_sources", """WITH u AS (
  SELECT CASE WHEN n_regionkey IN (0, 3) THEN n_regionkey ELSE 10 + n_regionkey END AS state, s_name AS source_name, s_acctbal AS y_crore, 0 AS priority FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT CASE WHEN n_regionkey <= 2 THEN n_regionkey ELSE 20 + n_regionkey END, c_name, c_acctbal, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, n_name, n_nationkey * 1e0, 2 FROM nation)
  SELECT state, source_name, y_crore, priority FROM u WHERE (state, priority) IN (SELECT state, min(priority) FROM u GROUP BY state)""")
def _(spark, sf):
    nation, region = nations(spark, sf), F.col("n_regionkey")
    csv = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(region.isin(0, 3), region).otherwise(region + 10).alias("state"), F.col("s_name").alias("source_name"), F.col("s_acctbal").alias("y_crore"))
    parsed = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(region <= 2, region).otherwise(region + 20).alias("state"), F.col("c_name").alias("source_name"), F.col("c_acctbal").alias("y_crore"))
    raw = nation.select(region.alias("state"), F.col("n_name").alias("source_name"), (F.col("n_nationkey") * 1.0).alias("y_crore"))
    return targets.resolve_sources([csv, parsed, raw])


@query("concat_parts", """SELECT s_name AS name, s_acctbal AS amount, NULL::VARCHAR AS segment FROM supplier
  UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer""")
def _(spark, sf):
    return targets.concat_parts([
        table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment")),
        table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount")),
    ]).select("name", "amount", "segment")


@query("district_sum", with_ctes(
    "SELECT state, unit, round(sum(intensity_raw * population), 2) AS unit_sum_raw FROM cells GROUP BY state, unit", CELLS))
def _(spark, sf):
    sums = allocate.unit_sums(cells(spark, sf), ["state", "unit"], F.col("intensity_raw") * F.col("population"))
    return sums.select("state", "unit", r("unit_sum_raw", 2).alias("unit_sum_raw"))


@query("dasymetric_allocate", with_ctes(
    """SELECT cell, unit, round(dasymetric_scale / 1e7, 4) AS scale, round(gdp_inr_raw, 4) AS gdp_inr_raw, round(gdp_crore, 2) AS gdp_crore, pci
    FROM allocated""", *SPLIT))
def _(spark, sf):
    return allocated(spark, sf).select(
        "cell", "unit", r(F.col("dasymetric_scale") / 1e7).alias("scale"), r("gdp_inr_raw").alias("gdp_inr_raw"),
        r("gdp_crore", 2).alias("gdp_crore"), "pci")


@query("population_allocate", with_ctes(
    """SELECT cell, unit, round(y_crore * population / sum(population) OVER (PARTITION BY state, unit), 2) AS gdp_crore
    FROM cells JOIN totals USING (state, unit)""", CELLS, TOTALS))
def _(spark, sf):
    out = allocate.population_allocate(cells(spark, sf), totals(spark, sf), units=nations(spark, sf))
    return out.select("cell", "unit", r("gdp_crore", 2).alias("gdp_crore"))


@query("scale_join", with_ctes("SELECT cell, unit, round(dasymetric_scale / 1e7, 4) AS scale FROM allocated", *SPLIT))
def _(spark, sf):
    base = cells(spark, sf)
    factors = allocate.unit_factors(base, totals(spark, sf)).select("state", "unit", "dasymetric_scale")
    out = joins.attach(base, factors, ["state", "unit"], "inner", nations(spark, sf))
    return out.select("cell", "unit", r(F.col("dasymetric_scale") / 1e7).alias("scale"))


@query("per_capita", with_ctes("SELECT cell, pci FROM allocated", *SPLIT))
def _(spark, sf):
    value = N.per_capita(F.col("gdp_inr"), F.col("population")) / 1e7
    return allocated(spark, sf).select("cell", r(value).alias("pci"))


@query("wealth_index", with_ctes("SELECT cell, state, round(wealth_index, 6) AS wealth_index FROM ranked", *WEALTH))
def _(spark, sf):
    return ranked(spark, sf).select("cell", "state", r("wealth_index", 6).alias("wealth_index"))


QUINTILE = "CASE WHEN wealth_index <= 20 THEN 1 WHEN wealth_index <= 40 THEN 2 WHEN wealth_index <= 60 THEN 3 WHEN wealth_index <= 80 THEN 4 ELSE 5 END"


@query("bucket_quintile", with_ctes(
    f"SELECT state, {QUINTILE} AS quintile, count(*) AS n, round(sum(population), 2) AS population FROM ranked GROUP BY ALL", *WEALTH))
def _(spark, sf):
    fifths = ranked(spark, sf).withColumn("quintile", N.bucket_quintile(F.col("wealth_index")))
    return fifths.groupBy("state", "quintile").agg(F.count(F.lit(1)).alias("n"), r(F.sum("population"), 2).alias("population"))


@query("allocate_and_rank", with_ctes(
    f"""SELECT state, unit, count(*) AS n_cells, round(sum(gdp_crore), 2) AS gdp_crore, round(max(y_crore), 2) AS y_crore,
    count(*) FILTER (population > 0) AS inhabited, round(sum(wealth_index), 3) AS wealth, max_by(cell, (round(wealth_index, 6), cell)) AS richest,
    {", ".join(f"count(*) FILTER (({QUINTILE}) = {i}) AS fifth_{i}" for i in range(1, 6))} FROM ranked GROUP BY state, unit""", *WEALTH))
def flagship(spark, sf):
    """The whole minimum job: totals, allocation, per-capita, wealth index, quintile, unit report."""
    known = totals(spark, sf)
    out = allocate_and_rank(cells(spark, sf), known, nations(spark, sf))
    index = F.col("wealth_index")
    report = out.groupBy("state", "unit").agg(
        F.count(F.lit(1)).alias("n_cells"), r(F.sum("gdp_crore"), 2).alias("gdp_crore"),
        r(F.max("y_inr") / 1e7, 2).alias("y_crore"), F.count_if(F.col("population") > 0).alias("inhabited"),
        r(F.sum(index), 3).alias("wealth"), F.max_by("cell", F.struct(F.round(index, 6), "cell")).alias("richest"),
        *[F.count_if(F.col("wealth_quintile") == i).alias(f"fifth_{i}") for i in range(1, 6)])
    return report


@query("cume_percentile", with_ctes(
    "SELECT cell, unit, round(cume_dist() OVER (PARTITION BY unit ORDER BY road_km) * 100, 6) AS pct FROM cells", CELLS))
def _(spark, sf):
    out = ranks.cume_percentile(cells(spark, sf), ["unit"], "road_km", "pct")
    return out.select("cell", "unit", r("pct", 6).alias("pct"))


_CUT = "\n".join(
    f", max(CASE WHEN rn = floor({t}e0 * (n - 1)) THEN v END) AS q{i}" for i, t in enumerate((0.02, 0.3, 0.6, 0.85, 0.99)))


@query("quantile_cuts", with_ctes(
    """SELECT state, round(q0, 6) AS cut_1, round(c1, 6) AS cut_2, round(c2, 6) AS cut_3, round(c3, 6) AS cut_4,
    round(CASE WHEN q4 <= c3 THEN c3 + 1e-9 ELSE q4 END, 6) AS cut_5 FROM (SELECT *, CASE WHEN q3 <= c2 THEN c2 + 1e-9 ELSE q3 END AS c3 FROM
    (SELECT *, CASE WHEN q2 <= c1 THEN c1 + 1e-9 ELSE q2 END AS c2 FROM (SELECT *, CASE WHEN q1 <= q0 THEN q0 + 1e-9 ELSE q1 END AS c1 FROM picked)))""",
    CELLS, f"""picked AS (SELECT state {_CUT} FROM (SELECT state, poi_count AS v, row_number() OVER (PARTITION BY state ORDER BY poi_count) - 1 AS rn,
    count(*) OVER (PARTITION BY state) AS n FROM cells) GROUP BY state)"""))
def _(spark, sf):
    out = ranks.quantile_cuts(cells(spark, sf), ["state"], "poi_count")
    return out.select("state", *[r(f"cut_{i}", 6).alias(f"cut_{i}") for i in range(1, 6)])


_RANKS = """rk AS (SELECT *, rank() OVER (PARTITION BY state ORDER BY wealth_index) + (count(*) OVER (PARTITION BY state, wealth_index) - 1) / 2e0 AS rw,
  rank() OVER (PARTITION BY state ORDER BY night_lights) + (count(*) OVER (PARTITION BY state, night_lights) - 1) / 2e0 AS rl,
  rank() OVER (PARTITION BY state ORDER BY road_km) + (count(*) OVER (PARTITION BY state, road_km) - 1) / 2e0 AS rr,
  rank() OVER (PARTITION BY state ORDER BY poi_count) + (count(*) OVER (PARTITION BY state, poi_count) - 1) / 2e0 AS rp,
  rank() OVER (PARTITION BY state ORDER BY pci) + (count(*) OVER (PARTITION BY state, pci) - 1) / 2e0 AS rg
  FROM (SELECT * REPLACE (round(wealth_index, 6) AS wealth_index, round(night_lights, 6) AS night_lights, round(road_km, 6) AS road_km) FROM ranked WHERE population > 0))"""
_PAIRS = {
    "wealth_index_vs_night_lights": ("wealth_index", "night_lights", "rw", "rl"),
    "wealth_index_vs_road_km": ("wealth_index", "road_km", "rw", "rr"),
    "wealth_index_vs_poi_count": ("wealth_index", "poi_count", "rw", "rp"),
    "gdp_per_capita_vs_night_lights": ("pci", "night_lights", "rg", "rl"),
}


@query("spearman", with_ctes(
    " UNION ALL ".join(f"SELECT '{p}' AS pair, state, round(corr({a}, {b}), 8) AS rho FROM rk GROUP BY state" for p, (_, _, a, b) in _PAIRS.items()),
    *WEALTH, _RANKS))
def _(spark, sf):
    from dasyspark.session import materialize

    base = ranked(spark, sf).where(F.col("population") > 0).withColumns(
        {c: F.round(c, 6) for c in ("wealth_index", "night_lights", "road_km")})
    base = materialize(base.select("state", "wealth_index", "night_lights", "road_km", "poi_count", "pci"), "ranked")
    out = ranks.spearman(base, ["state"], {p: v[:2] for p, v in _PAIRS.items()})
    return out.select("pair", "state", r("rho", 8).alias("rho"))


@query("filter_inhabited", with_ctes("SELECT unit, count(*) AS n, round(sum(population), 2) AS population FROM cells WHERE population > 0 GROUP BY unit", CELLS))
def _(spark, sf):
    live = cells(spark, sf).where(F.col("population") > 0)
    return live.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), r(F.sum("population"), 2).alias("population"))


@query("log_loss", with_ctes(
    """SELECT state, round(avg(power(log10(h + 1e-6) - log10(y + 1e-6), 2)), 8) AS log_loss FROM
    (SELECT state, unit, sum(intensity_raw * population) AS h, max(y_inr) AS y FROM allocated GROUP BY ALL) GROUP BY state""", *SPLIT))
def _(spark, sf):
    out = allocate.log_loss(allocated(spark, sf), ["state"])
    return out.select("state", r("log_loss", 8).alias("log_loss"))


@query("floor_penalty", with_ctes(
    """SELECT state, round(sum(population * power(greatest(0, 1 - (intensity_raw - 1) / 10), 2)) / greatest(sum(population), 1), 8) AS floor_penalty
    FROM cells GROUP BY state""", CELLS))
def _(spark, sf):
    weak = cells(spark, sf).withColumn("intensity_raw", (F.col("intensity_raw") - 1) / 10)
    return allocate.floor_penalty(weak, ["state"]).select("state", r("floor_penalty", 8).alias("floor_penalty"))


@query("reconstruction_error", with_ctes(
    "SELECT state, unit, round(abs(sum(gdp_inr) - max(y_inr)) / max(y_inr), 9) AS rel_error, round(max(y_inr) / 1e7, 2) AS y_crore FROM allocated GROUP BY state, unit", *SPLIT))
def _(spark, sf):
    out = allocate.reconstruction_error(allocated(spark, sf))
    return out.select("state", "unit", r("rel_error", 9).alias("rel_error"), r(F.col("y_inr") / 1e7, 2).alias("y_crore"))


@query("mape", with_ctes(
    """SELECT state, round(avg(abs(z - y) / greatest(abs(y), 1e-9)), 8) AS mape FROM
    (SELECT state, unit, sum(gdp_inr_raw) AS z, max(y_crore) AS y FROM allocated GROUP BY ALL) GROUP BY state""", *SPLIT))
def _(spark, sf):
    sums = allocated(spark, sf).groupBy("state", "unit").agg(F.sum("gdp_inr_raw").alias("z"), F.max("y_crore").alias("y"))
    return sums.groupBy("state").agg(r(allocate.mape(F.col("z"), F.col("y")), 8).alias("mape"))


_SEEDS = """runs AS (SELECT c.*, s.seed, intensity_raw + s.seed * poi_count * 0.05e0 AS s_i FROM cells c, (SELECT unnest(range(5)) AS seed) s),
per_seed AS (SELECT r.*, CASE WHEN population > 0 THEN round(s_i * population * y_inr / greatest(sum(s_i * population) OVER (PARTITION BY seed, state, unit), 1e-9) / population / 1e7, 4) END AS pci
  FROM runs r JOIN totals USING (state, unit)),
seed_live AS (SELECT seed, cell, (rank() OVER (PARTITION BY seed, state ORDER BY pci) + (count(*) OVER (PARTITION BY seed, state, pci) - 1) / 2e0) / count(*) OVER (PARTITION BY seed, state) * 100 AS w
  FROM per_seed WHERE population > 0)"""


def _runs(spark, sf):
    seeds = F.explode(F.array(*[F.lit(s) for s in range(5)])).alias("seed")
    base = cells(spark, sf).select("cell", "unit", "state", "population", "poi_count", F.col("intensity_raw").alias("s0"), seeds)
    return base.withColumn("intensity_raw", F.col("s0") + F.col("seed") * F.col("poi_count") * 0.05)


@query("ensemble_stats", with_ctes(
    """SELECT p.cell, round(avg(s_i), 10) AS s_mean, round(min(s_i), 10) AS s_min, round(max(s_i), 10) AS s_max, round(avg(pci), 5) AS pci_mean,
    min(pci) AS pci_min, max(pci) AS pci_max, round(avg(coalesce(w, 0)), 4) AS w_mean, round(min(coalesce(w, 0)), 6) AS w_min, round(max(coalesce(w, 0)), 6) AS w_max
    FROM per_seed p LEFT JOIN seed_live l ON p.cell = l.cell AND p.seed = l.seed GROUP BY p.cell""", CELLS, TOTALS, _SEEDS))
def _(spark, sf):
    out = allocate.dasymetric_allocate(_runs(spark, sf), totals(spark, sf), by=("seed", "state", "unit"), units=nations(spark, sf), copies=5)
    out = out.withColumn("gdp_per_capita_inr", F.round(F.col("gdp_per_capita_inr") / 1e7, 4))
    out = allocate.ensemble_stats(ranks.wealth_index(out, ["seed", "state"]))
    pick = lambda col, name, digits: r(col, digits).alias(name)
    return out.select(
        "cell", pick("intensity_raw_mean", "s_mean", 10), pick("intensity_raw_min", "s_min", 10), pick("intensity_raw_max", "s_max", 10),
        pick("gdp_per_capita_inr_mean", "pci_mean", 5), F.col("gdp_per_capita_inr_min").alias("pci_min"),
        F.col("gdp_per_capita_inr_max").alias("pci_max"), pick("wealth_index_mean", "w_mean", 4),
        pick("wealth_index_min", "w_min", 6), pick("wealth_index_max", "w_max", 6))


@query("ensemble_allocate", with_ctes(
    """SELECT c.cell, round(s * population / sum(s * population) OVER (PARTITION BY state, unit) * y_crore, 2) AS gdp_crore
    FROM cells c JOIN totals USING (state, unit) JOIN (SELECT cell, avg(s_i) AS s FROM runs GROUP BY cell) m ON m.cell = c.cell""", CELLS, TOTALS, _SEEDS))
def _(spark, sf):
    base = cells(spark, sf).drop("intensity_raw")
    out = allocate.ensemble_allocate(_runs(spark, sf), base, totals(spark, sf), nations(spark, sf))
    return out.select("cell", r("gdp_crore", 2).alias("gdp_crore"))


@query("join_targets", with_ctes(
    "SELECT cell, unit, round(y_crore, 2) AS y_crore FROM cells JOIN totals USING (state, unit)", CELLS, TOTALS))
def _(spark, sf):
    out = joins.join_targets(cells(spark, sf), totals(spark, sf), bound=nations(spark, sf))
    return out.select("cell", "unit", r("y_crore", 2).alias("y_crore"))


@query("lookup_fill", """SELECT p_partkey AS cell, coalesce(n, 0e0) AS n, coalesce(q, 0e0) AS q FROM part LEFT JOIN
    (SELECT CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_partkey ELSE -l_partkey END AS cell, count(*)::DOUBLE AS n, sum(l_quantity) AS q FROM lineitem GROUP BY cell) ON p_partkey = cell""")
def _(spark, sf):
    """Measures of all line items; those of the common kind belong to cells that no part has."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("cell"))
    key = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), F.col("l_partkey")).otherwise(-F.col("l_partkey"))
    measures = table(spark, sf, "lineitem").groupBy(key.alias("cell")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return joins.lookup_fill(parts, measures, "cell", ["n", "q"])


@query("filter_valid_cells", "SELECT event_id, user_id AS cell FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("cell"))
    valid = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("cell"))
    return joins.filter_valid_cells(rows, valid).select("event_id", "cell")


@query("missing_units", """WITH t AS (SELECT c_nationkey AS state, c_custkey AS unit FROM customer),
  c AS (SELECT DISTINCT c_nationkey AS state, o_custkey AS unit FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT s_nationkey, s_suppkey FROM supplier)
  SELECT state, unit, 'cells' AS lacking FROM t WHERE (state, unit) NOT IN (SELECT (state, unit) FROM c) UNION ALL SELECT state, unit, 'totals' FROM c WHERE (state, unit) NOT IN (SELECT (state, unit) FROM t)""")
def _(spark, sf):
    """Customers have totals; customers with orders, and suppliers, have cells. Both number their units from 1 in every nation."""
    want = table(spark, sf, "customer").select(F.col("c_nationkey").alias("state"), F.col("c_custkey").alias("unit"))
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit")).join(want, "unit").select("state", "unit").unionByName(
        table(spark, sf, "supplier").select(F.col("s_nationkey").alias("state"), F.col("s_suppkey").alias("unit")))
    return joins.missing_units(want, have)


@query("distinct_units", with_ctes("SELECT DISTINCT unit FROM cells WHERE unit IS NOT NULL", CELLS))
def _(spark, sf):
    return joins.distinct_units(cells(spark, sf))


@query("metro_units", f"""WITH m AS (SELECT r_regionkey AS state, r_name AS metro, unnest(['NATION_' || r_regionkey, 'NATION_' || (r_regionkey + 5), 'NATION_' || (r_regionkey + 20), 'NATION_3', 'ELSEWHERE']) AS unit, unnest(range(5)) AS position FROM region)
  SELECT state, metro, position, unit FROM m WHERE (state, unit) IN (SELECT (n_regionkey, {UNIT_NAME}) FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def _(spark, sf):
    """NATION_3 is a unit of two territories and none of the others, though all metros list it."""
    k = F.col("r_regionkey")
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    metros = table(spark, sf, "region").select(
        k.alias("state"), F.col("r_name").alias("metro"), F.array(name(k), name(k + 5), name(k + 20), F.lit("NATION_3"), F.lit("ELSEWHERE")).alias("units"))
    return joins.metro_units(metros, cells(spark, sf)).select("state", "metro", F.col("position").cast("bigint").alias("position"), "unit")


@query("first_by_order", "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(joins.first_by("o_orderkey", "o_orderdate", "o_orderkey").alias("first_order"))


@query("last_match", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders WHERE o_orderpriority LIKE '%URGENT%' GROUP BY o_custkey")
def _(spark, sf):
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority").contains("URGENT"))
    return urgent.groupBy("o_custkey").agg(joins.last_by("o_orderkey", "o_orderdate", "o_orderkey").alias("last_order"))


@query("claim_once", "SELECT l_partkey AS cell, min(l_shipmode) AS unit FROM (SELECT l_partkey, l_returnflag || l_linestatus || l_suppkey AS l_shipmode FROM lineitem) GROUP BY l_partkey")
def _(spark, sf):
    claims = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("cell"), F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("unit"))
    return joins.claim_once(claims)


@query("coverage_status", """WITH k AS (SELECT c_custkey::VARCHAR AS code, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'local_csv' WHEN 'BUILDING' THEN 'pdf' WHEN 'FURNITURE' THEN 'ckan_json' WHEN 'MACHINERY' THEN NULL ELSE 'xlsx_table' END AS kind,
    c_acctbal < 0 AS skipped FROM customer),
  f AS (SELECT o_custkey::VARCHAR AS code, count(*) FILTER (o_orderpriority = '1-URGENT') > 2 AS c, count(*) FILTER (o_orderpriority = '2-HIGH') > 2 AS j,
    count(*) FILTER (o_orderpriority = '3-MEDIUM') > 2 AS p, count(*) FILTER (o_orderpriority = '5-LOW') > 2 AS d FROM orders GROUP BY ALL),
  s AS (SELECT k.*, coalesce(c, false) AS c, coalesce(j, false) AS j, coalesce(p, false) AS p, coalesce(d, false) AS d FROM k LEFT JOIN f USING (code)),
  t AS (SELECT code, CASE WHEN kind IS NULL THEN 'no_source' WHEN kind = 'local_csv' THEN CASE WHEN c THEN 'ready' ELSE 'needs_csv' END WHEN c OR p THEN 'ready' WHEN skipped THEN 'switched_off'
    WHEN kind = 'pdf' THEN CASE WHEN d THEN 'needs_parsing' ELSE 'needs_document' END WHEN j OR kind = 'ckan_json' THEN 'ready' ELSE 'needs_fetch' END AS status FROM s)
  SELECT code, status, status IN ('ready', 'needs_fetch') AS usable FROM t""")
def _(spark, sf):
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "AUTOMOBILE", "local_csv").when(segment == "BUILDING", "pdf").when(segment == "FURNITURE", "ckan_json").when(
        segment == "MACHINERY", None).otherwise("xlsx_table")
    settings = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("code"), kind.alias("kind"), F.when(F.col("c_acctbal") < 0, "none").alias("skip_reason"))
    has = lambda p: F.count_if(F.col("o_orderpriority") == p) > 2
    present = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("code")).agg(
        has("1-URGENT").alias("has_csv"), has("2-HIGH").alias("has_json"), has("3-MEDIUM").alias("has_parsed"), has("5-LOW").alias("has_pdf"))
    return targets.coverage_status(settings, present).select("code", "status", "usable")
