"""Features, graph operators and the fit."""

import numpy as np
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions import hexgrid
from dasyspark.functions.numbers import ablate_features, select_by_pattern
from dasyspark.operators import features as X
from dasyspark.operators import fit as FIT
from dasyspark.operators import graph as G
from dasyspark.plans.disaggregate import disaggregate
from dasyspark.session import materialize
from registry.core import CELLS, COARSE, HEXCELLS, LEVEL, MID, cell_places, cells, dealt, hexcells, nations, parent_sql, query, table, totals
from registry.core import TOTALS, axial_sql_neighbors, cell_sql, num, with_ctes
from registry.space import _haversine_sql

_MAG = ["population", "night_lights", "road_km", "poi_count", "building_area_m2", "building_count", "poi_amenity_bank", "poi_office"]
_SHARE = [f"landuse_{c}" for c in C.LANDUSE_CLASSES] + ["building_share"]
_DERIVED = {}
for _m in _MAG:
    _DERIVED[f"{_m}_exists"] = f"CASE WHEN {_m} > 0 THEN 1e0 ELSE 0e0 END"
    _DERIVED[f"{_m}_log"] = f"CASE WHEN {_m} > 0 THEN log10({_m}) ELSE 0e0 END"
for _s in _SHARE:
    _DERIVED[_s] = _s
    _DERIVED[f"{_s}_exists"] = f"CASE WHEN {_s} > 0 THEN 1e0 ELSE 0e0 END"
FEATURES = (
    f"feats AS (SELECT cell, unit, state, population, {', '.join(f'{v} AS {k}' for k, v in _DERIVED.items())} FROM cells),\n"
    "zs AS (SELECT cell, unit, state, population, "
    + ", ".join(
        f"({k} - avg({k}) OVER s) / CASE WHEN stddev_pop({k}) OVER s > 1e-9 THEN stddev_pop({k}) OVER s ELSE 1e0 END AS {k}_z" for k in _DERIVED
    )
    + " FROM feats WINDOW s AS (PARTITION BY state))"
)
Z = [f"{k}_z" for k in _DERIVED]


def regions(spark, sf):
    return table(spark, sf, "region")


def featured(spark, sf):
    return X.engineer_features(cells(spark, sf), ("state",), regions(spark, sf), keep=["cell", "unit", "population"])


@query("engineer_features", with_ctes("SELECT cell, state, " + ", ".join(f"round({z}, 6) AS {z}" for z in Z) + " FROM zs", CELLS, FEATURES))
def _(spark, sf):
    out, names = featured(spark, sf)
    return out.select("cell", "state", *[F.round(n, 6).alias(n) for n in names])


@query("zscore_stats", with_ctes(
    "SELECT state, " + ", ".join(f"round(avg({k}), 8) AS {k}_mu, round(CASE WHEN stddev_pop({k}) > 1e-9 THEN stddev_pop({k}) ELSE 1e0 END, 8) AS {k}_sd" for k in _DERIVED) + " FROM feats GROUP BY state", CELLS, FEATURES))
def _(spark, sf):
    base = cells(spark, sf)
    derived = X.derived_columns(base.columns)
    wide = base.select("state", *[c.alias(n) for n, c in derived.items()])
    out = X.zscore_stats(wide, ["state"], list(derived))
    return out.select("state", *[F.round(c, 8).alias(c) for c in out.columns if c != "state"])


@query("assemble_vector", with_ctes("SELECT cell, round(list_sum(list_transform([" + ", ".join(Z) + "], lambda v, i: v * i)), 5) AS weighted, " + str(len(Z)) + " AS dims FROM zs", CELLS, FEATURES))
def _(spark, sf):
    out, names = featured(spark, sf)
    vector = X.assemble_vector(out, names)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return vector.select("cell", F.round(weighted, 5).alias("weighted"), F.size("x").alias("dims"))


@query("drop_constant_lights", with_ctes("SELECT unit, count(*) AS n, (SELECT count(*) FROM (SELECT 1)) * 0 + CASE WHEN (SELECT sum(night_lights) FROM cells) = 0 THEN " + str(len(Z) - 2) + " ELSE " + str(len(Z)) + " END AS with_lights, " + str(len(Z) - 2) + " AS dark FROM cells GROUP BY unit", CELLS))
def _(spark, sf):
    base = cells(spark, sf)
    names = list(X.derived_columns(base.columns))
    lit = len(X.drop_constant_lights(base, names))
    dark = len(X.drop_constant_lights(base.withColumn("night_lights", F.lit(0.0)), names))
    return base.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.lit(lit).alias("with_lights"), F.lit(dark).alias("dark"))


@query("select_by_pattern", with_ctes("SELECT cell, " + ", ".join(f"round({c}, 10) AS {c}" for c in ["poi_amenity_bank", "poi_count", "poi_office", *_SHARE[:4], "building_share"]) + " FROM cells", CELLS))
def _(spark, sf):
    base = cells(spark, sf)
    chosen = select_by_pattern(base.columns, ("poi_", "landuse_"), ("_share",))
    return base.select("cell", *[F.round(c, 10).alias(c) for c in chosen])


@query("ablate_features", with_ctes("SELECT cell, " + ", ".join(f"round({z}, 6) AS {z}" for z in Z if "night_lights" not in z) + " FROM zs", CELLS, FEATURES))
def _(spark, sf):
    out, names = featured(spark, sf)
    return out.select("cell", *[F.round(n, 6).alias(n) for n in ablate_features(names)])


@query("describe_inputs", """SELECT l_returnflag, count(*) AS "count", round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS max
  FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    out = X.describe_inputs(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75")]
    return out.select("l_returnflag", "count", "min", "max", *rounded)


# ----------------------------------------------------------------------- graph

_EDGES = f"""steps AS (SELECT cell AS src, unnest({axial_sql_neighbors('cell', LEVEL)}) AS dst FROM hexcells),
edges AS (SELECT src, dst FROM steps WHERE dst IN (SELECT cell FROM hexcells))"""
_LINKS = f"links AS (SELECT cell AS child, {parent_sql('cell', LEVEL, MID)} AS parent FROM hexcells)"
DIM = 4
_VEC = ["ln(1 + population)", "ln(1 + poi_count)", "ln(1 + night_lights)", "ln(1 + road_km)"]


def graph(spark, sf):
    nodes = hexcells(spark, sf)
    vector = F.array(*[F.log1p(c) for c in ("population", "poi_count", "night_lights", "road_km")])
    nodes = materialize(nodes.select("cell", "unit", vector.alias("h")), "nodes")
    return nodes, G.adjacency_join(nodes, LEVEL), G.hierarchy_join(nodes, LEVEL, MID)


def spread(df, key, vector, dim, digits=9):
    return df.select(key, *[F.round(F.col(vector)[i], digits).alias(f"v{i}") for i in range(dim)])


@query("adjacency_join", with_ctes("SELECT src, dst FROM edges", HEXCELLS, _EDGES))
def _(spark, sf):
    return G.adjacency_join(hexcells(spark, sf), LEVEL).select("src", "dst")


@query("hierarchy_join", with_ctes("SELECT child, parent FROM links", HEXCELLS, _LINKS))
def _(spark, sf):
    base = hexcells(spark, sf)
    parents = base.select(hexgrid.cell_parent(F.col("cell"), LEVEL, MID).alias("cell")).distinct()
    return G.hierarchy_join(base, LEVEL, MID, parents).select("child", "parent")


@query("adjacency_by_distance", with_ctes(
    f"SELECT a.cell AS src, b.cell AS dst FROM cells a, cells b WHERE a.cell <> b.cell AND {_haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60", CELLS))
def _(spark, sf):
    spots = cell_places(dealt(spark, sf, "customer"), nations(spark, sf)).select("cell", "lat", "lon")
    return G.adjacency_by_distance(spots, 60.0, tile=1.0)


@query("neighbor_mean", with_ctes(
    "SELECT h.cell, " + ", ".join(f"round(coalesce(s{i}, 0e0) / (1 + coalesce(n, 0)), 9) AS v{i}" for i in range(DIM)) +
    " FROM hexcells h LEFT JOIN (SELECT dst, count(*) AS n, " + ", ".join(f"sum({v}) AS s{i}" for i, v in enumerate(_VEC)) + " FROM edges JOIN hexcells ON src = cell GROUP BY dst) ON dst = h.cell", HEXCELLS, _EDGES))
def _(spark, sf):
    nodes, edges, _ = graph(spark, sf)
    return spread(G.neighbor_mean(nodes, edges, DIM), "cell", "message", DIM)


@query("pool_to_parent", with_ctes(
    "SELECT parent AS cell, " + ", ".join(f"round(avg({v}), 9) AS v{i}" for i, v in enumerate(_VEC)) + " FROM links JOIN hexcells ON child = cell GROUP BY parent", HEXCELLS, _LINKS))
def _(spark, sf):
    nodes, _, links = graph(spark, sf)
    return spread(G.pool_to_parent(nodes, links, DIM), "cell", "pooled", DIM)


@query("broadcast_to_child", with_ctes(
    "SELECT child AS cell, " + ", ".join(f"round(coalesce(m{i}, 0e0), 9) AS v{i}" for i in range(DIM)) + " FROM links LEFT JOIN (SELECT parent, " +
    ", ".join(f"avg({v}) AS m{i}" for i, v in enumerate(_VEC)) + " FROM links JOIN hexcells ON child = cell GROUP BY parent HAVING count(*) > 1) USING (parent)", HEXCELLS, _LINKS))
def _(spark, sf):
    nodes, _, links = graph(spark, sf)
    families = links.groupBy("parent").count().where("count > 1").select(F.col("parent").alias("cell"))
    parents = G.pool_to_parent(nodes, links, DIM).join(families, "cell", "left_semi")
    return spread(G.broadcast_to_child(parents, links, DIM, vector="pooled"), "cell", "context", DIM)


@query("initial_residual", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: (0.9e0 * (x::DOUBLE * 2e0) + 0.1e0 * x::DOUBLE) * i)), 6) AS checksum FROM embeddings")
def _(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    mixed = G.initial_residual(F.transform(x, lambda v: v * 2.0), x)
    checksum = F.aggregate(F.transform(mixed, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return table(spark, sf, "embeddings").select("vec_id", F.round(checksum, 6).alias("checksum"))


@query("parent_features", with_ctes(
    f"SELECT {parent_sql('cell', LEVEL, COARSE)} AS parent, population, poi_count FROM hexcells", HEXCELLS).replace(
    "SELECT " + parent_sql("cell", LEVEL, COARSE), "SELECT parent, round(avg(population), 6) AS population, round(avg(poi_count), 6) AS poi_count FROM (SELECT " + parent_sql("cell", LEVEL, COARSE)) + ") GROUP BY parent")
def _(spark, sf):
    base = hexcells(spark, sf).withColumn("parent", hexgrid.cell_parent(F.col("cell"), LEVEL, COARSE))
    out = G.parent_features(base, "parent", ["population", "poi_count"])
    return out.select("parent", F.round("population", 6).alias("population"), F.round("poi_count", 6).alias("poi_count"))


def _hop_sql(k, source):
    inner = ", ".join(f"sum(s{i}) AS t{i}" for i in range(DIM))
    return (f"hop{k} AS (SELECT h.cell, " + ", ".join(f"coalesce(t{i}, 0e0) / (1 + coalesce(n, 0)) AS s{i}" for i in range(DIM)) +
            f" FROM hexcells h LEFT JOIN (SELECT dst, count(*) AS n, {inner} FROM edges JOIN {source} ON src = cell GROUP BY dst) ON dst = h.cell)")


_HOPS = ("hop0 AS (SELECT cell, " + ", ".join(f"{v} AS s{i}" for i, v in enumerate(_VEC)) + " FROM hexcells)", _hop_sql(1, "hop0"), _hop_sql(2, "hop1"),
         "ctx AS (SELECT child AS cell, " + ", ".join(f"m{i}" for i in range(DIM)) + " FROM links JOIN (SELECT parent, " +
         ", ".join(f"avg(s{i}) AS m{i}" for i in range(DIM)) + " FROM links JOIN hop0 ON child = cell GROUP BY parent) USING (parent))")


@query("propagate", with_ctes(
    "SELECT hop0.cell, " + ", ".join(f"round(hop{k}.s{i}, 9) AS v{k * DIM + i}" for k in range(3) for i in range(DIM)) + ", " +
    ", ".join(f"round(m{i}, 9) AS v{3 * DIM + i}" for i in range(DIM)) + " FROM hop0 JOIN hop1 USING (cell) JOIN hop2 USING (cell) JOIN ctx USING (cell)",
    HEXCELLS, _EDGES, _LINKS, *_HOPS))
def _(spark, sf):
    nodes, edges, links = graph(spark, sf)
    return spread(G.propagate(nodes, edges, DIM, hops=2, links=links), "cell", "z", 4 * DIM)


@query("feature_index", with_ctes("SELECT cell, dense_rank() OVER (ORDER BY unit) - 1 AS idx FROM cells", CELLS))
def _(spark, sf):
    from dasyspark.operators.joins import attach

    base = cells(spark, sf).select("cell", "unit")
    index = G.feature_index(base, "unit")
    return attach(base, index, "unit", "inner", nations(spark, sf)).select("cell", "idx")


HIDDEN, LAYERS = 8, 2
WEIGHTS = G.init_weights(DIM, hidden=HIDDEN, layers=LAYERS, seed=0)
_UP = {"fine": (LEVEL, MID), "mid": (MID, COARSE)}


def _score_sql() -> str:
    """The layer equations over lists, every step a materialized table."""

    def dense(matrix, bias, vector, elu=True):
        rows = ", ".join("[" + ", ".join(num(v) for v in (*row, b)) + "]" for row, b in zip(matrix, bias))
        out = f"list_transform([{rows}], lambda w: list_dot_product(w, list_append({vector}, 1e0)))"
        return f"list_transform({out}, lambda v: CASE WHEN v > 0 THEN v ELSE exp(v) - 1e0 END)" if elu else out

    def pooled(how, vector, dim, extra=""):
        return "[" + ", ".join(f"{how}({vector}[{i + 1}]){extra}" for i in range(dim)) + "]"

    w, zeros = WEIGHTS, "[" + ", ".join(["0e0"] * HIDDEN) + "]"
    steps = {"x_fine": "SELECT cell, [ln(1 + population) / 10, poi_count / 10, night_lights / 50, road_km / 50] AS x FROM hexcells"}
    steps["l_fine"] = f"SELECT cell AS child, {parent_sql('cell', LEVEL, MID)} AS parent FROM x_fine"
    steps["l_top"] = f"SELECT cell AS child, {parent_sql('cell', LEVEL, COARSE)} AS parent FROM x_fine"
    for lvl, links in (("mid", "l_fine"), ("coarse", "l_top")):
        steps[f"x_{lvl}"] = f"SELECT parent AS cell, {pooled('avg', 'x', DIM)} AS x FROM x_fine JOIN {links} ON child = cell GROUP BY parent"
    steps["l_mid"] = f"SELECT child, parent FROM (SELECT cell AS child, {parent_sql('cell', MID, COARSE)} AS parent FROM x_mid) WHERE parent IN (SELECT cell FROM x_coarse)"
    for lvl, level in (("fine", LEVEL), ("mid", MID), ("coarse", COARSE)):
        steps[f"e_{lvl}"] = f"SELECT src, dst FROM (SELECT cell AS src, unnest({axial_sql_neighbors('cell', level)}) AS dst FROM x_{lvl}) WHERE dst IN (SELECT cell FROM x_{lvl})"
        first = dense(w[f"in.{lvl}.w"], w[f"in.{lvl}.b"], "x")
        steps[f"h_{lvl}_0"] = f"SELECT cell, h, h AS h0 FROM (SELECT cell, {first} AS h FROM x_{lvl})"
    for k in range(LAYERS):
        for lvl in ("fine", "mid", "coarse"):
            h = f"h_{lvl}_{k}"
            steps[f"m_{lvl}_{k}"] = f"SELECT dst AS cell, {pooled('sum', 'h', HIDDEN, ' / (1 + count(*))')} AS m FROM e_{lvl} JOIN {h} ON cell = src GROUP BY dst"
            both = np.hstack([w[f"self.{lvl}.{k}.w"], w[f"near.{lvl}.{k}.w"]])
            a = dense(both, w[f"self.{lvl}.{k}.b"] + w[f"near.{lvl}.{k}.b"], f"list_concat(h, coalesce(m, {zeros}))")
            steps[f"a_{lvl}_{k}"] = f"SELECT cell, h0, {a} AS a FROM {h} LEFT JOIN m_{lvl}_{k} USING (cell)"
        for child, parent in (("fine", "mid"), ("mid", "coarse")):
            d = dense(w[f"down.{child}.{k}.w"], w[f"down.{child}.{k}.b"], "h", elu=False)
            steps[f"d_{child}_{k}"] = f"SELECT child AS cell, {d} AS d FROM l_{child} JOIN h_{parent}_{k} ON cell = parent"
            steps[f"u_{parent}_{k}"] = f"SELECT parent AS cell, {pooled('avg', 'h', HIDDEN)} AS u FROM l_{child} JOIN h_{child}_{k} ON cell = child GROUP BY parent"
        eye, alpha = np.eye(HIDDEN), C.RESIDUAL_ALPHA
        new = {
            "fine": (dense(w["mix.w"], w["mix.b"], f"list_concat(a, coalesce(d, {zeros}))"), ["d"]),
            "mid": (dense(np.hstack([eye, w[f"up.mid.{k}.w"], eye]), w[f"up.mid.{k}.b"], f"list_concat(list_concat(a, coalesce(u, {zeros})), coalesce(d, {zeros}))"), ["u", "d"]),
            "coarse": (dense(np.hstack([eye, w[f"up.coarse.{k}.w"]]), w[f"up.coarse.{k}.b"], f"list_concat(a, coalesce(u, {zeros}))"), ["u"]),
        }
        for lvl, (value, joined) in new.items():
            joins = " ".join(f"LEFT JOIN {j}_{lvl}_{k} USING (cell)" for j in joined)
            mixed = f"list_transform(list_zip(n, h0), lambda p: {num(1 - alpha)} * p[1] + {num(alpha)} * p[2])"
            steps[f"h_{lvl}_{k + 1}"] = f"SELECT cell, {mixed} AS h, h0 FROM (SELECT cell, h0, {value} AS n FROM a_{lvl}_{k} {joins})"
    out = dense(w["out.w"], w["out.b"], "h", elu=False)
    ctes = [f"{name} AS MATERIALIZED ({body})" for name, body in steps.items()]
    return with_ctes(f"SELECT cell, round(ln(1 + exp(({out})[1])), 8) AS intensity_raw FROM h_fine_{LAYERS}", HEXCELLS, *ctes)


@query("score_layer", _score_sql())
def _(spark, sf):
    """Two published layers over three levels of hexagons, with a seeded weight table."""
    nodes = hexcells(spark, sf)
    vector = F.array(F.log1p("population") / 10, F.col("poi_count") / 10, F.col("night_lights") / 50, F.col("road_km") / 50)
    fine = materialize(nodes.select("cell", vector.alias("x")), "fine")
    up = materialize(G.hierarchy_join(fine, LEVEL, MID), "links-fine")
    up_coarse = G.hierarchy_join(fine, LEVEL, COARSE)
    mid = materialize(G.pool_to_parent(fine, up, DIM, "x", "x"), "mid")
    coarse = materialize(G.pool_to_parent(fine, up_coarse, DIM, "x", "x"), "coarse")
    mid_links = materialize(G.hierarchy_join(mid, MID, COARSE, coarse), "links-mid")
    edges = {"fine": G.adjacency_join(fine, LEVEL), "mid": G.adjacency_join(mid, MID), "coarse": G.adjacency_join(coarse, COARSE)}
    edges = {k: materialize(e, f"edges-{k}") for k, e in edges.items()}
    out = G.score_layers(fine, mid, coarse, edges, up, mid_links, WEIGHTS, DIM, hidden=HIDDEN, layers=LAYERS)
    return out.select("cell", F.round("intensity_raw", 8).alias("intensity_raw"))


# ------------------------------------------------------------------------- fit

# The occupied hexagons as cells of the fit: each belongs to the first unit that has people in it.
LATTICE = (
    CELLS
    + f""",
lattice AS (SELECT cell, min(state) AS state, min_by(unit, (state, unit)) AS unit, sum(population) AS population, max(night_lights) AS night_lights,
  sum(road_km) AS road_km, sum(poi_count) AS poi_count, max(building_share) AS building_share FROM
  (SELECT {cell_sql("c.lat", "c.lon", LEVEL)} AS cell, c.* EXCLUDE (cell) FROM cells c) GROUP BY cell)"""
)
_BASE = {}
for _m in ("population", "night_lights", "road_km", "poi_count"):
    _BASE |= {f"{_m}_exists": _DERIVED[f"{_m}_exists"], f"{_m}_log": _DERIVED[f"{_m}_log"]}
_BASE |= {"building_share": "building_share", "building_share_exists": _DERIVED["building_share_exists"]}
_DARK = [k for k in _BASE if not k.startswith("night_lights")]


def lattice(spark, sf):
    base = cells(spark, sf)
    hexagon = hexgrid.point_to_cell(F.col("lat"), F.col("lon"), LEVEL)
    out = base.groupBy(hexagon.alias("cell")).agg(
        F.min(F.struct("state", "unit")).alias("_u"), F.sum("population").alias("population"), F.max("night_lights").alias("night_lights"),
        F.sum("road_km").alias("road_km"), F.sum("poi_count").alias("poi_count"), F.max("building_share").alias("building_share"))
    return materialize(out.select("cell", "_u.*", "population", "night_lights", "road_km", "poi_count", "building_share"), "lattice")


def lattice_graph(nodes):
    """Neighbours and parents within each territory."""
    edges = materialize(G.within_territories(G.adjacency_join(nodes, LEVEL), nodes), "edges")
    links = G.hierarchy_join(nodes, LEVEL, MID).join(nodes.select(F.col("cell").alias("child"), "state"), "child")
    return edges, links.select("child", F.concat_ws(":", F.col("state").cast("string"), F.col("parent").cast("string")).alias("parent"))


def lattice_totals(spark, sf, nodes):
    return materialize(totals(spark, sf).join(nodes.select("state", "unit").distinct(), ["state", "unit"], "left_semi"), "totals")


def training(spark, sf):
    """Cells, totals, and the design matrices with and without lights: own features, neighbours within two steps, the parent's mean."""
    nodes = lattice(spark, sf)
    edges, links = lattice_graph(nodes)
    wide, names = X.engineer_features(nodes, ("state",), regions(spark, sf), keep=["cell", "unit", "population"])
    wide = materialize(wide, "features")
    designs = {tag: G.design_matrix(wide, kept, edges, links) for tag, kept in (("with", names), ("without", ablate_features(names)))}
    return nodes, lattice_totals(spark, sf, nodes), designs


def design_sql(names, d):
    """The design matrix ``d`` (state, unit, cell, population, x with a 1 at the end) over the lattice."""
    n = len(names)
    z = ", ".join(f"(({_BASE[k]}) - avg({_BASE[k]}) OVER s) / CASE WHEN stddev_pop({_BASE[k]}) OVER s > 1e-9 THEN stddev_pop({_BASE[k]}) OVER s ELSE 1e0 END" for k in names)
    zeros = "[" + ", ".join(["0e0"] * n) + "]"
    out = [f"{d}_0 AS MATERIALIZED (SELECT cell, state, unit, population, [{z}] AS h FROM lattice WINDOW s AS (PARTITION BY state))",
           f"{d}_e AS MATERIALIZED (SELECT src, dst FROM (SELECT cell AS src, state, unnest({axial_sql_neighbors('cell', LEVEL)}) AS dst FROM lattice) a JOIN lattice b ON b.cell = a.dst AND b.state = a.state)"]
    for k in (1, 2):
        out.append(f"""{d}_{k} AS MATERIALIZED (SELECT z.cell, coalesce(m.h, {zeros}) AS h FROM {d}_0 z LEFT JOIN (SELECT dst, list(t ORDER BY i) AS h FROM (SELECT dst, i, sum(v) / (1 + count(*)) AS t
          FROM {d}_e JOIN (SELECT cell, unnest(h) AS v, unnest(range({n})) AS i FROM {d}_{k - 1}) ON src = cell GROUP BY dst, i) GROUP BY dst) m ON m.dst = z.cell)""")
    out.append(f"{d}_p AS MATERIALIZED (SELECT cell, state, {parent_sql('cell', LEVEL, MID)} AS parent, h FROM {d}_0)")
    out.append(f"""{d}_c AS MATERIALIZED (SELECT state, parent, list(t ORDER BY i) AS h FROM (SELECT state, parent, i, avg(v) AS t FROM (SELECT state, parent, unnest(h) AS v, unnest(range({n})) AS i FROM {d}_p)
      GROUP BY ALL) GROUP BY ALL)""")
    out.append(f"""{d} AS MATERIALIZED (SELECT z.cell, z.state, unit, population, list_concat(list_concat(list_concat(list_concat(z.h, a.h), b.h), c.h), [1e0]) AS x FROM {d}_0 z JOIN {d}_1 a USING (cell)
      JOIN {d}_2 b USING (cell) JOIN {d}_p p USING (cell) JOIN {d}_c c ON c.state = p.state AND c.parent = p.parent)""")
    return out


def fit_sql(d, known, out, width, seeds, epochs=C.EPOCHS, lr=C.LEARNING_RATE):
    """All epochs as one recursive table over ``d`` and ``known`` (state, unit, y_inr, train); ``out``: state, seed, scale, w, loss, final_loss."""
    start = ", ".join(f"({s}, [{', '.join(num(v) for v in FIT.initial_weights(width - 1, s))}])" for s in seeds)
    low = num(min(C.MIN_LEARNING_RATE, lr))
    rate = f"({low} + ({num(lr)} - {low}) * (1 + cos(pi() * epoch / {epochs})) / 2)"
    both = lambda a, b, f: f"list_transform(list_zip({a}, {b}), lambda p: {f})"
    return [
        f"""{out}_k AS MATERIALIZED (SELECT state, unit, y_inr FROM {known} WHERE train AND (state, unit) IN (SELECT (state, unit) FROM {d}))""",
        f"""{out}_f AS MATERIALIZED (SELECT state, count(y_inr) AS n, sum(y_inr) / greatest(coalesce(sum(p) FILTER (y_inr IS NOT NULL), 0), 1) AS scale, greatest(sum(p), 1) AS pop
          FROM (SELECT state, unit, sum(population) AS p FROM {d} GROUP BY ALL) LEFT JOIN {out}_k USING (state, unit) GROUP BY state HAVING count(y_inr) > 0)""",
        f"""{out}_d AS MATERIALIZED (SELECT d.state, d.unit, population, x, y_inr, n, scale, pop, count(*) OVER (PARTITION BY d.state, d.unit) AS mates FROM {d} d JOIN {out}_f USING (state) LEFT JOIN {out}_k k ON k.state = d.state AND k.unit = d.unit)""",
        f"""{out}_r AS (SELECT 0 AS epoch, state, seed, w, list_transform(w, lambda v: 0e0) AS m, list_transform(w, lambda v: 0e0) AS v, w AS used, NULL::DOUBLE AS loss
          FROM {out}_f, (VALUES {start}) s(seed, w)
          UNION ALL SELECT epoch + 1, state, seed, {both('w', 'step', f'p[1] - {rate} * p[2]')}, m, v, w, loss FROM (
          SELECT *, {both('m', 'v', '(p[1] / (1 - power(0.9e0, epoch + 1))) / (sqrt(p[2] / (1 - power(0.999e0, epoch + 1))) + 1e-8)')} AS step FROM (
          SELECT epoch, state, seed, w, loss, {both('m', 'g', '0.9e0 * p[1] + 0.1e0 * p[2]')} AS m, {both('v', 'g', '0.999e0 * p[1] + 0.001e0 * p[2] * p[2]')} AS v FROM (
          SELECT epoch, state, seed, w, m, v, loss, list_transform(raw, lambda q: q * least(1e0, {C.GRADIENT_CLIP}e0 / greatest(sqrt(list_sum(list_transform(raw, lambda q: q * q))), 1e-12))) AS g FROM (
          SELECT epoch, state, seed, any_value(w) AS w, any_value(m) AS m, any_value(v) AS v, max(t) FILTER (i = {width}) AS loss, list(t ORDER BY i) FILTER (i < {width}) AS raw FROM (
          SELECT epoch, state, seed, any_value(w) AS w, any_value(m) AS m, any_value(v) AS v, i, sum(t) AS t FROM (
          SELECT epoch, state, seed, w, m, v, unnest(range({width + 1})) AS i, unnest(list_append(list_transform(x, lambda q: q * (pull * slope - {num(2 * C.FLOOR_WEIGHT)} / pop * short * slope)),
            coalesce(gap * gap / n / mates, 0) + {num(C.FLOOR_WEIGHT)} * population * short * short / pop)) AS t FROM (
          SELECT *, coalesce(gap * 2 / (z + 1e-6) / (ln(10e0) * n), 0) AS pull FROM (
          SELECT *, log10(z + 1e-6) - log10(y_inr + 1e-6) AS gap FROM (
          SELECT *, sum(s * population) OVER (PARTITION BY state, seed, unit) AS z, greatest({num(C.FLOOR_TAU)} - s, 0e0) AS short, population * scale / (1 + exp(-l)) AS slope FROM (
          SELECT *, scale * (greatest(l, 0e0) + ln(1 + exp(-abs(l)))) AS s FROM (
          SELECT epoch, state, seed, w, m, v, unit, population, x, y_inr, n, scale, pop, mates, list_dot_product(w, x) AS l FROM {out}_r JOIN {out}_d USING (state) WHERE epoch < {epochs})))))) GROUP BY epoch, state, seed, i)
          GROUP BY epoch, state, seed)))))""",
        f"""{out} AS MATERIALIZED (SELECT state, seed, scale, arg_min(used, (loss, epoch)) AS w, min(loss) AS loss, arg_max(loss, epoch) AS final_loss FROM {out}_r JOIN {out}_f USING (state) WHERE epoch > 0 GROUP BY state, seed, scale)""",
        f"""{out}_s AS MATERIALIZED (SELECT cell, state, unit, population, seed, scale, scale * (greatest(l, 0e0) + ln(1 + exp(-abs(l)))) AS s FROM (SELECT *, list_dot_product(w, x) AS l FROM {d} JOIN {out} USING (state)))""",
    ]


def fitted(body, *ctes):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


WIDTH, DARK_WIDTH = 4 * len(_BASE) + 1, 4 * len(_DARK) + 1
_ALL = "known AS (SELECT state, unit, y_inr, true AS train FROM totals WHERE (state, unit) IN (SELECT (state, unit) FROM lattice))"
ONE = (LATTICE, TOTALS, _ALL, *design_sql(list(_BASE), "d"), *fit_sql("d", "known", "one", WIDTH, (0,)))


@query("design_matrix", fitted(
    "SELECT cell, state, unit, round(list_sum(list_transform(x[:-2], lambda v, i: v * i)), 6) AS weighted, len(x) - 1 AS dims FROM d", LATTICE, *design_sql(list(_BASE), "d")))
def _(spark, sf):
    """Own features, means over one and two steps and of the parent, of every cell."""
    _, _, designs = training(spark, sf)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return designs["with"].select("cell", "state", "unit", F.round(weighted, 6).alias("weighted"), F.size("x").cast("bigint").alias("dims"))


@query("fit_intensity", fitted("SELECT cell, state, unit, round(s / scale, 5) AS relative, round(scale / 1e7, 5) AS scale FROM one_s", *ONE))
def _(spark, sf):
    """One seed for every territory, on propagated features; intensities relative to the territory's scale."""
    _, known, designs = training(spark, sf)
    fit = FIT.fit_intensity(designs["with"], known, seeds=(0,))
    runs = fit.runs(designs["with"], ["cell", "state", "unit"])
    scale = fit.table(known).select("state", "scale")
    return runs.join(F.broadcast(scale), "state").select(
        "cell", "state", "unit", F.round(F.col("intensity_raw") / F.col("scale"), 5).alias("relative"), F.round(F.col("scale") / 1e7, 5).alias("scale"))


_FIVE = (LATTICE, TOTALS, _ALL, *design_sql(list(_BASE), "d"), *fit_sql("d", "known", "five", WIDTH, C.SEEDS))
_MEAN = """mean AS (SELECT cell, state, unit, population, avg(s) AS s, min(s) AS low, max(s) AS high FROM five_s GROUP BY ALL),
central AS (SELECT m.*, y_inr, s * population / sum(s * population) OVER (PARTITION BY m.state, m.unit) * y_inr AS gdp FROM mean m JOIN totals USING (state, unit))"""


@query("fit_ensemble", fitted(
    "SELECT cell, state, unit, round(gdp / 1e7, 2) AS gdp_crore, round(s / scale, 5) AS relative, round(low / scale, 5) AS low, round(high / scale, 5) AS high FROM central JOIN five_f USING (state)", *_FIVE, _MEAN))
def _(spark, sf):
    """The whole job over hexagons: features, propagation, five seeds for every territory, allocation."""
    nodes = lattice(spark, sf)
    edges, links = lattice_graph(nodes)
    out, fit = disaggregate(
        nodes, lattice_totals(spark, sf, nodes), seeds=C.SEEDS, units=nations(spark, sf), territories=regions(spark, sf), edges=edges, links=links)
    scale = fit.table(nodes).select("state", "scale").distinct()
    shown = {"relative": "intensity_raw", "low": "intensity_raw_min", "high": "intensity_raw_max"}
    return out.join(F.broadcast(scale), "state").select(
        "cell", "state", "unit", F.round("gdp_crore", 2).alias("gdp_crore"), *[F.round(F.col(c) / F.col("scale"), 5).alias(n) for n, c in shown.items()])


_HELD = """held AS (SELECT state, unit, y_inr, n, CASE WHEN n >= 5 THEN rn <= greatest(1, round_even(0.2e0 * n, 0)) END AS held FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(unit || ':0'), unit) AS rn,
  count(*) OVER (PARTITION BY state) AS n FROM known)),
rest AS (SELECT state, unit, y_inr, NOT coalesce(held, false) AS train FROM held)"""
_HOLD = (LATTICE, TOTALS, _ALL, _HELD, *design_sql(list(_BASE), "d"), *fit_sql("d", "rest", "hold", WIDTH, (0,)))
_HOLDOUT = """h AS (SELECT state, avg(abs(z - y_inr) / greatest(abs(y_inr), 1e-9)) FILTER (held) AS mape, count(*) FILTER (held) AS n_holdout_units, count(*) AS n_units, bool_and(held IS NULL) AS skipped
  FROM held JOIN (SELECT state, unit, sum(s * population) AS z FROM hold_s GROUP BY ALL) USING (state, unit) GROUP BY state)"""


@query("spatial_holdout", fitted(
    "SELECT state, round(mape, 5) AS holdout_mape, n_holdout_units, n_units, skipped, CASE WHEN NOT skipped THEN round(final_loss, 6) END AS final_loss FROM h JOIN hold USING (state)", *_HOLD, _HOLDOUT))
def _(spark, sf):
    _, known, designs = training(spark, sf)
    out = FIT.spatial_holdout(designs["with"], known)
    return out.select("state", F.round("holdout_mape", 5).alias("holdout_mape"), "n_holdout_units", "n_units", "skipped", F.round("final_loss", 6).alias("final_loss"))


@query("holdout_units", with_ctes(
    "SELECT state, unit, CASE WHEN n >= 5 THEN rn <= greatest(1, round_even(0.2e0 * n, 0)) END AS held FROM (SELECT state, unit, row_number() OVER (PARTITION BY state ORDER BY md5(unit || ':0'), unit) AS rn, count(*) OVER (PARTITION BY state) AS n FROM totals)", TOTALS))
def _(spark, sf):
    return FIT.holdout_units(totals(spark, sf))


_LOSS = """SELECT state, avg(power(log10(z + 1e-6) - log10(y_inr + 1e-6), 2)) AS log_loss FROM (SELECT state, unit, sum(s * population) AS z FROM {} GROUP BY ALL) JOIN known USING (state, unit) GROUP BY state"""
_DIM = (*design_sql(_DARK, "dark"), *fit_sql("dark", "known", "dim", DARK_WIDTH, (0,)))


@query("ablation", fitted(
    " UNION ALL ".join(
        f"SELECT '{tag}' AS tag, state, {width - 1} AS n_features, round(log_loss, 6) AS log_loss, round(final_loss, 6) AS final_train_loss FROM ({_LOSS.format(name + '_s')}) JOIN {name} USING (state)"
        for tag, name, width in (("with", "one", WIDTH), ("without", "dim", DARK_WIDTH))), *ONE, *_DIM))
def _(spark, sf):
    _, known, designs = training(spark, sf)
    out = FIT.ablation(designs, known)
    return out.select("tag", "state", "n_features", F.round("log_loss", 6).alias("log_loss"), F.round("final_train_loss", 6).alias("final_train_loss"))


@query("best_epoch", """SELECT tag, seed, (m).epoch AS epoch, (m).loss AS loss FROM (SELECT event_type AS tag, user_id AS seed, min({'loss': round(value, 0), 'epoch': event_id}) AS m FROM events GROUP BY ALL)""")
def _(spark, sf):
    history = table(spark, sf, "events").select(
        F.col("event_type").alias("tag"), F.col("user_id").alias("seed"), F.col("event_id").alias("epoch"), F.round("value", 0).alias("loss"))
    return FIT.best_epoch(history)


def _report_sql():
    ranks = "rank() OVER (PARTITION BY state ORDER BY {0}) + (count(*) OVER (PARTITION BY state, {0}) - 1) / 2e0 AS r_{0}"
    columns = ("wealth", "night_lights", "road_km", "poi_count", "pci")
    names = {"wealth_index_vs_night_lights": ("wealth", "night_lights"), "wealth_index_vs_road_km": ("wealth", "road_km"),
             "wealth_index_vs_poi_count": ("wealth", "poi_count"), "gdp_per_capita_vs_night_lights": ("pci", "night_lights")}
    rk = f"""rk AS (SELECT state, {", ".join(ranks.format(c) for c in columns)} FROM (SELECT c.state, gdp / c.population AS pci, gdp / c.population AS wealth, night_lights, road_km, poi_count
      FROM central c JOIN lattice l USING (cell) WHERE c.population > 0))"""
    parts = [f"SELECT 'ensemble' AS section, state, 'log_loss' AS item, log_loss AS value FROM ({_LOSS.format('mean')})",
             "SELECT 'ensemble', state, 'best_loss ' || seed, loss FROM five",
             *[f"SELECT 'spearman', state, '{p}', corr(r_{a}, r_{b}) FROM rk GROUP BY state" for p, (a, b) in names.items()],
             *[f"SELECT 'ablation', state, '{tag}', log_loss FROM ({_LOSS.format(name)})" for tag, name in (("with", "(SELECT * FROM five_s WHERE seed = 0)"), ("without", "dim_s"))],
             "SELECT 'holdout', state, CASE WHEN skipped THEN 'skipped, units' ELSE 'mape' END, CASE WHEN skipped THEN n_units ELSE mape END FROM h"]
    body = "SELECT section, state, item, round(value, 5) AS value FROM (" + " UNION ALL ".join(parts) + ")"
    return fitted(body, *_FIVE, _MEAN, _HELD, *fit_sql("d", "rest", "hold", WIDTH, (0,)), _HOLDOUT, *_DIM, rk)


@query("evaluation_report", _report_sql())
def _(spark, sf):
    """Ensemble losses, hold-out error, ablation and rank correlations of every territory, as rows."""
    from dasyspark.operators.evaluate import evaluation_report

    nodes, known, designs = training(spark, sf)
    out = evaluation_report(nodes, designs, known, units=nations(spark, sf))
    return out.select("section", "state", "item", F.round("value", 5).alias("value"))
