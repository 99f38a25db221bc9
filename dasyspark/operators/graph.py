"""Cell adjacency, hierarchy and message passing as joins and grouped means.

Node vectors are ``array<double>`` columns. Sums over neighbours expand the
vector into scalar aggregates, so they combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions import hexgrid
from dasyspark.session import Superseding, materialize

Weights = Mapping[str, np.ndarray]
CELLS_PER_TASK = 100_000
LEAST_TILE = 1e-4  # degrees


def adjacency_join(cells: DataFrame, level: int) -> DataFrame:
    """Directed edges between present neighbours; both directions, no self loops."""
    steps = cells.select(
        F.col("cell").alias("src"), F.explode(hexgrid.cell_neighbors(F.col("cell"), level)).alias("dst")
    )
    return steps.join(cells.select(F.col("cell").alias("dst")), "dst", "left_semi").select("src", "dst")


def adjacency_by_distance(cells: DataFrame, reach_km: float, tile: float) -> DataFrame:
    """Edges between centres within ``reach_km``, for ids whose lattice is not at hand.

    ``cells``: cell, lat, lon; a centre without a position has no edge. A hexagon's first ring
    lies one spacing away and the second 1.73, so 1.35 spacings separate them. Centres meet on
    tiles half as high as the reach, at most ``tile`` degrees, and about as wide: each looks into those
    that its circle can touch, over a pole and the 180th meridian too. The chord through
    the sphere decides, and the distance itself only where the chord is within rounding of the reach.
    """
    from dasyspark.functions.geo import haversine_km

    reach = min(max(reach_km, 0.0) / C.EARTH_RADIUS_KM, math.pi)
    height = min(tile, max(math.degrees(reach) / 2, LEAST_TILE))
    lat, lon, band = F.col("lat"), F.col("lon"), F.col("band")
    low, high = band * height - 90, (band + 1) * height - 90

    def band_of(latitude: Column) -> Column:
        return F.least(F.greatest(F.floor((latitude + 90) / height), F.lit(0)), F.lit(math.ceil(180 / height) - 1))

    def slot_of(longitude: Column) -> Column:
        return F.floor((longitude + 180) / 360 * F.col("slots"))

    # Every band has a number of slots of its own, since a degree of longitude gets shorter towards the poles.
    slots = F.greatest(F.floor(360 / height * F.cos(F.radians((low + high) / 2))), F.lit(1)).alias("slots")
    place = F.radians(lat), F.radians(lon)
    spot = cells.where(~F.isnan("lat") & ~F.isnan("lon")).select(
        "cell", "lat", "lon", (F.cos(place[0]) * F.cos(place[1])).alias("x"), (F.cos(place[0]) * F.sin(place[1])).alias("y"),
        F.sin(place[0]).alias("z"),
    )
    lying = spot.withColumn("band", band_of(lat)).select("*", slots)
    lying = lying.withColumn("slot", F.pmod(slot_of(lon), F.col("slots"))).drop("slots")

    span = math.degrees(reach) * (1 + 1e-9) + 1e-9
    looks = spot.select("*", F.explode(F.sequence(band_of(lat - span), band_of(lat + span))).alias("band")).select("*", slots)
    gap = F.sin(F.radians(F.greatest(low - lat, lat - high, F.lit(0.0))) / 2)
    left = F.greatest(F.lit(math.sin(reach / 2) ** 2 * (1 + 1e-9) + 1e-15) - gap * gap, F.lit(0.0))
    ring = F.cos(place[0]) * F.least(F.cos(F.radians(low)), F.cos(F.radians(high)))
    wide = F.when(F.col("left") < F.col("ring"), F.degrees(F.asin(F.sqrt(F.col("left") / F.col("ring")))) * 2 * (1 + 1e-9) + 1e-9).otherwise(180.0)
    looks = looks.withColumns({"left": left, "ring": ring}).withColumn("wide", wide)
    looks = looks.withColumns({"first": slot_of(lon - F.col("wide")), "last": slot_of(lon + F.col("wide"))})
    turn = F.sequence("first", F.least("last", F.col("first") + F.col("slots") - 1))
    looks = looks.select("*", F.explode(turn).alias("slot")).select(
        "band", F.pmod("slot", "slots").alias("slot"), F.col("cell").alias("src"),
        *[F.col(c).alias(f"{c}1") for c in ("lat", "lon", "x", "y", "z")],
    )

    met = looks.join(lying.withColumnRenamed("cell", "dst"), ["band", "slot"])
    chord = 2 * math.sin(reach / 2)
    near, far = max(0.0, chord * (1 - 1e-9) - 1e-13), chord * (1 + 1e-9) + 1e-13
    dx, dy, dz = (F.col(f"{c}1") - F.col(c) for c in ("x", "y", "z"))
    square = dx * dx + dy * dy + dz * dz
    exact = haversine_km(F.col("lat1"), F.col("lon1"), lat, lon) <= reach_km
    within = (square <= far * far) & ((square < near * near) | exact)
    return met.where((F.col("src") != F.col("dst")) & within).select("src", "dst")


def hierarchy_join(cells: DataFrame, level: int, parent_level: int, parents: DataFrame | None = None) -> DataFrame:
    """``child, parent`` for parents that are present."""
    links = cells.select(
        F.col("cell").alias("child"), hexgrid.cell_parent(F.col("cell"), level, parent_level).alias("parent")
    )
    return links if parents is None else links.join(parents.select(F.col("cell").alias("parent")), "parent", "left_semi")


def _vector_agg(rows: DataFrame, by: str, vector: str, dim: int, how: Callable[[Column], Column]) -> DataFrame:
    parts = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), *[how(F.col(vector)[i]).alias(f"_{i}") for i in range(dim)]
    )
    return parts.select(by, "_n", F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("_v"))


def neighbor_mean(nodes: DataFrame, edges: DataFrame, dim: int, vector: str = "h", out: str = "message") -> DataFrame:
    """Sum of the neighbours over (1 + degree); an isolated node gets zeros."""
    sent = edges.join(nodes.select(F.col("cell").alias("src"), vector), "src")
    sums = _vector_agg(sent, "dst", vector, dim, F.sum)
    means = sums.select(
        F.col("dst").alias("cell"), F.transform("_v", lambda v: v / (F.col("_n") + 1)).alias("_m")
    )
    zeros = F.array(*[F.lit(0.0)] * dim)
    return nodes.join(means, "cell", "left").withColumn(out, F.coalesce("_m", zeros)).drop("_m")


def pool_to_parent(nodes: DataFrame, links: DataFrame, dim: int, vector: str = "h", out: str = "pooled") -> DataFrame:
    """Mean of the children: ``parent`` (as ``cell``) and the vector."""
    up = nodes.select(F.col("cell").alias("child"), vector).join(links, "child")
    return _vector_agg(up, "parent", vector, dim, F.avg).select(F.col("parent").alias("cell"), F.col("_v").alias(out))


def broadcast_to_child(
    parents: DataFrame, links: DataFrame, dim: int, vector: str = "h", out: str = "context"
) -> DataFrame:
    """The parent's vector for each child (as ``cell``); zeros without a parent."""
    given = parents.select(F.col("cell").alias("parent"), F.col(vector).alias("_p"))
    zeros = F.array(*[F.lit(0.0)] * dim)
    joined = links.join(given, "parent", "left")
    return joined.select(F.col("child").alias("cell"), F.coalesce("_p", zeros).alias(out))


def initial_residual(new: Column, first: Column, alpha: float = C.RESIDUAL_ALPHA) -> Column:
    return F.zip_with(new, first, lambda a, b: a * F.lit(1 - alpha) + b * F.lit(alpha))


def feature_index(rows: DataFrame, name: str) -> DataFrame:
    """Zero-based position of each distinct name in sorted order: ``name, idx``.

    Names are few compared to rows; they are ranked by the exact distributed
    counts of their sort order, so no task holds them all.
    """
    distinct = rows.select(name).distinct()
    ordered = materialize(distinct.orderBy(name).withColumn("_part", F.spark_partition_id()), "names")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(name)) - 1
    return ordered.join(offsets, "_part").select(name, (within + F.col("_before")).alias("idx"))


def parent_features(cells: DataFrame, parent: str, names: Sequence[str]) -> DataFrame:
    """Features of a coarser cell: the mean of all its finest cells."""
    return cells.groupBy(parent).agg(*[F.avg(n).alias(n) for n in names])


def propagate(nodes: DataFrame, edges: DataFrame, dim: int, hops: int, links: DataFrame | None = None) -> DataFrame:
    """Own vector, neighbour means of 1..``hops`` hops and the parent's mean, concatenated as ``z``."""
    current = nodes.withColumn("z", F.col("h")).withColumn("_hop", F.col("h"))
    tables = Superseding()
    for _ in range(hops):
        sources = current.select("cell", F.col("_hop").alias("h"))
        means = neighbor_mean(sources, edges, dim).select("cell", F.col("message").alias("_next"))
        current = current.join(means, "cell").withColumns(
            {"z": F.concat("z", "_next"), "_hop": F.col("_next")}
        ).drop("_next")
        current = tables.write(current, "hop")
    if links is not None:
        up = pool_to_parent(nodes, links, dim).withColumnRenamed("pooled", "h")
        context = broadcast_to_child(up, links, dim)
        current = current.join(context, "cell", "left").withColumn(
            "z", F.concat("z", F.coalesce("context", F.array(*[F.lit(0.0)] * dim)))
        ).drop("context")
    return current.drop("_hop")


def within_territories(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends lie in one territory (``state`` of ``nodes``): each has a graph of its own."""
    owner = nodes.select("cell", "state")
    a = owner.withColumnsRenamed({"cell": "src", "state": "_s"})
    b = owner.withColumnsRenamed({"cell": "dst", "state": "_d"})
    return edges.join(a, "src").join(b, "dst").where(F.col("_s").eqNullSafe(F.col("_d"))).select("src", "dst")


def design_matrix(
    cells: DataFrame, names: Sequence[str], edges: DataFrame | None = None, links: DataFrame | None = None, hops: int = 2
) -> DataFrame:
    """What the fit reads: ``cell, unit, state, population, x``, written once.

    ``x`` holds the columns ``names`` and, with ``edges``, their means over 1..``hops``
    hops and, with ``links``, the mean of the parent (see ``propagate``). Rows lie
    range-partitioned and sorted by territory and unit, so that a task of an epoch meets few
    units; the cell as third key splits a unit that holds much of the data.
    """
    nodes = cells.select(
        "cell", "unit", "state", F.col("population").cast("double").alias("population"),
        F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("h"),
    )
    if edges is not None or links is not None:
        nodes = materialize(nodes, "nodes")
        none = cells.select(F.col("cell").alias("src"), F.col("cell").alias("dst")).limit(0)
        nodes = propagate(nodes, none if edges is None else edges, len(names), hops if edges is not None else 0, links)
    else:
        nodes = nodes.withColumn("z", F.col("h"))
    flat = nodes.select("cell", "unit", "state", "population", F.col("z").alias("x"))
    tasks = nodes.sparkSession.sparkContext.defaultParallelism
    tasks = max(tasks, nodes.count() // CELLS_PER_TASK)
    return materialize(flat.repartitionByRange(tasks, "state", "unit", "cell").sortWithinPartitions("state", "unit"), "design")


# ------------------------------------------------------------ published layer


def init_weights(in_dim: int, hidden: int = C.HIDDEN, layers: int = C.LAYERS, seed: int = 0) -> dict[str, np.ndarray]:
    """A weight table of the right shapes, uniform within 1/sqrt(inputs)."""
    rng = np.random.default_rng(seed)

    def linear(name: str, rows: int, cols: int) -> dict[str, np.ndarray]:
        edge = 1 / math.sqrt(cols)
        return {f"{name}.w": rng.uniform(-edge, edge, (rows, cols)), f"{name}.b": rng.uniform(-edge, edge, rows)}

    table: dict[str, np.ndarray] = {}
    for lvl in ("fine", "mid", "coarse"):
        table |= linear(f"in.{lvl}", hidden, in_dim)
        for k in range(layers):
            table |= linear(f"self.{lvl}.{k}", hidden, hidden) | linear(f"near.{lvl}.{k}", hidden, hidden)
    for k in range(layers):
        for name in ("up.mid", "up.coarse", "down.fine", "down.mid"):
            table |= linear(f"{name}.{k}", hidden, hidden)
    return table | linear("mix", hidden, 2 * hidden) | linear("out", 1, hidden)


def dense(terms: Sequence[tuple[Column, np.ndarray]], bias: np.ndarray, elu: bool) -> Column:
    """``sum(W x) + b`` over several vector columns, batch-wise in numpy, optionally through ELU.

    The vectors are joined into one column and the matrices stacked to match.
    """
    matrix = np.concatenate([np.asarray(w, dtype=float) for _, w in terms], axis=1).T
    offset = np.asarray(bias, dtype=float)

    def apply(vectors: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        total = np.stack(vectors.to_numpy()).astype(float) @ matrix + offset
        if elu:
            total = np.where(total > 0, total, np.expm1(np.minimum(total, 0)))
        return pd.Series(list(total))

    return F.pandas_udf(apply, "array<double>")(F.concat(*[c for c, _ in terms]))


def score_layers(
    fine: DataFrame,
    mid: DataFrame,
    coarse: DataFrame,
    edges: Mapping[str, DataFrame],
    fine_links: DataFrame,
    mid_links: DataFrame,
    weights: Weights,
    in_dim: int,
    hidden: int = C.HIDDEN,
    layers: int = C.LAYERS,
    alpha: float = C.RESIDUAL_ALPHA,
) -> DataFrame:
    """Intensity of the fine cells under a given weight table.

    Node tables have ``cell`` and the input vector ``x``; links are
    ``child, parent``. All levels update from the values of the layer before,
    and each layer is written out, so lineage stays one layer deep.
    """
    state = {}
    for lvl, nodes in (("fine", fine), ("mid", mid), ("coarse", coarse)):
        first = dense([(F.col("x"), weights[f"in.{lvl}.w"])], weights[f"in.{lvl}.b"], elu=True)
        state[lvl] = materialize(nodes.select("cell", first.alias("h")).withColumn("h0", F.col("h")), f"layer0-{lvl}")
    zeros = F.array(*[F.lit(0.0)] * hidden)
    for k in range(layers):
        near = {}
        for lvl, nodes in state.items():
            sent = neighbor_mean(nodes, edges[lvl], hidden)
            a = dense(
                [(F.col("h"), weights[f"self.{lvl}.{k}.w"]), (F.col("message"), weights[f"near.{lvl}.{k}.w"])],
                weights[f"self.{lvl}.{k}.b"] + weights[f"near.{lvl}.{k}.b"],
                elu=True,
            )
            near[lvl] = sent.select("cell", "h0", a.alias("a"))
        # A child without a parent gets a zero vector, not the bias of the map.
        down_fine = broadcast_to_child(state["mid"], fine_links, hidden).select(
            "cell", dense([(F.col("context"), weights[f"down.fine.{k}.w"])], weights[f"down.fine.{k}.b"], elu=False).alias("d")
        )
        down_mid = broadcast_to_child(state["coarse"], mid_links, hidden).select(
            "cell", dense([(F.col("context"), weights[f"down.mid.{k}.w"])], weights[f"down.mid.{k}.b"], elu=False).alias("d")
        )
        up_mid = pool_to_parent(state["fine"], fine_links, hidden)
        up_coarse = pool_to_parent(state["mid"], mid_links, hidden)
        eye = np.eye(hidden)
        mixed = dense(
            [(F.col("a"), weights["mix.w"][:, :hidden]), (F.col("d"), weights["mix.w"][:, hidden:])],
            weights["mix.b"],
            elu=True,
        )
        into_mid = dense(
            [(F.col("a"), eye), (F.col("pooled"), weights[f"up.mid.{k}.w"]), (F.col("d"), eye)],
            weights[f"up.mid.{k}.b"],
            elu=True,
        )
        into_coarse = dense(
            [(F.col("a"), eye), (F.col("pooled"), weights[f"up.coarse.{k}.w"])], weights[f"up.coarse.{k}.b"], elu=True
        )

        def filled(df: DataFrame, *names: str) -> DataFrame:
            return df.withColumns({n: F.coalesce(n, zeros) for n in names})

        fresh = {
            "fine": filled(near["fine"].join(down_fine, "cell", "left"), "d").withColumn("_new", mixed),
            "mid": filled(
                near["mid"].join(up_mid, "cell", "left").join(down_mid, "cell", "left"), "pooled", "d"
            ).withColumn("_new", into_mid),
            "coarse": filled(near["coarse"].join(up_coarse, "cell", "left"), "pooled").withColumn("_new", into_coarse),
        }
        state = {
            lvl: materialize(
                df.select("cell", initial_residual(F.col("_new"), F.col("h0"), alpha).alias("h"), "h0"), f"layer{k + 1}-{lvl}"
            )
            for lvl, df in fresh.items()
        }
    logit = dense([(F.col("h"), weights["out.w"])], weights["out.b"], elu=False)[0]
    from dasyspark.functions.numbers import softplus

    return state["fine"].select("cell", logit.alias("logit")).select("cell", softplus(F.col("logit")).alias("intensity_raw"))
