"""Context of single cells: presets, unusual inputs, neighbours, allocation chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.operators.joins import attach, unit_key
from dasyspark.operators.ranks import interpolated, placed, quantile_picks
from dasyspark.session import materialize


def pick_presets(cells: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """A rich, populous cell and a poor, rural one per territory.

    Rich: highest wealth from the 80th population percentile up. Poor: lowest
    wealth between the 20th and 60th with at most median roads. An empty pool
    falls back to the whole table; ties go to the smaller cell id.
    """
    by = list(by)
    people, roads = {"p20": 0.2, "p60": 0.6, "p80": 0.8}, {"road_mid": 0.5}
    narrow = cells.select(*by, "cell", "population", "road_km", "wealth_index")
    rows = narrow.count()
    ranks = placed(narrow, by, "population", rows)
    ranks = placed(ranks, by, "road_km", rows, ("_b", "_e", "_a"))
    found = ranks.groupBy(*by).agg(*quantile_picks("population", people), *quantile_picks("road_km", roads, ("_b", "_e", "_a")))
    columns = interpolated("population", people) | interpolated("road_km", roads)
    cuts = materialize(found.select(*by, *[c.alias(n) for n, c in columns.items()]), "cuts")
    joined = attach(narrow, cuts, by, "inner", bound=cuts)
    rich = F.col("population") >= F.col("p80")
    rural = F.col("population").between(F.col("p20"), F.col("p60")) & (F.col("road_km") <= F.col("road_mid"))
    high = F.struct((-F.col("wealth_index")).alias("w"), F.col("cell").alias("c"))
    low = F.struct(F.col("wealth_index").alias("w"), F.col("cell").alias("c"))
    picked = joined.groupBy(*by).agg(
        F.min(F.when(rich, high)).alias("_r"), F.min(high).alias("_ra"),
        F.min(F.when(rural, low)).alias("_p"), F.min(low).alias("_pa"),
    )
    return picked.select(
        *by, F.coalesce("_r", "_ra")["c"].alias("rich_urban"), F.coalesce("_p", "_pa")["c"].alias("poor_rural")
    )


def top_features(cells: DataFrame, names: Sequence[str], top: int = 10) -> DataFrame:
    """Most unusual z-scores of each cell, without any shuffle: ``cell, rank, feature, z``."""
    entries = F.array(
        *[
            F.when(
                F.col(n).isNotNull(),
                F.struct((-F.abs(F.round(n, 4))).alias("_key"), F.lit(n).alias("feature"), F.round(n, 4).alias("z")),
            )
            for n in names
        ]
    )
    best = F.slice(F.array_sort(F.array_compact(entries)), 1, top)
    rows = cells.select("cell", F.posexplode(best).alias("_pos", "_e"))
    return rows.select("cell", (F.col("_pos") + 1).alias("rank"), "_e.feature", "_e.z")


def neighbor_profile(cells: DataFrame, edges: DataFrame, attributes: Sequence[str], chosen: DataFrame | None = None) -> DataFrame:
    """Present neighbours of the chosen cells, with their attributes; ``edges`` of the lattice, so at most six each."""
    near = edges if chosen is None else edges.join(chosen.select(F.col("cell").alias("src")), "src", "left_semi")
    rows = near.join(cells.select(F.col("cell").alias("dst"), *attributes), "dst")
    listed = F.sort_array(F.collect_list(F.struct("dst", *attributes)))
    return rows.groupBy(F.col("src").alias("cell")).agg(listed.alias("neighbors"))


def unit_context(cells: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    return cells.groupBy(*(by or unit_key(cells))).agg(
        F.count(F.lit(1)).alias("n_cells"), F.max("y_inr").alias("y_inr"),
        F.sum("gdp_inr_raw").alias("unit_sum_raw"), F.max("dasymetric_scale").alias("dasymetric_scale"),
        F.sum("population").alias("population"), F.sum("gdp_inr").alias("gdp_inr_after_scale"),
    )


ALLOCATED = ("intensity_raw", "gdp_inr_raw", "dasymetric_scale", "gdp_inr", "gdp_per_capita_inr", "wealth_index")


def cell_dossier(
    cells: DataFrame, edges: DataFrame, chosen: DataFrame, attributes: Sequence[str], features: Sequence[str],
    units: DataFrame | None = None, parents: Sequence[str] = (),
) -> DataFrame:
    """Everything about the chosen cells, one JSON document each: ``cell, unit, dossier``.

    Position and ``parents`` (columns of coarser cells), the raw ``attributes``, the logged and
    presence values they turn into (columns ending in _log and _exists), the z ``features`` and
    the most unusual of them, lattice neighbours with the same attributes, the chain of the
    allocation with the range over seeds (_min, _max) where there is one, and the unit.
    """
    have = cells.columns
    rows = cells.join(chosen.select("cell"), "cell", "left_semi")
    unusual = top_features(rows, features)
    best = unusual.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "z"))).alias("top"))
    context = unit_context(cells)
    facts = [c for c in context.columns if c not in unit_key(cells)]
    context = context.select(*unit_key(cells), F.struct(*facts).alias("unit_context"))
    full = attach(rows, context, unit_key(cells), "left", units)
    full = full.join(neighbor_profile(cells, edges, attributes, chosen), "cell", "left").join(best, "cell", "left")
    logged = [c for c in have if c.endswith(("_log", "_exists"))]
    ranges = [f"{c}_{end}" for c in ALLOCATED for end in ("min", "max") if f"{c}_{end}" in have]
    parts = {
        "position": [c for c in ("lat", "lon") if c in have], "parents": list(parents), "inputs": list(attributes), "logged_values": logged,
        "features_z": list(features), "allocation": [*ALLOCATED, *ranges],
    }
    body = F.struct(
        "unit", *[F.struct(*names).alias(part) for part, names in parts.items() if names], "neighbors", "unit_context", F.col("top").alias("top_features")
    )
    return full.select("cell", "unit", F.to_json(body).alias("dossier"))
