"""From scanned boundaries, published totals and evidence to the cell table that the fit starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.functions import hexgrid
from dasyspark.functions.names import norm_unit_name
from dasyspark.operators.evidence import bin_elements, finalise_cell_features
from dasyspark.operators.joins import attach, dedupe_elements, join_targets, lookup_fill
from dasyspark.operators.spatial import area_centroids, containing_units, polyfill
from dasyspark.operators.targets import agg_targets, resolve_sources
from dasyspark.session import materialize
from dasyspark.sources.totals import feature_rings


def reporting_units(features: DataFrame, borders: DataFrame, aliases: DataFrame, territories: DataFrame) -> DataFrame:
    """``state, unit, part, ring``: boundary features as the units that each territory reports on.

    ``features``: name and polygons, of all territories (``scan_geojson_features``).
    ``borders``: ring rows whose ``unit`` is the territory's code. A feature belongs to the
    territories that hold its centroid; there it takes its canonical name, or the one name
    of a territory with ``dissolve_to``. Features of one name become parts of one unit.
    """
    known = materialize(features.select("name", "polygons").withColumn("_id", F.monotonically_increasing_id().cast("string")), "features")
    rings = materialize(feature_rings(known, "_id", F.lit("")), "rings")
    centroids = area_centroids(rings).withColumnRenamed("unit", "cell")
    owned = containing_units(centroids, borders).select(F.col("cell").alias("_id"), F.col("unit").alias("code"))
    named = norm_unit_name(known.select("_id", "name").join(owned, "_id"), "name", aliases)
    single = attach(named, territories.select("code", "dissolve_to"), "code", "left", territories)
    units = single.select("_id", F.col("code").alias("state"), F.coalesce("dissolve_to", "unit").alias("unit"))
    parts = rings.withColumnsRenamed({"unit": "_id", "part": "_part"}).join(units, "_id")
    return parts.select("state", "unit", F.concat("_id", "_part").alias("part"), "ring")


def fill_cells(units: DataFrame, level: int, parents: Sequence[int] = ()) -> DataFrame:
    """The cells of all units: ``cell, state, unit, lat, lon, area_km2`` and a column ``parent_<level>`` for each coarser level."""
    cell = F.col("cell")
    extra = {f"parent_{p}": hexgrid.cell_parent(cell, level, p) for p in parents}
    return polyfill(units, level, ("state",)).withColumns({"area_km2": F.lit(hexgrid.cell_area(level)), **extra})


def published_totals(sources: Sequence[DataFrame], settings: DataFrame, aliases: DataFrame) -> DataFrame:
    """``state, unit, y_crore, y_inr, source_name``: one total per canonical unit, from each territory's best source.

    ``sources``, best first: code, source_name, y_crore, position (the order within the source) and
    optionally ``raw`` (amounts in the source's own scale, whose names may have to be
    dropped). ``settings``: code, value_scale, drop_names (``config.total_source_table``).
    """
    ready = []
    for rows in sources:
        raw = F.col("raw") if "raw" in rows.columns else F.lit(False)
        met = attach(rows.withColumn("_raw", raw), settings.select("code", "value_scale", "drop_names"), "code", "left", settings)
        dropped = F.coalesce(F.array_contains(F.transform("drop_names", F.lower), F.lower(F.trim("source_name"))), F.lit(False))
        scale = F.when(F.col("_raw"), F.coalesce("value_scale", F.lit(1.0))).otherwise(1.0)
        ready.append(met.where(~(F.col("_raw") & dropped)).select("code", "source_name", (F.col("y_crore") * scale).alias("y_crore"), "position"))
    best = resolve_sources(ready, "code")
    named = norm_unit_name(best, "source_name", aliases)
    return agg_targets(named.withColumnRenamed("code", "state"), order=["position", "source_name"])


def build_cells(
    features: DataFrame,
    borders: DataFrame,
    sources: Sequence[DataFrame],
    settings: DataFrame,
    aliases: DataFrame,
    territories: DataFrame,
    level: int,
    measures: Sequence[DataFrame] = (),
    elements: DataFrame | None = None,
    parents: Sequence[int] = (),
    check: bool = True,
) -> DataFrame:
    """The whole cell table: units, cells, evidence and published totals.

    ``measures``: tables of ``cell`` and value columns on this grid (population, lights);
    ``elements``: mapped elements, a written table whose copies count once. Cells without a
    measure get 0, cells of units without a total go; with ``check`` a total without cells raises.
    """
    cells = materialize(fill_cells(reporting_units(features, borders, aliases, territories), level, parents), "cells")
    for table in measures:
        cells = lookup_fill(cells, table, "cell", [c for c in table.columns if c != "cell"])
    if elements is not None:
        order = [c for c in ("tile", "position") if c in elements.columns]
        binned = bin_elements(dedupe_elements(elements, ["type", "id"], order), level)
        cells = finalise_cell_features(cells, materialize(binned, "binned"))
    totals = materialize(published_totals(sources, settings, aliases), "totals")
    return join_targets(cells, totals, check=check)
