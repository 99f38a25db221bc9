"""The whole job: targets, features, fit, allocation, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dasyspark import config as C
from dasyspark.operators.allocate import dasymetric_allocate, ensemble_allocate, ranked_wealth
from dasyspark.operators.features import engineer_features
from dasyspark.operators.fit import Fit, fit_intensity
from dasyspark.operators.graph import design_matrix
from dasyspark.operators.joins import join_targets, unit_key
from dasyspark.session import materialize


def allocate_and_rank(cells: DataFrame, totals: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Cells with ``intensity_raw`` -> allocation, per-capita, wealth index and quintile.

    The allocated table is written once, since ranking reads it twice.
    """
    return ranked_wealth(materialize(dasymetric_allocate(cells, totals, units=units), "allocated"))


def disaggregate(
    cells: DataFrame,
    totals: DataFrame,
    epochs: int = C.EPOCHS,
    seeds: Sequence[int] = C.SEEDS,
    lr: float = C.LEARNING_RATE,
    units: DataFrame | None = None,
    territories: DataFrame | None = None,
    edges: DataFrame | None = None,
    links: DataFrame | None = None,
) -> tuple[DataFrame, Fit]:
    """Fit all seeds of every territory and allocate their mean, with ranges over seeds.

    ``cells``: cell, unit, state, population and the evidence columns. With ``edges`` and
    ``links`` the fit also reads the features' means over neighbours and parents.
    """
    kept = join_targets(cells, totals.select(*unit_key(cells, totals)), bound=units)
    features, names = engineer_features(kept, territories=territories)
    features = materialize(features, "features")
    design = design_matrix(features, names, edges, links)
    fit = fit_intensity(design, totals, epochs, seeds, lr, tag="ensemble")
    runs = fit.runs(design, ["cell", "unit", "state", "population"])
    return ensemble_allocate(runs, features, totals, units, len(seeds)), fit
