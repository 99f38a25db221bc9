"""Splitting published totals over cells, and checking the split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions.numbers import bucket_quintile, inr_to_crore, per_capita
from dasyspark.operators.joins import attach, unique_totals, unit_key
from dasyspark.operators.ranks import wealth_index
from dasyspark.session import materialize


def unit_sums(cells: DataFrame, by: Sequence[str], weight: Column, out: str = "unit_sum_raw") -> DataFrame:
    return cells.groupBy(*by).agg(F.sum(weight).alias(out))


def unit_factors(
    cells: DataFrame, totals: DataFrame, intensity: str = "intensity_raw", by: Sequence[str] | None = None
) -> DataFrame:
    """One scale per unit: published total over the raw sum of its cells."""
    by = by or unit_key(cells, totals)
    raw = unit_sums(cells, by, F.col(intensity) * F.col("population"))
    keys = [c for c in by if c in totals.columns]
    joined = raw.join(unique_totals(totals.select(*keys, "y_inr"), keys), keys)
    scale = F.col("y_inr") / F.greatest(F.col("unit_sum_raw"), F.lit(C.SCALE_EPS))
    return joined.withColumn("dasymetric_scale", scale)


def dasymetric_allocate(
    cells: DataFrame,
    totals: DataFrame,
    intensity: str = "intensity_raw",
    by: Sequence[str] | None = None,
    units: DataFrame | None = None,
    copies: int = 1,
) -> DataFrame:
    """Allocate ``y_inr`` of each unit in proportion to intensity x population.

    ``by`` names a unit, by default ``unit_key``: names alone may occur in several territories. A key with
    two totals raises. ``units`` is the dimension the unit keys come from; its size decides
    whether the per-unit factors, ``copies`` for each unit, are broadcast (see
    ``attach``).
    """
    by = by or unit_key(cells, totals)
    factors = unit_factors(cells, totals, intensity, by).select(*by, "y_inr", "dasymetric_scale")
    raw = F.col(intensity) * F.col("population")
    gdp = raw * F.col("dasymetric_scale")
    bound = units if units is not None else totals
    return attach(cells, factors, list(by), "inner", bound, copies).withColumns(
        {
            "gdp_inr_raw": raw,
            "gdp_inr": gdp,
            "gdp_crore": inr_to_crore(gdp),
            "gdp_per_capita_inr": per_capita(gdp, F.col("population")),
        }
    )


def population_allocate(cells: DataFrame, totals: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Baseline: every person weighs the same."""
    return dasymetric_allocate(cells.withColumn("intensity_raw", F.lit(1.0)), totals, units=units)


def ranked_wealth(allocated: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    return wealth_index(allocated, by).withColumn("wealth_quintile", bucket_quintile(F.col("wealth_index")))


def ensemble_stats(runs: DataFrame, cell: str = "cell") -> DataFrame:
    """Mean and range over seeds of each cell; nulls do not count."""
    wanted = {"intensity_raw": "intensity_raw", "gdp_per_capita_inr": "gdp_per_capita_inr", "wealth_index": "wealth_index"}
    aggs = []
    for column, name in wanted.items():
        aggs += [
            F.avg(column).alias(f"{name}_mean"),
            F.min(column).alias(f"{name}_min"),
            F.max(column).alias(f"{name}_max"),
        ]
    return runs.groupBy(cell).agg(*aggs)


def ensemble_allocate(
    runs: DataFrame, cells: DataFrame, totals: DataFrame, units: DataFrame | None = None, n_seeds: int = len(C.SEEDS)
) -> DataFrame:
    """Central estimate: the mean intensity, allocated once more, with the ranges over seeds.

    ``runs``: cell, seed, unit, population, state, intensity_raw.
    """
    per_seed = dasymetric_allocate(runs, totals, by=("seed", *unit_key(runs, totals)), units=units, copies=n_seeds)
    kept = ["cell", "seed", *unit_key(runs, totals), "population", "intensity_raw", "gdp_per_capita_inr"]
    per_seed = materialize(per_seed.select(*dict.fromkeys([*kept, "state"])), "per-seed")
    stats = ensemble_stats(wealth_index(per_seed, ("seed", "state")))
    central = cells.join(stats, "cell").withColumn("intensity_raw", F.col("intensity_raw_mean"))
    return ranked_wealth(materialize(dasymetric_allocate(central, totals, units=units), "central"))


def log_loss(cells: DataFrame, by: Sequence[str] = (), unit: Sequence[str] | None = None) -> DataFrame:
    """Mean squared log10 gap between raw unit sums and published totals."""
    units = cells.groupBy(*dict.fromkeys((*(unit or unit_key(cells)), *by))).agg(
        F.sum(F.col("intensity_raw") * F.col("population")).alias("_hat"), F.max("y_inr").alias("_y")
    )
    gap = F.log10(F.col("_hat") + F.lit(C.LOG_EPS)) - F.log10(F.col("_y") + F.lit(C.LOG_EPS))
    return units.groupBy(*by).agg(F.avg(gap * gap).alias("log_loss"))


def floor_penalty(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    short = F.greatest(F.lit(0.0), F.lit(C.FLOOR_TAU) - F.col("intensity_raw"))
    return cells.groupBy(*by).agg(
        (F.sum(F.col("population") * short * short) / F.greatest(F.sum("population"), F.lit(1.0))).alias("floor_penalty")
    )


def reconstruction_error(cells: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Relative gap per unit between the allocated sum and the published total."""
    units = cells.groupBy(*(by or unit_key(cells))).agg(F.sum("gdp_inr").alias("allocated"), F.max("y_inr").alias("y_inr"))
    return units.withColumn("rel_error", F.abs(F.col("allocated") - F.col("y_inr")) / F.col("y_inr"))


def mape(predicted: Column, observed: Column) -> Column:
    """Aggregate: mean absolute error relative to the observation."""
    return F.avg(F.abs(predicted - observed) / F.greatest(F.abs(observed), F.lit(1e-9)))
