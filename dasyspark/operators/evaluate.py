"""One report over hold-out, ablation and rank correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.operators.allocate import ensemble_allocate, log_loss
from dasyspark.operators.fit import ablation, best_epoch, fit_intensity, spatial_holdout
from dasyspark.operators.joins import UNIT_KEY
from dasyspark.operators.ranks import spearman
from dasyspark.session import materialize

PAIRS = {
    "wealth_index_vs_night_lights": ("wealth_index", "night_lights"),
    "wealth_index_vs_road_km": ("wealth_index", "road_km"),
    "wealth_index_vs_poi_count": ("wealth_index", "poi_count"),
    "gdp_per_capita_vs_night_lights": ("gdp_per_capita_inr", "night_lights"),
}


def spearman_sanity(ranked: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """The fixed pairs over inhabited cells; a sanity check, not ground truth."""
    live = ranked.where(F.col("population") > 0)
    pairs = {p: ab for p, ab in PAIRS.items() if set(ab) <= set(live.columns)}
    return spearman(live, by, pairs)


def evaluation_report(
    cells: DataFrame, designs: dict[str, DataFrame], totals: DataFrame, epochs: int = C.EPOCHS, seeds: Sequence[int] = C.SEEDS,
    lr: float = C.LEARNING_RATE, units: DataFrame | None = None,
) -> DataFrame:
    """``section, state, item, value`` rows about the ensemble of every territory.

    ``ensemble``: loss of the mean intensity before scaling, and the best training loss of
    each seed. ``holdout``: error on totals of unseen units. ``ablation``: loss under each
    of ``designs``, of which the first is the one to publish. ``spearman``: which evidence
    the wealth of the ensemble follows.
    """
    design = next(iter(designs.values()))
    fit = fit_intensity(design, totals, epochs, seeds, lr, tag="ensemble")
    runs = materialize(fit.runs(design, ["cell", "unit", "state", "population"]), "runs")
    mean = runs.groupBy("cell", *UNIT_KEY, "population").agg(F.avg("intensity_raw").alias("intensity_raw"))
    losses = log_loss(mean.join(totals.select(*UNIT_KEY, "y_inr"), list(UNIT_KEY)), ("state",))

    def rows(df: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), "state", item.alias("item"), value.cast("double").alias("value"))

    report = rows(losses, "ensemble", F.lit("log_loss"), F.col("log_loss"))
    best = best_epoch(fit.history_table(design))
    report = report.unionByName(rows(best, "ensemble", F.concat_ws(" ", F.lit("best_loss"), F.col("seed").cast("string")), F.col("loss")))
    kept = cells.join(totals.select(*UNIT_KEY), list(UNIT_KEY), "left_semi")
    ranked = ensemble_allocate(runs, kept, totals, units, len(seeds))
    columns = ["state", "population", "wealth_index", "night_lights", "road_km", "poi_count", "gdp_per_capita_inr"]
    ranked = materialize(ranked.select(*columns), "ranked")
    report = report.unionByName(rows(spearman_sanity(ranked), "spearman", F.col("pair"), F.col("rho")))
    tried = ablation(designs, totals, epochs, seeds[0], lr, made={next(iter(designs)): fit})
    report = report.unionByName(rows(tried, "ablation", F.col("tag"), F.col("log_loss")))
    held = spatial_holdout(design, totals, epochs, seeds[0], lr)
    item = F.when(F.col("skipped"), "skipped, units").otherwise("mape")
    return report.unionByName(rows(held, "holdout", item, F.when(F.col("skipped"), F.col("n_units")).otherwise(F.col("holdout_mape"))))
