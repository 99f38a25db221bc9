"""Zero-inflation split, log magnitudes and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions.numbers import exists_flag, log_magnitude
from dasyspark.operators.joins import attach


def derived_columns(
    columns: Sequence[str],
    magnitudes: Sequence[str] = C.MAGNITUDE_COLUMNS,
    shares: Sequence[str] = C.SHARE_COLUMNS,
) -> dict[str, Column]:
    """Engineered columns by name, for those base columns that exist."""
    out: dict[str, Column] = {}
    for name in (c for c in magnitudes if c in columns):
        base = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        out[f"{name}_exists"] = exists_flag(base)
        out[f"{name}_log"] = log_magnitude(base)
    for name in (c for c in shares if c in columns):
        base = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        out[name] = base
        out[f"{name}_exists"] = exists_flag(base)
    return out


def drop_constant_lights(cells: DataFrame, names: Sequence[str]) -> list[str]:
    """Feature names without the lights if no cell is lit at all."""
    if "night_lights" in cells.columns:
        total = cells.agg(F.sum("night_lights")).first()[0]
        if total:
            return list(names)
    return [n for n in names if not n.startswith("night_lights")]


def zscore_stats(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column and territory; a zero deviation becomes 1."""
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mu"), F.stddev_pop(n).alias(f"{n}_sd")]
    raw = df.groupBy(*by).agg(*aggs)
    fixed = []
    for n in names:
        sd = F.col(f"{n}_sd")
        fixed += [F.col(f"{n}_mu"), F.when(sd != 0, sd).otherwise(F.lit(1.0)).alias(f"{n}_sd")]
    return raw.select(*by, *fixed)


def engineer_features(
    cells: DataFrame,
    by: Sequence[str] = ("state",),
    territories: DataFrame | None = None,
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Cells with the engineered columns and their ``_z`` twins, and the z names in order.

    Two wide projections and one aggregate, whatever the number of features.
    ``territories`` bounds the number of statistics rows for the broadcast.
    """
    derived = derived_columns(cells.columns)
    names = drop_constant_lights(cells, list(derived))
    base = [c for c in cells.columns if c not in derived and (keep is None or c in keep or c in by)]
    wide = cells.select(*base, *[col.alias(name) for name, col in derived.items()])
    joined = attach(wide, zscore_stats(wide, by, names), list(by), "inner", territories)
    z = [((F.col(n) - F.col(f"{n}_mu")) / F.col(f"{n}_sd")).alias(f"{n}_z") for n in names]
    return joined.select(*wide.columns, *z), [f"{n}_z" for n in names]


def assemble_vector(df: DataFrame, names: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(n).cast("double") for n in names]))


def describe_inputs(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of the known values, in one aggregate over ranked rows."""
    from dasyspark.operators.ranks import interpolated, placed, quantile_picks

    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    found = placed(known, by, value).groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), *quantile_picks(value, quartiles),
    )
    columns = [c.alias(n) for n, c in interpolated(value, quartiles).items()]
    return found.select(*by, "count", "mean", "std", "min", "max", *columns)
