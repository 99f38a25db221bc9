"""Number parsing, ratios, activations and rounding as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dasyspark import config as C


def _parse(col: Column, junk: str) -> Column:
    kept = F.regexp_replace(col, junk, "")
    return F.when(~kept.isin("", "-", "."), kept).try_cast("double")


def parse_inr_number(col: Column) -> Column:
    """Number from text with grouping commas and currency signs; junk gives null."""
    value = _parse(col.cast("string"), r"[^0-9.\-eE]")
    return F.when(~F.isnan(value), value)


def to_float_lenient(col: Column) -> Column:
    """Like ``parse_inr_number`` but exponents are not recognised."""
    return _parse(col.cast("string"), r"[^0-9.\-]")


def safe_ratio_clip(part_m2: Column, area_km2: Column) -> Column:
    """Share of a cell covered, clipped to [0, 1.5]; unknown gives 0."""
    share = part_m2 / F.nullif(area_km2 * F.lit(1e6), F.lit(0.0))
    return F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(C.SHARE_CAP)), F.lit(0.0))


def safe_density(count: Column, area_km2: Column) -> Column:
    return F.coalesce(count / F.nullif(area_km2, F.lit(0.0)), F.lit(0.0))


def exists_flag(col: Column) -> Column:
    return F.when(col > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def log_magnitude(col: Column) -> Column:
    return F.when(col > 0, F.log10(col)).otherwise(F.lit(0.0))


def crore_to_inr(col: Column) -> Column:
    return col * F.lit(C.INR_PER_CRORE)


def inr_to_crore(col: Column) -> Column:
    return col / F.lit(C.INR_PER_CRORE)


def lakh_to_crore(col: Column) -> Column:
    return col * F.lit(C.CRORE_PER_LAKH)


def per_capita(amount: Column, population: Column) -> Column:
    return F.when(population > 0, amount / population)


def softplus(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0)) + F.log1p(F.exp(-F.abs(col)))


def elu(col: Column) -> Column:
    return F.when(col > 0, col).otherwise(F.expm1(col))


def bucket_quintile(index: Column) -> Column:
    """Right-closed fifths of a 0..100 index."""
    fifth = F.when(index <= 20, 1).when(index <= 40, 2).when(index <= 60, 3).when(index <= 80, 4)
    return F.when(index.isNotNull(), fifth.otherwise(5))


def round_pack(col: Column, key: str) -> Column:
    """Round to the decimals of a short key, ties to even."""
    decimals = C.KEY_DECIMALS.get(key)
    return col if decimals is None else F.bround(col, decimals)


def short_key(metric: Column) -> Column:
    """Short payload key of a metric id."""
    fixed = F.create_map(*[F.lit(x) for pair in C.SHORT_KEYS.items() for x in pair])
    letters = F.substring(F.regexp_replace(F.substr(metric, F.lit(5)), "[^a-z]", ""), 1, 10)
    return F.coalesce(
        fixed[metric],
        F.when(metric.startswith("landuse_"), F.concat(F.lit("lu_"), F.substring(metric, 9, 3))),
        F.when(metric.startswith("poi_"), F.concat(F.lit("pg_"), letters)),
        metric,
    )


def key_of(column: str) -> str:
    """Python twin of ``short_key`` for choosing columns at plan time."""
    if column.startswith("landuse_"):
        return "lu_" + column[8:11]
    if column.startswith("poi_") and column not in C.SHORT_KEYS:
        return "pg_" + "".join(c for c in column[4:] if "a" <= c <= "z")[:10]
    return C.SHORT_KEYS.get(column, column)


def select_by_pattern(columns: Iterable[str], prefixes: Iterable[str] = (), suffixes: Iterable[str] = ()) -> list[str]:
    starts, ends = tuple(prefixes), tuple(suffixes)
    return [c for c in columns if (starts and c.startswith(starts)) or (ends and c.endswith(ends))]


def ablate_features(columns: Iterable[str], containing: str = "night_lights") -> list[str]:
    return [c for c in columns if containing not in c]
