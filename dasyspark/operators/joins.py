"""Equi-joins that stay safe when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark.session import fits_broadcast, has_at_most


# A unit's name is unique within its territory only.
UNIT_KEY = ("state", "unit")


def unit_key(*tables: DataFrame) -> list[str]:
    """The columns that name a unit in all ``tables``.

    Tables of a single territory may lack ``state``. Where only some lack it, a table that
    holds several territories raises, since a name alone would mix them up.
    """
    found = [c for c in UNIT_KEY if all(c in t.columns for t in tables)]
    if "state" not in found:
        for t in tables:
            if "state" in t.columns and not has_at_most(t.select("state").distinct(), 1):
                raise ValueError("units of several territories meet a table without state")
    return found


def unique_totals(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``totals`` as they are; a key with several rows raises, as it would multiply cells and money."""
    seen = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    told = F.concat(F.lit("several totals for "), F.to_json(F.struct(*keys)))
    return totals.withColumn("_n", seen).where(F.when(F.col("_n") > 1, F.raise_error(told).cast("boolean")).otherwise(True)).drop("_n")


def attach(
    facts: DataFrame,
    stats: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    bound: DataFrame | None = None,
    copies: int = 1,
) -> DataFrame:
    """Join per-key ``stats`` (unique on ``on``) onto ``facts``.

    ``bound`` is a table such as the dimension the keys come from: ``stats`` has
    at most ``copies`` rows for each of its rows. When a count proves that small,
    ``stats`` is broadcast and ``facts`` do not move, whatever their skew.
    Otherwise it is a plain equi-join, whose hot keys adaptive execution splits.
    """
    if bound is not None and fits_broadcast(stats, bound, copies):
        stats = F.broadcast(stats)
    return facts.join(stats, on, how)


def lookup_fill(
    cells: DataFrame, measures: DataFrame, on: Sequence[str] | str, columns: Sequence[str], fill: float = 0.0
) -> DataFrame:
    """Left join of measures; a cell without a measure gets ``fill``."""
    keys = [on] if isinstance(on, str) else list(on)
    joined = cells.join(measures.select(*keys, *columns), keys, "left")
    return joined.fillna(fill, subset=list(columns))


def filter_valid_cells(rows: DataFrame, cells: DataFrame, cell: str = "cell") -> DataFrame:
    return rows.join(cells.select(cell), cell, "left_semi")


def join_targets(
    cells: DataFrame, totals: DataFrame, on: Sequence[str] | str | None = None, check: bool = True, bound: DataFrame | None = None
) -> DataFrame:
    """Attach published totals; cells of units without a total are dropped.

    With ``check`` a total without any cell raises, because the pieces could
    then not add up to the published figures.
    """
    keys = [on] if isinstance(on, str) else list(on or unit_key(cells, totals))
    if check:
        absent = totals.select(*keys).distinct().join(cells.select(*keys).distinct(), keys, "left_anti")
        shown = [tuple(r) for r in absent.limit(20).collect()]
        if shown:
            more = absent.count() - len(shown)
            raise ValueError(f"totals without cells: {sorted(shown)}" + f" and {more} more" * (more > 0))
    return attach(cells, unique_totals(totals, keys), keys, "inner", bound if bound is not None else totals)


def missing_units(totals: DataFrame, cells: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Units (``unit_key``) on one side only, with the side that lacks them."""
    keys = list(on or unit_key(totals, cells))
    have, want = cells.select(*keys).distinct(), totals.select(*keys).distinct()
    return want.join(have, keys, "left_anti").withColumn("lacking", F.lit("cells")).unionByName(
        have.join(want, keys, "left_anti").withColumn("lacking", F.lit("totals"))
    )


def metro_units(metros: DataFrame, units: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Members of each metro group that are present in its territory, in the order configured."""
    listed = metros.select("*", F.posexplode("units").alias("position", "unit")).drop("units")
    keys = list(on or unit_key(listed, units))
    return listed.join(units.select(*keys).distinct(), keys, "left_semi")


def distinct_units(cells: DataFrame, on: str = "unit") -> DataFrame:
    return cells.select(on).where(F.col(on).isNotNull()).distinct()


def first_by(value: str | Column, *order: str | Column) -> Column:
    """Aggregate: ``value`` of the row that comes first in ``order``."""
    return F.min_by(value, F.struct(*order))


def last_by(value: str | Column, *order: str | Column) -> Column:
    return F.max_by(value, F.struct(*order))


def claim_once(claims: DataFrame, cell: str = "cell", unit: str = "unit") -> DataFrame:
    """A cell claimed by several units goes to the alphabetically first one."""
    return claims.groupBy(cell).agg(F.min(unit).alias(unit))


def dedupe_elements(elements: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first copy of each key in ``order``; copies alike in that are told apart by their place in the table.

    A pass over ``keys`` and ``order`` alone finds the keys that occur more than once and the
    places of all but their first copies; the wide rows are then only filtered by place, so
    that geometries never move with their copies. ``elements`` is a written table, or derived from
    one row by row, so that its rows have one place in every scan. Null keys are keys.
    """
    placed = elements.withColumn("_place", F.monotonically_increasing_id())
    narrow = placed.select(*keys, *order, "_place")
    found = narrow.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by("_place", F.struct(*order, "_place")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    later = narrow.join(found.where("_n > 1"), same).where("_place <> _first").select("_place")
    return placed.join(later, "_place", "left_anti").drop("_place")
