"""Exact ranks and quantiles over whole territories, attached to the rows in place.

Rows are sorted within (territory, range of values). Ranges follow the data: a quantile
sketch cuts all values into runs of about ROWS_PER_RANGE rows, and the rows of the ranges
before come from one small prefix sum. A value that fills a whole range by itself, such as
one that a third of all rows share, needs no sorting: its rows are spread over many tasks
and take their rank from the prefix sum alone, and so do nulls, which have no rank. Nothing
is written and ranks are not joined back by value. Where all rows make one range, only the
sort remains, and columns ranked one after the other share its shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark.session import ROW_BYTES, BROADCAST_BYTES, has_at_most

# Rows that one task sorts; the number of ranges follows the data.
ROWS_PER_RANGE = 1_000_000
SPREAD = 256
PLACES = ("n_below", "n_eq", "n_all")


def placed(df: DataFrame, by: Sequence[str], value: str, rows: int | None = None, names: Sequence[str] = PLACES) -> DataFrame:
    """``df`` with, for each row of a territory, how many values lie below its own, how many equal it, and how many there are.

    Nulls count nowhere and get nulls. ``rows`` saves counting ``df``, which is read again
    where it makes several ranges; hand in a written table.
    """
    below, equal, whole = names
    rows = df.count() if rows is None else rows
    keyed = df.drop(*names).withColumn("_v", F.col(value).cast("double"))
    if rows <= ROWS_PER_RANGE:
        keys = [*by]
        hot = F.lit(False)
    else:
        keyed, hot = _with_range(keyed, rows)
        keys = [*by, "_range", "_spread"]
    line = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    known = F.col("_v").isNotNull()
    upto = F.count("_v").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    lower = (F.rank().over(line) - 1).cast("long")
    if len(keys) == len(by):
        ranked = keyed.withColumns({below: lower, equal: upto, whole: F.count("_v").over(Window.partitionBy(*keys))})
        ranked = ranked.withColumns({below: F.when(known, F.col(below)), equal: F.when(known, F.col(equal) - F.col(below)), whole: F.when(known, F.col(whole))})
        return ranked.drop("_v")
    sizes = keyed.where(known).groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*by).orderBy("_range")
    before = F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*by, "_range", "_n", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias(whole))
    if has_at_most(offsets, BROADCAST_BYTES // (4 * ROW_BYTES)):
        offsets = F.broadcast(offsets)
    ranked = keyed.withColumns({below: lower, equal: upto})
    met = ranked.join(offsets, [*by, "_range"], "left").withColumns({
        below: F.when(known, F.col("_before") + F.when(hot, 0).otherwise(F.col(below))),
        equal: F.when(known, F.when(hot, F.col("_n")).otherwise(F.col(equal) - F.col(below))),
    })
    return met.drop("_v", "_range", "_spread", "_n", "_before")


def _with_range(keyed: DataFrame, rows: int) -> tuple[DataFrame, Column]:
    """``_range`` and ``_spread`` of each row, and whether its value has a range of its own."""
    ranges = rows // ROWS_PER_RANGE + 1
    cuts = keyed.where(F.col("_v").isNotNull()).approxQuantile("_v", [k / ranges for k in range(1, ranges)], 0.25 / ranges)
    times = Counter(cuts)
    bounds = sorted(times)
    hot = F.col("_v").isin([c for c in bounds if times[c] > 1])
    # Bucket k holds values from the cut before on; a hot one comes first in its bucket.
    splits = [-math.inf, *bounds, math.inf]
    sure = keyed.withColumn("_sure", F.coalesce("_v", F.lit(-math.inf)))
    bucket = Bucketizer(splits=splits, inputCol="_sure", outputCol="_bucket").transform(sure)
    number = F.when(F.col("_v").isNotNull(), (F.col("_bucket") * 2 + F.when(hot, 0).otherwise(1)).cast("long"))
    apart = F.when(F.col("_v").isNull() | hot, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    return bucket.withColumns({"_range": number, "_spread": apart}).drop("_sure", "_bucket"), hot


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, value, n_eq, n_below, n_all`` for each distinct non-null value."""
    known = placed(df.select(*by, F.col(value).cast("double").alias(value)), by, value).where(F.col(value).isNotNull())
    return known.select(*by, value, "n_eq", "n_below", "n_all").distinct()


def average_rank(n_below: str = "n_below", n_eq: str = "n_eq") -> Column:
    return F.col(n_below) + (F.col(n_eq) + 1) / 2.0


def with_rank(df: DataFrame, by: Sequence[str], value: str, out: str, rank: Column) -> DataFrame:
    """Add ``rank``, an expression over the places of ``value`` (``placed``), to each row."""
    return placed(df, by, value).withColumn(out, rank).drop(*PLACES)


def wealth_index(cells: DataFrame, by: Sequence[str] = ("state",), value: str = "gdp_per_capita_inr") -> DataFrame:
    """Average-method percentile rank among inhabited cells; the others get 0."""
    inhabited = cells.withColumn("_live", F.when(F.col("population") > 0, F.col(value)))
    percentile = average_rank() / F.col("n_all") * 100
    ranked = with_rank(inhabited, by, "_live", "wealth_index", percentile)
    return ranked.withColumn(
        "wealth_index", F.when(F.col("population") > 0, F.col("wealth_index")).otherwise(F.lit(0.0))
    ).drop("_live")


def cume_percentile(cells: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of rows at or below, x100; a null ranks 0."""
    share = (F.col("n_below") + F.col("n_eq")) / F.col("n_all") * 100
    return with_rank(cells, by, value, out, share).fillna(0.0, subset=[out])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``probs``."""
    return quantiles_of(placed(df.select(*by, value), by, value), by, value, probs)


def order_statistic(value: str, at: Column, below: str = "n_below") -> Column:
    """Aggregate over placed rows: the value at place ``at`` (from 0) of the sorted values."""
    return F.max(F.when(F.col(below) <= at, F.col(value).cast("double")))


def quantile_picks(value: str, probs: Mapping[str, float], names: Sequence[str] = PLACES) -> list[Column]:
    """Aggregates over placed rows from which ``interpolated`` makes the quantiles."""
    picks = [F.max(names[2]).alias(f"_n_{value}")]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col(names[2]) - 1)
        picks.append(order_statistic(value, F.floor(at), names[0]).alias(f"_lo_{name}"))
        picks.append(order_statistic(value, F.ceil(at), names[0]).alias(f"_hi_{name}"))
    return picks


def interpolated(value: str, probs: Mapping[str, float]) -> dict[str, Column]:
    columns = {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col(f"_n_{value}") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns[name] = lo + (hi - lo) * (at - F.floor(at))
    return columns


def quantiles_of(ranks: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from placed rows; territories without a value have none."""
    found = ranks.where(F.col(value).isNotNull()).groupBy(*by).agg(*quantile_picks(value, probs))
    return found.select(*by, *[c.alias(n) for n, c in interpolated(value, probs).items()])


def quantile_cuts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Colour cuts: order statistics at fixed shares, forced to increase."""
    shares = (0.02, 0.3, 0.6, 0.85, 0.99)
    picks = [order_statistic(value, F.floor(F.lit(t) * (F.col("n_all") - 1))).alias(f"_q{i}") for i, t in enumerate(shares)]
    known = placed(df.select(*by, value), by, value).where(F.col(value).isNotNull())
    found = known.groupBy(*by).agg(*picks)
    cuts: list[Column] = []
    for i in range(len(shares)):
        raw = F.col(f"_q{i}")
        cuts.append(raw if not cuts else F.when(raw <= cuts[-1], cuts[-1] + F.lit(1e-9)).otherwise(raw))
    return found.select(*by, *[c.alias(f"cut_{i + 1}") for i, c in enumerate(cuts)])


def spearman(df: DataFrame, by: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rank correlation per pair over rows where both values are known; null if undefined.

    All ranks of a row are attached first, those of a column without gaps once for all its
    pairs; one aggregate then makes all correlations.
    """
    columns = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    facts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    masked: dict[str, Column] = {}

    def masked_name(column: str, other: str) -> str:
        """The column that holds ``column`` where ``other`` is known."""
        name = f"_{columns.index(column)}" + (f"_{columns.index(other)}" if facts[other] else "")
        masked[name] = F.when(F.col(other).isNotNull(), F.col(column)) if facts[other] else F.col(column)
        return name

    sides = {pair: (masked_name(a, b), masked_name(b, a)) for pair, (a, b) in pairs.items()}
    rows = df.select(*by, *[c.cast("double").alias(n) for n, c in masked.items()])
    for name in masked:
        rows = placed(rows, by, name, facts["_rows"])
        # The mean of average ranks is known beforehand.
        rows = rows.withColumn(name, average_rank() - (F.col("n_all") + 1) / 2.0).drop(*PLACES)
    sums = []
    for pair, (a, b) in sides.items():
        x, y = F.col(a), F.col(b)
        whole = x.isNotNull() & y.isNotNull()
        sums += [F.sum(F.when(whole, v)).alias(f"{pair}:{n}") for n, v in (("xx", x * x), ("yy", y * y), ("xy", x * y))]
    found = rows.groupBy(*by).agg(*sums)

    def rho(pair: str) -> Column:
        xx, yy, xy = (F.col(f"`{pair}:{n}`") for n in ("xx", "yy", "xy"))
        return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx) / F.sqrt(yy))

    told = F.array(*[F.struct(F.lit(p).alias("pair"), rho(p).alias("rho")) for p in pairs])
    return found.select(F.inline(told), *by).select("pair", *by, "rho")
