"""Quality rules and robust multivariate outliers per language and source, in DataFrame functions only.

Simple rules come first. Of the texts that pass them, a vector of transformed
statistics is compared with its cell (language and source) by the Mahalanobis
distance under the minimum-covariance-determinant estimate: location and scatter
of the half of the cell whose scatter is least. Concentration steps find that
half from a robust start: the half nearest to the medians, scaled by median
deviations. The estimate is then made anew from all texts that are not far by it, and
texts beyond the 0.999 point of the chi-square distribution go. Quantiles come from counts on a fine grid, so every step is a group-by
with partial sums, whatever a cell holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark.llm.bottomk import words
from dasyspark.llm.common import join_small
from dasyspark.session import materialize

STATS = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
D = len(STATS)
#: Median, 0.975 and 0.999 points of the chi-square distribution with five degrees of freedom.
CHI_MEDIAN, CHI_MOST, CHI_CUT = 4.35146, 12.83250, 20.51501
#: No statistic of a cell gets a standard deviation below this share of its spread over all rows, or below the grid of its quantiles.
POOLED_SHARE, GRAIN = 0.5, 1e-3


@dataclass(frozen=True)
class Settings:
    """share: part of a cell the estimate rests on; cut: squared distance from which a text goes;
    least: rows a cell needs, else it is judged with its language's small cells, then with all."""

    share: float = 0.5
    cut: float = CHI_CUT
    steps: int = 6
    least: int = 50


# ------------------------------------------------------------------- counts


def text_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines for ``text``; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_w", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def repeated(w: Column) -> Column:
        """Positions of words in three-word windows that occur twice or more."""
        windows = F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        ))

        def within(s: Column) -> Column:
            hit = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: (F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"]),
            )
            places = F.transform(hit, lambda i: F.get(s, i)["p"])
            return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

        return F.get(F.transform(F.array(windows), within), F.lit(0))

    return found.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "_lines": lines,
        "n_repeat_words": F.when(F.size("_w") < 4, F.lit(0)).otherwise(repeated(F.col("_w"))).cast("long"),
    }).withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_w", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistic_vector() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "x_words": F.log(n),
        "x_length": F.log(chars / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


# ---------------------------------------------------------------- estimates


def _quantile(values: DataFrame, keys: list[str], value: Column, share: float, grid: float) -> DataFrame:
    """Per key, the first grid point up to which at least ``share`` of the rows lie."""
    counted = values.groupBy(*keys, F.round(value / grid).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_v")
    whole = Window.partitionBy(*keys)
    at = counted.withColumns({"_c": F.sum("_n").over(upto), "_t": F.sum("_n").over(whole)})
    return at.where(F.col("_c") >= F.lit(share) * F.col("_t")).groupBy(*keys).agg((F.min("_v") * F.lit(grid)).alias("q"))


def _long(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    return rows.select("cell", F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), c.alias("v")) for i, c in enumerate(parts.values())
    ))).alias("s")).select("cell", "s.i", "s.v")


def _wide(stats: DataFrame, name: str) -> DataFrame:
    return stats.groupBy("cell").agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"{name}{i}") for i in range(D)))


def _centred() -> list[Column]:
    return [F.col(x) - F.col(f"m{i}") for i, x in enumerate(STATS)]


def squared_distance() -> Column:
    """Mahalanobis distance by forward substitution with the lower factor l<i>_<j> and the means m<i>."""
    z: list[Column] = []
    for i, value in enumerate(_centred()):
        for j in range(i):
            value = value - F.col(f"l{i}_{j}") * z[j]
        z.append(value / F.col(f"l{i}_{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def floors(rows: DataFrame) -> tuple[float, ...]:
    """The least standard deviation of each statistic in any cell, from the spread over all rows: one row of figures."""
    found = rows.agg(*(F.stddev_pop(x) for x in STATS)).first()
    return tuple(max(POOLED_SHARE * (x or 0.0), GRAIN) for x in found)


def _factor(moments: DataFrame, least: tuple[float, ...]) -> DataFrame:
    """Means and lower Cholesky factor of the scatter from sums over a subset; variances have a floor."""
    n = F.col("s_n").cast("double")
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(D)})
    for i in range(D):
        for j in range(i + 1):
            c = F.col(f"s{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + F.lit(least[i] ** 2)
            for k in range(j):
                c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(c) if i == j else c / F.col(f"l{j}_{j}"))
    return out.select("cell", *(f"m{i}" for i in range(D)), *(f"l{i}_{j}" for i in range(D) for j in range(i + 1)))


def _cut(rows: DataFrame, share: float) -> DataFrame:
    """Per cell the squared distance within which ``share`` of its rows lie, on a grid of its logarithm."""
    return _quantile(rows, ["cell"], F.log(F.col("d2") + F.lit(1e-9)), share, 1 / 256)


def estimates(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row per cell: means, factor and ``scale``, which brings the median squared distance to its normal value."""
    parts = {x: F.col(x) for x in STATS}
    least = floors(rows)
    middle = _wide(_quantile(_long(rows, parts), ["cell", "i"], F.col("v"), 0.5, 1e-3), "m")
    off = join_small(rows, materialize(middle, "middle"), "cell", "inner", 128)
    spread = _wide(_quantile(
        _long(off, {x: F.abs(c) for x, c in zip(STATS, _centred(), strict=True)}), ["cell", "i"], F.col("v"), 0.5, 1e-3
    ), "d")
    model = middle.join(spread, "cell")
    for i in range(D):
        for j in range(i):
            model = model.withColumn(f"l{i}_{j}", F.lit(0.0))
        model = model.withColumn(f"l{i}_{i}", F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + F.lit(least[i] ** 2)))
    model = materialize(model.drop(*(f"d{i}" for i in range(D))), "model")
    sums = [F.count("*").alias("s_n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(STATS)), *(
        F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s{i}_{j}") for i in range(D) for j in range(i + 1)
    )]
    for _ in range(settings.steps):
        far = join_small(rows, model, "cell", "inner", 256).select("cell", *STATS, squared_distance().alias("d2"))
        cut = materialize(_cut(far, settings.share), "cut")
        half = join_small(far, cut, "cell", "inner", 32).where(F.log(F.col("d2") + F.lit(1e-9)) <= F.col("q") + 1 / 512)
        model = materialize(_factor(half.groupBy("cell").agg(*sums), least), "model")
    scaled = _scaled(rows, model)
    # Half a cell says little of its tails: the final estimate takes in all that is not far by the first one.
    far = join_small(rows, scaled, "cell", "inner", 256).select("cell", *STATS, (squared_distance() / F.col("scale")).alias("d2"))
    model = materialize(_factor(far.where(F.col("d2") <= CHI_MOST).groupBy("cell").agg(*sums), least), "model")
    return _scaled(rows, model)


def _scaled(rows: DataFrame, model: DataFrame) -> DataFrame:
    far = join_small(rows, model, "cell", "inner", 256).select("cell", squared_distance().alias("d2"))
    scale = _cut(far, 0.5).select("cell", (F.exp("q") / F.lit(CHI_MEDIAN)).alias("scale"))
    # A cell tighter than the floors keeps their scale.
    return materialize(model.join(scale, "cell").withColumn("scale", F.greatest("scale", F.lit(1.0))), "estimates")


def judge(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, the counts, base_failed, distance, kept) for every row of ``docs`` (doc_id, text, lang, source).

    kept is false for texts that fail the base rules, and for those whose squared
    robust distance in their cell exceeds the cut. Null languages and sources form
    cells of their own. Cells with fewer than ``least`` passing rows are judged
    together within their language, small languages together; where even that is
    too small, texts that pass the base rules are kept, with a null distance.
    """
    settings = settings or Settings()
    counted = text_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    stats = materialize(
        counted.withColumn("base_failed", base_failed()).withColumns(statistic_vector())
        .withColumn("_row", F.monotonically_increasing_id()), "statistics",
    )
    passed = stats.where("NOT base_failed")
    exact, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    sizes = materialize(
        passed.groupBy(exact.alias("exact"), lang.alias("of")).agg(F.count("*").alias("n"))
        .withColumn("cell", F.when(F.col("n") >= settings.least, F.col("exact"))), "sizes",
    )
    rest = sizes.where("cell IS NULL").groupBy("of").agg(F.sum("n").alias("of_n"))
    cells = sizes.join(rest, "of", "left").withColumn(
        "cell", F.coalesce("cell", F.when(F.col("of_n") >= settings.least, F.col("of")), F.lit("rest"))
    )
    left = cells.where("cell = 'rest'").agg(F.sum("n")).first()[0] or 0
    if left < settings.least:
        cells = cells.where("cell <> 'rest'")
    cells = materialize(cells.select("exact", "cell"), "cells")
    rows = materialize(
        join_small(passed.withColumn("exact", exact), cells, "exact", "inner", 256).select("_row", "doc_id", "cell", *STATS),
        "vectors",
    )
    model = estimates(rows, settings)
    far = join_small(rows, model, "cell", "inner", 256).select(
        "_row", (squared_distance() / F.col("scale")).alias("distance")
    )
    return stats.join(far, "_row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= settings.cut)).alias("kept"),
    )
