"""Roll-ups, metric lists, packed payloads and catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions.names import slug
from dasyspark.functions.numbers import key_of, round_pack
from dasyspark.operators.joins import attach, first_by, unit_key
from dasyspark.operators.ranks import interpolated, placed, quantile_picks


def rollup_rules(columns: Sequence[str]) -> dict[str, str]:
    rules = dict(C.ROLLUP_RULES)
    rules |= {f"landuse_{c}": "mean" for c in C.LANDUSE_CLASSES} | {f"poi_{g}": "sum" for g in C.POI_GROUPS}
    return {c: how for c, how in rules.items() if c in columns}


def rollup_parents(cells: DataFrame, parent: str, order: Sequence[str] = ("district", "cell")) -> DataFrame:
    """Overview grid: every column by its own rule. A parent has few children, so its median is exact and small."""
    makers = {
        "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median,
        "first": lambda c: first_by(c, *order),
    }
    rules = rollup_rules(cells.columns)
    return cells.groupBy(parent).agg(*[makers[how](c).alias(c) for c, how in rules.items()])


def unit_table(cells: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Per unit: cells, people, published and allocated total, median per-capita; one aggregate over ranked rows."""
    by = list(by or unit_key(cells))
    value, median = "gdp_per_capita_inr", {"median_gdp_per_capita_inr": 0.5}
    narrow = cells.select(*by, "population", "y_inr", "gdp_inr", value)
    found = placed(narrow, by, value).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("population").alias("population"),
        F.max("y_inr").alias("y_inr"), F.sum("gdp_inr").alias("gdp_inr"), *quantile_picks(value, median),
    )
    medians = [c.alias(n) for n, c in interpolated(value, median).items()]
    return found.select(*by, "n_cells", "population", "y_inr", "gdp_inr", *medians)


def poi_label(group: str) -> str:
    """Display name of a POI group: its value, else its key, as words."""
    key, _, value = group.partition("_")
    return (value or key).replace("_", " ").capitalize()


def metric_columns(columns: Sequence[str]) -> list[tuple[str, str, str, str]]:
    base = [m for m in C.BASE_METRICS if m[0] in columns or m[0] in C.ALWAYS_OFFERED_METRICS]
    land = [(f"landuse_{c}", f"Landuse: {c}", "share of cell area", "Landuse") for c in C.LANDUSE_CLASSES]
    pois = [(f"poi_{g}", poi_label(g), "count", "POI class") for g in C.POI_GROUPS]
    return base + [m for m in land + pois if m[0] in columns]


def available_metrics(cells: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """Metrics whose column is non-zero often enough, in one aggregate over all columns."""
    wanted = metric_columns(cells.columns)
    shares = cells.groupBy(*by).agg(
        *[
            F.avg((F.coalesce(F.col(m[0]).cast("double"), F.lit(0.0)) != 0).cast("double")).alias(m[0])
            if m[0] in cells.columns
            else F.lit(0.0).alias(m[0])
            for m in wanted
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(m[0]).alias("metric"), F.lit(m[1]).alias("label"),
                F.lit(m[2]).alias("units"), F.lit(m[3]).alias("grouping"), F.col(m[0]).alias("share"),
            )
            for i, m in enumerate(wanted)
        ]
    )
    offered = F.col("metric").isin(*C.ALWAYS_OFFERED_METRICS) | (F.col("share") >= C.MIN_NONZERO_SHARE)
    return shares.select(*by, F.inline(entries)).where(offered)


def map_filter(cells: DataFrame, min_population: float, unit: str | None = None, metro: Sequence[str] | None = None) -> DataFrame:
    """Cells to draw: enough people, and in the unit or else in the metro group."""
    kept = cells.where(F.coalesce(F.col("population"), F.lit(0.0)) >= min_population)
    if unit:
        return kept.where(F.col("unit") == unit)
    return kept.where(F.col("unit").isin(*metro)) if metro else kept


# ------------------------------------------------------------ packed payloads


def pack_columnar(
    cells: DataFrame, payload: Sequence[str], block: str, cell: str, columns: Sequence[str], unit: str = "unit",
    constants: DataFrame | None = None, res: int | None = None,
) -> DataFrame:
    """Columnar payloads: one row per ``payload`` and ``block``, with an array per field in cell order.

    A payload is named by some columns, such as a unit or a territory; ``block``, a coarse
    ancestor cell, bounds what is gathered in one row. Of a payload of one unit
    (``unit`` is among its columns) the header holds the name as ``district``, of others
    ``d_vals``, the sorted names in the block, and ``d`` codes each cell's unit by place.
    ``constants`` (``unit_constants``: unit key, y, s) go into the map ``per_district`` once for
    each unit instead of into every cell. A field that is null or zero throughout a payload is
    null in all its blocks. Fields without decimals are integers.
    """
    keys = {c: key_of(c) for c in columns}
    single = unit in payload
    own = [k for k in dict.fromkeys([*payload, unit]) if k != block]
    fields = []
    for c, k in keys.items():
        value = round_pack(F.col(c).cast("double"), k)
        fields.append((value.cast("bigint") if C.KEY_DECIMALS.get(k) == 0 else value).alias(k))
    rows = cells.select(*own, block, F.col(cell).alias("h"), *fields)
    used = rows.groupBy(*payload).agg(*[F.max(F.coalesce(F.col(k), F.lit(0)) != 0).alias(f"_has_{k}") for k in keys.values()])
    facts = ["y", "s"] if constants is not None else []
    if constants is not None:
        rows = attach(rows, constants.select(*[k for k in own if k in constants.columns], *facts), [k for k in own if k in constants.columns], "left", constants)
    body = F.struct("h", F.col(unit).alias("u"), *facts, *keys.values())
    packed = rows.groupBy(*payload, block).agg(F.sort_array(F.collect_list(body)).alias("_rows"))
    packed = attach(packed, used, list(payload), "inner", used if constants is None else constants)

    def each(name: str) -> Column:
        return F.transform("_rows", lambda r: r[name])

    header = [F.lit(res).cast("int").alias("res")] if res is not None else []
    header.append(F.size("_rows").alias("n"))
    names = F.array_sort(F.array_distinct(each("u")))
    if single:
        header.append(F.col(unit).alias("district"))
    else:
        packed = packed.withColumn("_names", names)
        header += [F.col("_names").alias("d_vals"), F.transform("_rows", lambda r: (F.array_position("_names", r["u"]) - 1).cast("int")).alias("d")]
    if facts:
        entry = F.transform("_rows", lambda r: F.struct(r["u"].alias("u"), F.struct(r["y"].alias("y"), r["s"].alias("s")).alias("v")))
        header.append(F.map_from_entries(F.array_distinct(F.filter(entry, lambda e: e["u"].isNotNull()))).alias("per_district"))
    return packed.select(*payload, block, *header, each("h").alias("h"), *[F.when(F.col(f"_has_{k}"), each(k)).alias(k) for k in keys.values()])


_HEADER = ("res", "n", "district", "d_vals", "per_district")


def payload_json(packed: DataFrame, payload: Sequence[str], block: str = "block") -> DataFrame:
    """Packed rows as compact JSON: the header, and the arrays under ``cols``; absent fields are left out."""
    head = [c for c in _HEADER if c in packed.columns]
    cols = [c for c in packed.columns if c not in (*payload, block, *_HEADER)]
    body = F.struct(*head, F.lit(True).alias("columnar"), F.struct(*cols).alias("cols"))
    return packed.select(*payload, block, F.to_json(body).alias("payload"))


def unpack_columnar(packed: DataFrame, payload: Sequence[str], block: str = "block") -> DataFrame:
    """The cells of packed rows: ``payload, block, h, unit``, the fields, and the unit's constants on each cell.

    A field that was left out is null.
    """
    cols = [c for c in packed.columns if c not in (*payload, block, *_HEADER, "h", "d")]
    types = {c: packed.schema[c].dataType.elementType.simpleString() for c in cols}
    filled = [F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast(types[c]), F.col("n"))).alias(c) for c in cols]
    if "d_vals" in packed.columns:
        name = F.transform("d", lambda i: F.get("d_vals", i)).alias("unit")
    else:
        name = F.array_repeat("district", F.col("n")).alias("unit")
    kept = [k for k in payload if k != "unit"]
    facts = ["per_district"] if "per_district" in packed.columns else []
    rows = packed.select(*kept, block, *facts, F.arrays_zip("h", name, *filled).alias("_z"))
    rows = rows.select(*kept, block, *facts, F.inline("_z").alias("h", "unit", *cols))
    if facts:
        own = F.try_element_at("per_district", F.col("unit"))
        rows = rows.withColumns({"y": own["y"], "s": own["s"]}).drop("per_district")
    return rows


def unit_constants(cells: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Fields constant within a unit, hoisted out of its cells."""
    return cells.groupBy(*(by or unit_key(cells))).agg(
        round_pack(F.max("y_crore"), "y").alias("y"), round_pack(F.max("dasymetric_scale"), "s").alias("s")
    )


def unit_files(units: DataFrame, unit: str = "unit") -> DataFrame:
    return units.withColumn("unit_slug", slug(F.col(unit))).withColumn("file", F.concat(F.lit("r7/"), "unit_slug", F.lit(".json")))


# ------------------------------------------------------------------ catalogues


def run_manifest(
    cells: DataFrame, by: Sequence[str] = ("state",), sources: DataFrame | None = None, evaluation: DataFrame | None = None
) -> DataFrame:
    """What a run made of each territory, as columns and as one JSON line ``manifest``.

    Counts, totals, the reconstruction error, mean per-capita and whether lights were used;
    ``sources`` (``by``, then facts such as year and price basis) joins the provenance,
    ``evaluation`` (``by``, section, item, value) the report, as a map of maps.
    """
    by = list(by)
    errors = cells.groupBy(*by, "unit").agg(F.sum("gdp_inr").alias("a"), F.max("y_inr").alias("y"))
    per_unit = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("y").alias("total_y_inr"),
        F.max(F.abs(F.col("a") - F.col("y")) / F.col("y")).alias("max_abs_rel_recon_error"),
    )
    sums = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("population").alias("total_population"),
        F.count_if(F.col("population") > 0).alias("n_inhabited"), F.sum("gdp_inr").alias("allocated_inr"),
        F.avg("gdp_per_capita_inr").alias("mean_gdp_per_capita_inr"),
        (F.coalesce(F.sum("night_lights"), F.lit(0.0)) > 0).alias("night_lights_used"),
    )
    joined = sums.join(per_unit, by)
    if sources is not None:
        facts = [F.col(c) for c in sources.columns if c not in by]
        joined = joined.join(sources.select(*by, F.struct(*facts).alias("source")), by, "left")
    if evaluation is not None:
        told = evaluation.groupBy(*by, "section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", "value")))).alias("_items"))
        told = told.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("_items").alias("j"))))).alias("_m"))
        joined = joined.join(told.withColumnRenamed("_m", "evaluation"), by, "left")
    names = [c for c in joined.columns if c not in by]
    return joined.withColumn("manifest", F.to_json(F.struct(*names)))


def state_summary(
    cells: DataFrame, metros: DataFrame, by: str = "state", parent: str | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """Everything a viewer needs to know of a territory before any cell is loaded: one row each.

    Counts of cells and parents, people, sorted units with their files, the table of units (largest total
    first), the metro groups that are present, the metrics on offer, whether there are lights,
    and the facts of ``sources``. Cells are only aggregated; what is listed are units and metrics.
    """
    per_unit = unit_table(cells, [by, "unit"])
    row = F.struct(
        (-F.coalesce("y_inr", F.lit(0.0))).alias("_k"), F.col("unit"), F.col("n_cells"), F.col("population"), F.col("y_inr"), F.col("gdp_inr"),
        F.col("median_gdp_per_capita_inr"),
    )
    base = per_unit.groupBy(by).agg(
        F.sum("n_cells").alias("n_cells"), F.sum("population").alias("population"),
        F.sort_array(F.collect_list("unit")).alias("units"), F.sort_array(F.collect_list(row)).alias("_table"),
    )
    base = base.withColumn("unit_table", F.transform("_table", lambda r: r.dropFields("_k"))).drop("_table")
    file = F.transform("units", lambda u: F.concat(F.lit("r7/"), slug(u), F.lit(".json")))
    base = base.withColumn("unit_files", F.map_from_arrays("units", file))
    facts = [(F.coalesce(F.sum("night_lights"), F.lit(0.0)) > 0).alias("night_lights_used")]
    facts += [F.count_distinct(parent).alias("n_parents")] if parent else []
    offered = available_metrics(cells, (by,)).groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("position", "metric", "label", "units", "grouping"))).alias("metrics")
    )
    joined = metros.join(base.select(by, F.col("units").alias("_have")), by)
    present = joined.withColumn("members", F.array_intersect("units", "_have")).where(F.size("members") > 0)
    groups = present.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("metro", "members"))).alias("metros"))
    out = base.join(cells.groupBy(by).agg(*facts), by).join(offered, by, "left").join(groups, by, "left")
    return out if sources is None else out.join(sources, by, "left")


def build_catalog(rebuilt: DataFrame, previous: DataFrame, code: str = "state") -> DataFrame:
    """Fresh summaries plus the earlier ones of territories that were not rebuilt, in order of their codes."""
    kept = previous.join(rebuilt.select(code).distinct(), code, "left_anti")
    return rebuilt.unionByName(kept, allowMissingColumns=True).orderBy(code)


def catalog_metrics(summaries: DataFrame, code: str = "state") -> DataFrame:
    """Each metric that any summary offers, once, as its first territory defines it: ``place, metric, label, units, grouping``."""
    rows = summaries.select(F.col(code).alias("state"), F.inline("metrics"))
    first = metric_union(rows, ("state", "position"))
    return first.withColumn("place", F.struct("state", "position")).select("place", "metric", "label", "units", "grouping")


def metric_union(metrics: DataFrame, order: Sequence[str] = ("state", "position"), key: str = "metric") -> DataFrame:
    """Each metric once, as first defined."""
    rest = [c for c in metrics.columns if c != key]
    return metrics.groupBy(key).agg(first_by(F.struct(*rest), *order).alias("_m")).select(key, "_m.*")
