"""Readers of fine grids, pixel tables and mapped elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.operators.evidence import Bbox, has_any_key

ELEMENT_SCHEMA = (
    "type string, id bigint, lat double, lon double, tags map<string, string>, "
    "geometry array<struct<lat: double, lon: double>>"
)


def resolve_aliased_columns(
    df: DataFrame, ids: Sequence[str] = C.CELL_ID_ALIASES, values: Sequence[str] = C.POPULATION_ALIASES
) -> DataFrame:
    """Select the id and value columns under any of their names, as ``h3, population``."""
    by_lower = {c.lower(): c for c in df.columns}
    chosen = []
    for names in (ids, values):
        hit = next((by_lower[n] for n in names if n in by_lower), None)
        if hit is None:
            raise ValueError(f"none of {list(names)} among {df.columns}")
        chosen.append(hit)
    return df.select(F.col(chosen[0]).alias("h3"), F.col(chosen[1]).alias("population"))


def scan_lights_projection(
    spark: SparkSession, path: str, value: str = "nightlight_mean", fallback: str = "nightlight_mean"
) -> DataFrame:
    """Only the id, value and (if present) weight columns of a lights grid."""
    grid = spark.read.parquet(path)
    column = value if value in grid.columns else fallback
    weight = [F.col("pixel_count")] if "pixel_count" in grid.columns else []
    return grid.select(F.col("h3_index").alias("h3"), F.col(column).alias("night_lights"), *weight)


def scan_osm_tiles(spark: SparkSession, path: str, one_document_per_line: bool = False) -> DataFrame:
    """Elements of all tile documents, with tile name and position for de-duplication."""
    reader = spark.read.schema(f"elements array<struct<{_as_struct(ELEMENT_SCHEMA)}>>")
    documents = reader.option("multiLine", not one_document_per_line).json(path)
    named = documents.select(F.col("_metadata.file_name").alias("tile"), "elements")
    return named.select("tile", F.posexplode("elements").alias("position", "e")).select("tile", "position", "e.*")


def _as_struct(ddl: str) -> str:
    fields, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            fields.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(fields)


def scan_osm_elements(elements: DataFrame) -> DataFrame:
    """Nodes and ways that carry any of the wanted keys."""
    return elements.where(F.col("type").isin("node", "way") & has_any_key(F.col("tags")))


def scan_pixels(
    pixels: DataFrame, transform: tuple[float, float, float, float, float, float], bbox: Bbox, nodata: float | None = None
) -> DataFrame:
    """Valid pixels of a band within a box: ``x, y, value`` at pixel centres.

    ``pixels``: row, col, value. The box also bounds row and column by whole
    pixels, which the parquet scan can use to skip row groups.
    """
    a, b, c, d, e, f = transform
    minx, miny, maxx, maxy = bbox
    window = pixels
    if b == 0 and d == 0:
        cols = sorted(((minx - c) / a, (maxx - c) / a))
        rows = sorted(((miny - f) / e, (maxy - f) / e))
        window = window.where(
            (F.col("col") >= int(cols[0]) - 1) & (F.col("col") <= int(cols[1]) + 1)
            & (F.col("row") >= int(rows[0]) - 1) & (F.col("row") <= int(rows[1]) + 1)
        )
    value = F.col("value")
    valid = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    if nodata is not None:
        valid = valid & (value != F.lit(nodata))
    u, v = F.col("col") + F.lit(0.5), F.col("row") + F.lit(0.5)
    placed = window.where(valid).select(
        (F.lit(c) + u * F.lit(a) + v * F.lit(b)).alias("x"), (F.lit(f) + u * F.lit(d) + v * F.lit(e)).alias("y"), "value"
    )
    return placed.where(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))


def assert_coverage(points: DataFrame, bbox: Bbox, label: str = "source") -> DataFrame:
    """The extent of a source (``x, y``), or an error if it lies apart from the box."""
    found = points.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    minx, miny, maxx, maxy = bbox
    apart = (F.col("maxx") < minx) | (F.col("minx") > maxx) | (F.col("maxy") < miny) | (F.col("miny") > maxy)
    message = F.lit(f"{label} does not cover {bbox}")
    return found.withColumn("covered", F.when(apart | F.col("minx").isNull(), F.raise_error(message)).otherwise(F.lit(True)))


def assert_any_lit(cells: DataFrame) -> None:
    if cells.where(F.col("night_lights") > 0).limit(1).count() == 0:
        raise ValueError("no night-light value landed on any cell")
