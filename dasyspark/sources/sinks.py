"""Writers of the cell table and of the packed payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions.names import slug
from dasyspark.functions.numbers import select_by_pattern


def export_columns(columns: Sequence[str]) -> list[str]:
    """Fixed columns first, then the feature families that are present."""
    fixed = [c for c in C.EXPORT_COLUMNS if c in columns]
    extra = select_by_pattern(columns, ("poi_", "landuse_"), ("_exists", "_log", "_z"))
    return fixed + [c for c in extra if c not in fixed]


def sort_export(cells: DataFrame, *order: str) -> DataFrame:
    """Globally ordered by range partitioning, not through one task."""
    return cells.orderBy(*order)


def sink_cells(cells: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], partition: str | None = None) -> None:
    """Ordered parquet; with ``partition`` one folder per value, hot values spread over tasks by cell."""
    table = cells.select(*columns)
    writer = sort_export(table, *order).write.mode("overwrite")
    if partition:
        writer = table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(partition)
    writer.parquet(path)


def sink_gzip_csv(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def sink_by_unit(payloads: DataFrame, path: str, unit: str = "unit") -> None:
    """Packed payloads, one folder per unit under its slug."""
    payloads.withColumn("unit_slug", slug(F.col(unit))).write.mode("overwrite").partitionBy("unit_slug").json(path)
