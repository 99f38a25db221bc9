"""Published totals: cleaning, precedence and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.operators.joins import first_by, unit_key


def filter_positive_targets(rows: DataFrame, value: str = "y_crore") -> DataFrame:
    return rows.where(F.col(value) > 0)


def agg_targets(rows: DataFrame, order: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """One total per canonical unit: merged names add up, the first source name stays."""
    return (
        filter_positive_targets(rows)
        .groupBy(*(by or unit_key(rows)))
        .agg(F.sum("y_crore").alias("y_crore"), first_by("source_name", *order).alias("source_name"))
        .withColumn("y_inr", F.col("y_crore") * F.lit(C.INR_PER_CRORE))
    )


def resolve_sources(sources: Sequence[DataFrame], by: str = "state") -> DataFrame:
    """Union of sources given best first; each territory keeps only its best one."""
    tagged = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    best = rows.groupBy(by).agg(F.min("priority").alias("priority"))
    return rows.join(best, [by, "priority"], "left_semi")


def concat_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; a column one of them lacks is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# The first condition that holds names the state of supply. Tables of a direct kind are read as they come.
_DIRECT = ("ckan_json", "opencity_csv", "gsdp_single")
_STATES = (
    ("no_source", "kind IS NULL"),
    ("needs_csv", "kind = 'local_csv' AND NOT has_csv"),
    ("ready", "has_csv OR has_parsed"),
    ("switched_off", "skip_reason IS NOT NULL"),
    ("needs_parsing", "kind = 'pdf' AND has_pdf"),
    ("needs_document", "kind = 'pdf'"),
    ("ready", f"has_json OR kind IN {_DIRECT}"),
)
_FLAGS = ("has_csv", "has_json", "has_parsed", "has_pdf")


def coverage_status(settings: DataFrame, present: DataFrame) -> DataFrame:
    """How far each territory is supplied: ``status``, a code of ``_STATES`` or ``needs_fetch``, and ``usable``.

    ``settings``: code, kind, skip_reason. ``present``: code and the booleans ``_FLAGS``; a
    territory without a row has none. A table put there by hand or parsed records override
    a reason to skip.
    """
    seen = settings.join(present, "code", "left").fillna(False, subset=list(_FLAGS))
    ways = [F.when(F.expr(condition), code) for code, condition in _STATES]
    status = F.coalesce(*ways, F.lit("needs_fetch"))
    return seen.withColumn("status", status).withColumn("usable", F.col("status").isin("ready", "needs_fetch"))
