"""Readers of published totals and administrative features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions.numbers import parse_inr_number

FEATURE_SCHEMA = (
    "type string, features array<struct<type: string, properties: map<string, string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)
RING = "array<array<double>>"


def _given(col: Column) -> Column:
    return F.when(col != "", col)


def scan_geojson_features(spark: SparkSession, path: str, one_document_per_line: bool = False) -> DataFrame:
    """One row per feature of FeatureCollection documents: name, properties, geometry, polygons.

    ``geometry`` has the type and, of a Polygon, its rings. ``polygons`` has the rings
    of every polygon of a Polygon or MultiPolygon; other types have none.
    """
    reader = spark.read.schema(FEATURE_SCHEMA).option("multiLine", not one_document_per_line)
    features = reader.json(path).select(F.inline("features"))
    properties = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    name = F.coalesce(*[_given(properties[k]) for k in C.FEATURE_NAME_KEYS], F.lit(""))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    single = F.from_json(F.when(kind == "Polygon", text), f"array<{RING}>")
    several = F.from_json(F.when(kind == "MultiPolygon", text), f"array<array<{RING}>>")
    return features.select(
        name.alias("name"), properties.alias("properties"),
        F.when(F.col("geometry").isNotNull(), F.struct(kind.alias("type"), single.alias("coordinates"))).alias("geometry"),
        F.coalesce(F.when(single.isNotNull(), F.array(single)), several, F.array().cast(f"array<array<{RING}>>")).alias("polygons"),
    )


def feature_rings(features: DataFrame, unit: str | Column = "name", source: str | Column | None = None) -> DataFrame:
    """``unit, part, ring`` of scanned features: a part for every polygon, a row for every ring.

    ``source`` sets parts of equally named features apart (by default a hash of the
    polygons). Positions are longitude and latitude, further numbers are ignored.
    """
    named = F.col(unit) if isinstance(unit, str) else unit
    own = F.xxhash64(F.to_json("polygons")).cast("string") if source is None else F.col(source).cast("string") if isinstance(source, str) else source
    parts = features.select(named.alias("unit"), own.alias("_s"), F.posexplode("polygons").alias("_p", "_rings"))
    rings = parts.select("unit", F.concat_ws("/", "_s", F.col("_p").cast("string")).alias("part"), F.explode("_rings").alias("_r"))
    ring = F.transform("_r", lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))
    return rings.select("unit", "part", ring.alias("ring"))


def is_skipped(name: Column, tokens: Sequence[str] = C.SKIP_TOKENS) -> Column:
    """Whether any token occurs in the lower-cased name."""
    escaped = [t.replace(".", r"\.") for t in tokens]
    return F.lower(name).rlike("|".join(escaped))


def scan_ckan_records(
    spark: SparkSession, path: str, name_field: str, value_field: str,
    fields: Sequence[str] = (), tokens: Sequence[str] = C.SKIP_TOKENS, one_document_per_line: bool = False,
) -> DataFrame:
    """Totals from ``result.records`` or ``records``; further ``fields`` are kept as text."""
    record = "map<string, string>"
    reader = spark.read.schema(f"result struct<records: array<{record}>>, records array<{record}>")
    documents = reader.option("multiLine", not one_document_per_line).json(path)
    rows = documents.select(F.explode(F.coalesce("result.records", "records")).alias("r"))
    r = F.col("r")
    name = F.coalesce(_given(r[name_field]), _given(r["District"]), _given(r["district"]))
    kept = rows.select(
        name.alias("source_name"), r[value_field].alias("_value"), *[r[f].alias(f) for f in fields]
    ).where(F.col("source_name").isNotNull() & F.col("_value").isNotNull())
    kept = kept.where(~is_skipped(F.col("source_name"), tokens))
    return kept.withColumn("y_crore", parse_inr_number(F.col("_value"))).drop("_value")


def scan_dropin_csv(spark: SparkSession, path: str) -> DataFrame:
    """``district, y_crore`` by name, else the first two columns."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    name = "district" if "district" in raw.columns else raw.columns[0]
    value = "y_crore" if "y_crore" in raw.columns else raw.columns[1]
    return raw.select(
        F.col(f"`{name}`").alias("source_name"), parse_inr_number(F.col(f"`{value}`")).alias("y_crore")
    )


def scan_parsed_records(spark: SparkSession, path: str, one_document_per_line: bool = False) -> DataFrame:
    """Totals from ``records`` with a ``district`` or ``District`` field."""
    schema = "records array<map<string, string>>"
    reader = spark.read.schema(schema).option("multiLine", not one_document_per_line)
    rows = reader.json(path).select(F.explode("records").alias("r"))
    r = F.col("r")
    district = F.coalesce(_given(r["district"]), r["District"])
    return rows.select(
        district.alias("district"),
        F.coalesce(_given(r["source_name"]), r["district"]).alias("source_name"),
        parse_inr_number(r["y_crore"]).alias("y_crore"),
    )
