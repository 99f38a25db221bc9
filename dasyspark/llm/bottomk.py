"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct hashes of a text's word
shingles. Sketches of parts merge into the sketch of the whole, and two of them
estimate resemblance, containment and the numbers of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark.session import materialize

K, WIDTH = 128, 5
DOCS_PER_BUCKET, MOST_BUCKETS, MOST_SPLITS = 2_000, 500_000, 256


def words(text: Column) -> Column:
    """Runs of anything but space and the controls \\t to \\r; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def sketch_of_words(found: Column, k: int = K, width: int = WIDTH) -> Column:
    """Sketch of an array of words; fewer words than ``width`` make one shingle, none an empty sketch."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
            F.size(h) < width, F.array(F.xxhash64(h))
        ).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width)))
            )
        )

    # A one-element transform binds the hashed words once.
    made = F.flatten(F.transform(F.array(hashed), shingles))
    return F.slice(F.sort_array(F.array_distinct(made)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return sketch_of_words(words(text), k, width)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the part of the merged sketch that is in both; two empty sets are alike."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the k-th smallest of hashes spread over 64 bits."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has too; an empty a is contained in anything."""
    alike = resemblance(a, b, k)
    common = alike * distinct_shingles(merge(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / own))


def as_text(a: Column) -> Column:
    """The sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


# ------------------------------------------------------------ neighbouring rows


def with_next_text(docs: DataFrame, extra: dict[str, Column], lead: list[str]) -> DataFrame:
    """Add ``next_<c>`` for the columns ``lead``: their values in the row of the next smaller doc_id.

    The row of the smallest id gets the largest id's. ``extra`` adds columns before.
    ``docs`` has a unique, non-null doc_id.

    Ids are cut into ranges of about equal counts (quantiles, then equal widths).
    Each row moves once, to its range; the first row of the next range comes along
    as a guest, and a window over a range gives each row its neighbour. The guest
    list has one row a range and at most MOST_BUCKETS of them, so it is broadcast.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = ids.count()
    if not n:
        empty = docs.withColumns(extra)
        return empty.withColumns({f"next_{c}": F.col(c) for c in lead})
    buckets = min(MOST_BUCKETS, max(1, -(-n // DOCS_PER_BUCKET)))
    parts = min(MOST_SPLITS, buckets)
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    edges = [low, *sorted({int(c) for c in cuts if low < c <= high}), min(high + 1, 2**63 - 1)]
    fine = -(-buckets // (len(edges) - 1))
    lows, highs = (F.array(*(F.lit(e).cast("long") for e in x)) for x in (edges[:-1], edges[1:]))
    at = F.size(F.filter(lows, lambda e: e <= F.col("doc_id"))) - 1
    start, end = F.get(lows, at), F.get(highs, at)
    begin = start.cast("double")
    share = (F.col("doc_id").cast("double") - begin) / F.greatest(end.cast("double") - begin, F.lit(1.0))
    bucket = at * fine + F.least(F.lit(fine - 1), F.floor(share * fine)).cast("int")

    # The largest id of each range visits the range above; the largest of all visits the lowest range.
    tops = materialize(ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("doc_id")), "ranges")
    above = tops.select("doc_id", F.lead("bucket").over(Window.orderBy("bucket")).alias("host"))
    first = tops.agg(F.min("bucket")).first()[0]
    guests = materialize(above.withColumn("wraps", F.col("host").isNull()).fillna(first, ["host"]), "guests")
    placed = (
        docs.withColumn("bucket", bucket).join(F.broadcast(guests), "doc_id", "left")
        .withColumn("seat", F.explode(F.when(
            F.col("host").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")))
        ).otherwise(F.array(
            F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")),
            F.struct(F.col("host").alias("b"), F.when(F.col("wraps"), 2).otherwise(1).alias("guest")),
        ))))
        .drop("bucket", "host", "wraps").select("*", "seat.b", "seat.guest").drop("seat")
    )
    spread = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    moved = placed.repartition(spread, "b").withColumns(extra)
    # Within a range: own rows by falling id, then the guest, whether it comes from below or wraps around.
    order = Window.partitionBy("b").orderBy(F.col("guest").asc(), F.col("doc_id").desc())
    return (
        moved.withColumns({f"next_{c}": F.lead(c).over(order) for c in lead}).where("guest = 0").drop("b", "guest")
    )


def fingerprints_with_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every text and of its edited form, with their likeness.

    The edited text has its last third (code points, rounded down) replaced by as
    many first ones of the next document by falling doc_id, or by all it has; the
    last document takes from the first. A null text is empty. Rows that repeat a
    doc_id count as one document, the one of the smallest text, and give one row;
    rows without a doc_id are left out.
    """
    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        named = materialize(named.groupBy("doc_id").agg(F.min("text").alias("text")), "unique")
    near = with_next_text(named, {"sketch": sketch(F.col("text"), k, width)}, ["text", "sketch"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third)
    )
    made = near.withColumn("edited", edited).drop("next_text").withColumn("edited_sketch", sketch(F.col("edited"), k, width))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
