"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the documents kept, with their columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark.llm import langid, packing, partenum, suffix_dedup, tokens
from dasyspark.llm import toxicity as toxic
from dasyspark.llm.common import fold, join_small, small_batches, trimmed
from dasyspark.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language; those without letters, or with hardly any likeness to all, go."""
    small_batches(spark)
    profiles = langid.fit_profiles(docs.where(fold(F.col("doc_id"), 5) != 0))
    judged = langid.identify(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c != "text"}), profiles)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0.02))
    return kept.drop("lang_pred", "score").withColumnsRenamed({f"_in_{c}": c for c in docs.columns}).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, learnt from the labels of what is left, calls toxic."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxic.fit(docs.where(fold(F.col("doc_id"), 5) != 0), labels)
    judged = toxic.score(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c != "text"}), model)
    kept = judged.where("predicted = 0")
    return kept.drop("score", "predicted").withColumnsRenamed({f"_in_{c}": c for c in docs.columns}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at a Jaccard similarity of 0.8 of five-word shingles, keep the smallest doc_id.

    Rows that repeat a doc_id leave one; rows without a doc_id stay.
    """
    small_batches(spark)
    found = partenum.jaccard_components(docs, width=5, num=80, den=100)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = join_small(docs, gone, "doc_id", "left_anti", 16)
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").limit(1).count():
        named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        return named.unionByName(kept.where("doc_id IS NULL"))
    return kept


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out all strings of 100 bytes that start earlier; a character cut in two goes, n_chars is counted anew.

    Documents stay, also those with nothing left.
    """
    small_batches(spark)
    names = {c: f"_in_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed(names)).drop("text", "spans")
    at = cut.columns.index("kept")

    def decode(batches):
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at), pa.array(texts, pa.string())],
                names=[*(n for n in batch.schema.names if n != "kept"), "text"],
            )

    schema = ", ".join([*(f"`{n}` {t}" for n, t in cut.dtypes if n != "kept"), "text string"])
    out = cut.mapInArrow(trimmed(decode), schema).withColumnsRenamed({v: k for k, v in names.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 1024 tokens: one row per piece."""
    small_batches(spark)
    import public_tokenizers

    added = tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)
    return packing.pack_documents(docs, encoder)
