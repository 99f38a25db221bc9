import hashlib
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from dasyspark.llm import bottomk as K
from dasyspark.llm.common import words_of


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingles(text, width=K.WIDTH):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words_of(text)]
    if not h:
        return set()
    out = set()
    for i in range(max(1, len(h) - width + 1)):
        seed = 42
        for x in h[i : i + width]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
        out.add(signed(seed))
    return out


def plain(text, k=K.K):
    return sorted(shingles(text))[:k]


def likeness(a, b, k=K.K):
    both = sorted({*a, *b})[:k]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


def edits(docs):
    order = sorted(docs, reverse=True)
    for i, d in enumerate(order):
        text, following = docs[d], docs[order[(i + 1) % len(order)]]
        third = len(text) // 3
        yield d, text, following, text[: len(text) - third] + following[:third]


def check(rows, docs):
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for d, text, following, edited in edits(docs):
        r = by[d]
        a, b = plain(text), plain(edited)
        assert (r.n_chars, r.edited, r.sketch, r.edited_sketch) == (len(text), edited, a, b)
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, plain(following))) < 1e-12


def test_equal_to_a_plain_version_in_one_range_and_in_many(spark, make, monkeypatch):
    rng = np.random.default_rng(0)
    docs = {int(i): r.text for i, r in zip(rng.choice(10**12, 200, replace=False) - 10**11,
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), strict=True)}
    docs |= {5: "", 6: "one", 7: "é 漢 " * 50, -(2**62): "a b c d e f", 2**62: "\n"}
    table = make(list(docs.items())).repartition(3)
    check(K.fingerprints_with_edits(table).collect(), docs)
    monkeypatch.setattr(K, "DOCS_PER_BUCKET", 7)
    monkeypatch.setattr(K, "MOST_SPLITS", 4)
    check(K.fingerprints_with_edits(table).collect(), docs)
    check(K.fingerprints_with_edits(table.where("doc_id = 5")).collect(), {5: ""})


def test_odd_rows(odd, nothing):
    docs = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    check(K.fingerprints_with_edits(odd).collect(), docs)
    assert K.fingerprints_with_edits(nothing).count() == 0


def test_merging_and_estimates(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500, 4500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(K.sketch(F.col("a")).alias("a"), K.sketch(F.col("b")).alias("b"))
    r = df.select(
        K.merge(F.col("a"), F.col("b")).alias("both"), K.resemblance(F.col("a"), F.col("b")).alias("alike"),
        K.containment(F.col("a"), F.col("b")).alias("inside"), K.distinct_shingles(F.col("a")).alias("n"), K.as_text(F.col("a")).alias("text"),
    ).first()
    assert r.both == sorted(shingles(a) | shingles(b))[: K.K]
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(r.alike - true) < 0.15 and abs(r.inside - 0.5) < 0.2 and abs(r.n / 2996 - 1) < 0.3 and len(r.text) == 16 * K.K


def test_query_columns(spark):
    from dasyspark.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op9_bottom_k"](spark, "/root/testdata/sf0.001").collect()}
    assert all(found[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() for d, _, _, e in edits(docs))
