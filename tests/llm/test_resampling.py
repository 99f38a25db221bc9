import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dasyspark.llm import resampling as R
from dasyspark.llm.common import LOWER_AZ


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER_AZ))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(g.encode()) % 10_000 for g in grams]


def plain(rows, target, percent=5):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)]
    out, pool = {}, []
    for key, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[key] = [len(words), len(found), weight, score, None]
        if len(words) >= 20:
            pool.append((-score, key is None, key or 0, key))
    for rank, row in enumerate(sorted(pool)[: percent * len(pool) // 100], 1):
        out[row[3]][4] = rank
    return out


def test_buckets_match_crc_of_each_feature():
    long = "x" * 70 + " " + "é" * 500 + " " + "yz" * 4000
    texts = ["One two THREE four", "", None, "é漢 ÀB-c 12x", long + " end", "a", "w" * 63 + " " + "w" * 64 + " " + "w" * 65]
    sizes, owner, bucket = R.buckets_of([None if t is None else t.encode() for t in texts])
    for i, text in enumerate(texts):
        words, found = features(text)
        assert sizes[i] == len(words)
        assert Counter(bucket[owner == i].tolist()) == Counter(found)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"{rng.choice(['w', 'É', 'Ab', 'z9'])}{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)]
    return rows, [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)]


def test_resample_matches_plain(make, spark, corpus):
    rows, target = corpus
    got = R.resample(make(rows), spark.createDataFrame([(t,) for t in target], "text string"))
    expected = plain(rows, target)
    assert {r["doc_id"]: [r[c] for c in ("n_words", "n_features", "weight", "score", "rank")] for r in got.collect()} == expected


@pytest.mark.parametrize("accuracy", [3, 20, 10_000])
def test_cutoff_for_any_sketch(spark, accuracy):
    """A sketch too coarse to trust is widened by the counts; a score shared by a third of all rows is cut by key."""
    rng = random.Random(accuracy)
    rows = [(i, 30, 500 if i % 3 == 0 else rng.randint(0, 1000)) for i in range(3000)]
    rows += [(i, 5, 5000) for i in range(3000, 3100)] + [(None, 30, 990)] * 3
    for percent in (0, 1, 5, 45, 60, 100):
        df = spark.createDataFrame(rows, "doc_id long, n_words long, score long")
        got = R.draw(df, percent=percent, accuracy=accuracy).where("rank IS NOT NULL").orderBy("rank").collect()
        pool = sorted((-s, k is None, k or 0) for k, n, s in rows if n >= 20)
        assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got] == pool[: percent * len(pool) // 100]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_bracket_is_small(spark):
    pool = spark.range(200_000).select((F.xxhash64("id") % 1_000_000).alias("score"))
    low, high, over, inside = R.bracket(pool, 10_000, 200_000)
    assert over < 10_000 <= over + inside and inside < 2_000


def test_odd_rows(odd, nothing, spark):
    target = spark.createDataFrame([("word1 of1",), (None,)], "text string")
    clashing = odd.withColumns({"rank": F.lit("x"), "weight": F.lit("y"), "n_features": F.lit(0)})
    rows = R.resample(clashing, target).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        words, found = features(r["text"])
        assert (r["n_words"], r["n_features"]) == (len(words), len(found))
    assert R.resample(nothing, target).count() == 0
    assert R.resample(odd, target.limit(0)).count() == len(rows)
    gain = R.gains(nothing, target.limit(0))
    assert np.array_equal(gain, np.zeros(R.BUCKETS, np.int64))
