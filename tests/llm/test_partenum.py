import itertools
import os
import random

import numpy as np
import pytest

from dasyspark.llm import partenum as P
from dasyspark.llm.components import connected


def plain_components(docs, width, num, den):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * common >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, base, copies, edits, vocabulary=500):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            words[rng.integers(0, len(words))] = f"w{rng.integers(0, vocabulary)}"
        out.append(words)
    return out


@pytest.mark.parametrize(("slack", "keep"), [(0, 1), (1, 1), (1, 2), (2, 1)])
@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (95, 100)])
def test_similar_sets_always_share_a_signature(slack, keep, num, den):
    rng = np.random.default_rng(num + slack)
    for _ in range(400):
        size = int(rng.choice([1, 2, 5, 9, 12, 20, 60, 150]))
        a = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
        common = a[: rng.integers(1, size + 1)]
        b = np.concatenate((common, rng.integers(0, 2**63, rng.integers(0, size), dtype=np.int64).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        inter = len(np.intersect1d(a, b))
        shared = np.intersect1d(P.signatures(a, num, den, slack, keep), P.signatures(b, num, den, slack, keep))
        if den * inter >= num * (len(a) + len(b) - inter):
            assert len(shared)


@pytest.mark.parametrize(("block", "width", "num"), [(512, 3, 90), (8, 3, 90), (8, 5, 80)])
def test_components_equal_brute_force(make, monkeypatch, block, width, num):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "HUBS", 2)
    rng = np.random.default_rng(block + width)
    texts = []
    for size in (4, 6, 11, 25, 70):
        base = [f"w{i}" for i in rng.integers(0, 500, size)]
        texts += family(rng, base, 14, max(1, size // 10))
    base = [f"w{i}" for i in rng.integers(0, 500, 90)]
    for _ in range(40):  # a chain: each differs a little from the one before
        base = family(rng, base, 1, 2)[0]
        texts.append(base)
    texts += [[], ["one"], ["one"], ["Two", "words"], ["two", "WORDS"], ["x"] * 30, ["x"] * 40]
    order = rng.permutation(len(texts))
    docs = [(int(i) * 3, " ".join(texts[i])) for i in order] + [(1, None), (2, " \t "), (4, "a" * 100_000)]
    found = P.jaccard_components(make(docs), width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(docs, width, num, 100)
    assert len(found) == len(docs)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in P.jaccard_components(odd).collect()]
    by = {d: c for d, _, c in rows}
    assert len(rows) == 11 and rows.count((5, 3, 5)) == 2
    assert by[6] == 5 and by[1] == 1 and by[None] is None and by[7] == 7
    assert P.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("per_task", [400_000, 60, 7])
def test_connected_components_of_paths_stars_and_loops(spark, monkeypatch, per_task):
    monkeypatch.setattr("dasyspark.llm.components.EDGES_PER_TASK", per_task)
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (90, 2))]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == root
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_meetings_of_many_buckets_are_joined(spark, make, monkeypatch):
    """Sets that meet in every bucket make one row a task, in one task or in several, with the same components."""
    rng = random.Random(2)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(30)]
    rows = []
    for k, words in enumerate(base):
        for copy in range(6):
            changed = [w if rng.random() > 0.005 else "x" for w in words]
            rows.append((100 * k + copy, " ".join(changed)))
    docs = make(rows)
    one = {r["doc_id"]: r["component_id"] for r in P.jaccard_components(docs).collect()}
    signed = P.sign(docs, 5, 80, 100, 16, 1, 1)
    met = P.meetings(signed, 16, "met")
    assert met.count() == met.select("node").distinct().count() <= len(rows)
    monkeypatch.setattr(P, "PAIRS_PER_TASK", 50)
    assert {r["doc_id"]: r["component_id"] for r in P.jaccard_components(docs).collect()} == one
    a, b = np.array([0, 3, 5, 7, 1, 2]), np.array([3, 1, 6, 7, 2, 4])
    assert P.joined_roots(a, b, 9).tolist() == [0, 0, 0, 0, 0, 5, 5, 7, 8]
    assert P.meetings(signed.limit(0), 4, "none").count() == 0


def test_what_met_by_chance_falls_apart_under_another_hashing_and_links_stay(spark, make):
    from pyspark.sql import functions as F

    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join([*(f"w{i}x{j}" for j in range(100)), *passage]) for i in range(40)]
    texts += [t + " end" for t in texts[:3]]
    sets = [P.shingle_hashes(t, 5) for t in texts]
    rows = spark.createDataFrame(
        [(P.node_of(s), 7, bytearray(s.tobytes())) for s in sets], "node long, root long, shingles binary"
    ).withColumn("member", F.lit(None).cast("long"))
    once = P.refine(rows, 80, 100, 2, 1)
    twice = P.refine(once, 80, 100, 2, 2)

    def together(found):
        return {frozenset(r.nodes) for r in found.groupBy("root").agg(F.collect_set("node").alias("nodes")).collect()}

    first, second = together(once), together(twice)
    assert sum(map(len, second)) < sum(map(len, first))
    for i in range(3):
        assert any({P.node_of(sets[i]), P.node_of(sets[40 + i])} <= group for group in second)
    assert {r.member & -2 for r in twice.collect()} <= {P.node_of(s) for s in sets}


def test_a_written_table_leaves_no_shuffle_files_and_can_be_discarded(spark, make):
    from dasyspark import session

    def files():
        left = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {x for i in range(left.size()) if (x := left.apply(i).getName()).startswith("shuffle")}

    before = files()
    counted = session.materialize(make([(1, "a"), (2, "a")]).groupBy("text").count(), "counted")
    assert not files() - before and counted.first()["count"] == 2
    session.discard(counted)
    assert not os.path.exists(counted.written.removeprefix("file:"))
