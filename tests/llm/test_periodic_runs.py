import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dasyspark.llm import periodic_runs as P
from dasyspark.llm.common import words_of


def plain(words, least=P.LEAST):
    """All maximal repeats by trying every period; the least period of a stretch counts."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def without_repeats(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_match_all_periods_tried(letters):
    rng = random.Random(letters)
    docs = []
    for _ in range(150):
        words = rng.choices("abcdefgh"[:letters], k=rng.randint(0, 60))
        if rng.random() < 0.5 and words:
            part = words[: rng.randint(1, 9)]
            at = rng.randint(0, len(words))
            words = words[:at] + part * rng.randint(2, 12) + words[at:]
        docs.append(words)
    ids = np.array([ord(w) for d in docs for w in d], np.int64)
    sizes = np.array([len(d) for d in docs])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    got = P.find_runs(ids, np.repeat(np.arange(len(docs)), sizes), least=4)
    for k, words in enumerate(docs):
        mine = got[(got[:, 0] >= offset[k]) & (got[:, 1] <= offset[k + 1]) & (got[:, 1] > got[:, 0])]
        mine = mine[mine[:, 0] < offset[k + 1]]
        assert sorted((int(a - offset[k]), int(b - a), int(q)) for a, b, q in mine) == plain(words, 4)


def test_suffixes_are_sorted_within_documents():
    rng = np.random.default_rng(1)
    words, doc = rng.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    order, levels = P.sorted_suffixes(words, doc)
    keys = [(doc[i], *words[i : 50 * (doc[i] + 1)]) for i in order]
    assert keys == sorted(keys)
    lcp = P.common_lengths(order, levels)
    for r in range(1, 400):
        a, b = keys[r - 1], keys[r]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[r] == max(0, same - 1)


def test_collapse(make):
    texts = {
        1: "x " + "a b c " * 6 + "d", 2: "a " * 11, 3: "a " * 12, 4: " ".join(f"w{i}" for i in range(50)) + " " + "one two " * 500,
        5: "é 漢 " * 7 + "tail", 6: "a b " * 6 + "a c", 7: "p\tq\n" * 9,
    }
    rows = {r["doc_id"]: r for r in P.collapse_runs(make(list(texts.items()))).collect()}
    for key, text in texts.items():
        words = words_of(text)
        runs = plain(words)
        assert [tuple(r) for r in rows[key]["runs"]] == runs, key
        assert rows[key]["collapsed"] == without_repeats(words, runs)
    assert rows[1]["collapsed"] == "x a b c d" and rows[2]["runs"] == [] and rows[3]["collapsed"] == "a"


def test_odd_rows(odd, nothing):
    clashing = odd.withColumns({"runs": F.lit("extra"), "collapsed": F.lit(1), "start": F.lit(2)})
    out = P.collapse_runs(clashing)
    assert set(out.columns) == set(clashing.columns) and dict(out.dtypes)["collapsed"] == "string"
    rows = out.collect()
    assert len(rows) == clashing.count()
    for r in rows:
        words = words_of(r["text"])
        if len(words) < 5_000:
            runs = plain(words)
            assert [tuple(x) for x in r["runs"]] == runs
            assert r["collapsed"] == (None if r["text"] is None else without_repeats(words, runs))
    assert P.collapse_runs(nothing).count() == 0
    assert P.collapse_runs(odd, carry=["doc_id"]).columns == ["doc_id", "runs", "collapsed"]
