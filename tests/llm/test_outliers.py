from collections import Counter, defaultdict

import numpy as np

from dasyspark.llm import outliers as O
from dasyspark.llm.common import words_of


def plain_counts(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_a_plain_version(spark, odd, make):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = make([(-1, "a b c a b c a b"), (-2, "x x x x"), (-3, "x x x"), (-4, "l\nl\n \nl\r\n\x0bq"), (-5, "a b a b c"), (-6, "aa b aab")])
    for df in (docs, more.select("doc_id", "text"), odd.select("doc_id", "text")):
        for r in O.text_statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text), r.doc_id


def plain_mcd(x, settings, pooled):
    """Concentration steps with exact quantiles."""
    floor = np.maximum(O.POOLED_SHARE * pooled, O.GRAIN)
    m = np.median(x, axis=0)
    s = np.diag((1.4826 * np.median(np.abs(x - m), axis=0)) ** 2 + floor**2)
    for _ in range(settings.steps):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        half = x[d <= np.quantile(d, settings.share, method="inverted_cdf")]
        m, s = half.mean(axis=0), np.cov(half.T, bias=True) + np.diag(floor**2)
    for last in (False, True):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        d = d / max(1.0, np.quantile(d, 0.5, method="inverted_cdf") / O.CHI_MEDIAN)
        if last:
            return d
        near = x[d <= O.CHI_MOST]
        m, s = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floor**2)


def test_distances_follow_a_plain_estimate_and_outliers_go(spark):
    rng = np.random.default_rng(0)
    rows, vectors = [], {}
    for cell, centre in (("a", 5.0), ("b", 7.0), ("c", 6.0)):
        x = rng.multivariate_normal([centre, 1.6, 0.1, 0.1, 0.1], np.diag([0.5, 0.01, 0.01, 0.01, 0.01]) + 0.002, 1500)
        x[:150] += np.array([0, 3.0, 2.0, 0, 0])  # a tenth of the cell lies far off
        vectors[cell] = x
        rows += [(i, cell, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, cell string, " + ", ".join(f"{s} double" for s in O.STATS))
    settings = O.Settings()
    model = O.estimates(df, settings)
    far = df.join(model, "cell").select("i", "cell", (O.squared_distance() / O.F.col("scale")).alias("d")).collect()
    by = defaultdict(dict)
    for r in far:
        by[r.cell][r.i] = r.d
    pooled = np.concatenate(list(vectors.values())).std(axis=0)
    for cell, x in vectors.items():
        got, want = np.array([by[cell][i] for i in range(1500)]), plain_mcd(x, settings, pooled)
        assert np.max(np.abs(got / want - 1)) < 0.05
        assert (got[:150] > settings.cut).all() and (got[150:] <= settings.cut).mean() > 0.995


def test_repeats_below_the_base_limit_go(make):
    """In a cell of clean texts, 40 % repeated words or a third of repeated lines are enough, each alone."""
    rng = np.random.default_rng(3)

    def words(n):
        return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n)]

    def lines(ws):
        return "\n".join(" ".join(ws[i : i + 10]) for i in range(0, len(ws), 10))

    docs = [(i, lines(words(int(rng.integers(150, 300)))), "en", "s") for i in range(300)]
    again = words(10)
    scattered = [w for k in range(8) for w in [*again, *words(15)]]
    docs.append((900, " ".join(scattered), "en", "s"))
    block = [" ".join(words(10)) for _ in range(12)]
    docs.append((901, "\n".join([*block, *(["a b"] * 7)]), "en", "s"))
    found = {r.doc_id: r for r in O.judge(make(docs)).collect()}
    assert 0.35 < found[900].n_repeat_words / found[900].n_words < 0.5
    assert not found[900].base_failed and not found[900].kept and not found[901].base_failed and not found[901].kept
    assert sum(found[i].kept for i in range(300)) >= 294


def test_small_cells_odd_rows_and_empty_tables(make, odd, nothing):
    rng = np.random.default_rng(1)

    def text(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))

    docs = [(i, text(int(rng.integers(60, 300))), "en", "big") for i in range(150)]
    docs += [(i, text(200), "en", f"s{i % 40}") for i in range(200, 320)]
    docs += [(i, text(200), None, None) for i in range(400, 405)]
    docs += [(500, "#### " * 20 + text(100), "en", "big"), (501, "few words", "en", "big"), (502, "again and again " * 40, "en", "big")]
    found = {r.doc_id: r for r in O.judge(make(docs)).collect()}
    assert len(found) == len(docs)
    assert all(found[i].distance is not None for i in [*range(150), *range(200, 320)])
    assert sum(found[i].kept for i in [*range(150), *range(200, 320)]) >= 265
    assert all(found[i].kept and found[i].distance is None for i in range(400, 405))
    assert not found[500].base_failed and not found[500].kept
    assert found[501].base_failed and found[502].base_failed and not found[501].kept
    rows = O.judge(odd).collect()
    assert len(rows) == 11 and all(r.kept == (not r.base_failed) for r in rows)
    assert O.judge(nothing).count() == 0
