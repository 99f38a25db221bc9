"""Toxicity by a logistic model whose scores must not move when identity terms are swapped.

Words and stems (first letters of words) that separate the labelled classes are
chosen by a test over all labelled rows: abuse is inflected, so a stem is met far
more often than any of its forms. The weights minimise the log loss plus ``penalty`` times the squared change
of the logit between a labelled text and its counterfactuals, the same text with
an identity term replaced by another of its set. So a mention of a group, neutral
or not, carries no weight of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.llm.common import join_small, trimmed

LETTERS = re.compile(r"[^\W\d_]+")
# What separates words in Latin-1 becomes a space.
LATIN = bytes(c if LETTERS.match(chr(c)) else ord(" ") for c in range(256))

STEMS = (4, 5, 6)
MOST_HELD = 400_000

# Sets of words that name groups; words of one set stand in for one another.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("mexican", "chinese", "african", "european", "american", "arab"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)


def word_set(text: str | None) -> set[str]:
    """Lower-cased runs of letters; empty without text."""
    if not text:
        return set()
    text = text.lower()
    try:
        return set(text.encode("latin-1").translate(LATIN).decode("latin-1").split())
    except UnicodeEncodeError:
        return set(LETTERS.findall(text))


def with_stems(words) -> set[str]:
    """Words and their stems, which end in a star."""
    words = list(words)
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def finder(features: Iterable[str]) -> Callable[[set[str]], set[str]]:
    """A function that tells which of ``features`` are among some words and their stems.

    Few words begin like one of the stems, so only these are cut.
    """
    wanted = frozenset(features)
    stems = frozenset(f for f in wanted if f.endswith("*"))
    shortest = min(STEMS)
    starts = frozenset(f[:shortest] for f in stems)

    def find(words: set[str]) -> set[str]:
        return (words & wanted) | (with_stems([w for w in words if w[:shortest] in starts]) & stems)

    return find


def counterfactuals(features: set[str], groups=IDENTITY) -> list[set[str]]:
    """The feature set with each identity term, and its stems, replaced by each other term of its set."""
    made = []
    for group in groups:
        for term in features.intersection(group):
            rest = features - with_stems([term])
            made += [rest | with_stems([other]) for other in group if other != term]
    return made


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def logit(self, words: set[str]) -> float:
        """Of a set of words and stems."""
        return self.bias + float(sum(self.weights[self.vocabulary[w]] for w in sorted(words & self.vocabulary.keys())))

    def probability(self, words: set[str]) -> float:
        """Of a set of words and stems."""
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(words), -500, 500))))

    def score(self, text: str | None) -> float:
        return self.probability(with_stems(word_set(text)))


def separating_words(labelled: DataFrame, label: str, least: int, most: int) -> tuple[list[str], int]:
    """Words of at least ``least`` labelled texts, by the likelihood ratio of their presence in either class; the number of texts."""

    def count(batches):
        # Whole words and stems of each length apart, so that a stem gets its star when it is sent only.
        seen = {(y, n): Counter() for y in (0, 1) for n in (0, *STEMS)}

        def flush():
            words, counts = [], ([], [])
            for n in (0, *STEMS):
                found = list(seen[0, n].keys() | seen[1, n].keys())
                words += [w + "*" for w in found] if n else found
                for y in (0, 1):
                    counts[y].extend(seen[y, n][w] for w in found)
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["word", "n0", "n1"])
            for c in seen.values():
                c.clear()
            return made

        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_set(text)
                seen[y, 0].update(words)
                for n in STEMS:
                    seen[y, n].update({w[:n] for w in words if len(w) >= n})
                if sum(map(len, seen.values())) > MOST_HELD:
                    yield flush()
        yield flush()

    labelled = labelled.select("text", F.col(label).cast("int").alias("y"))
    # The rows are counted by themselves, which reads no text; a look into the words below would count them twice.
    totals = dict(labelled.groupBy("y").count().collect())
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t0 or not t1:
        return [], t0 + t1
    found = (
        labelled.mapInArrow(trimmed(count), "word string, n0 long, n1 long")
        .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= least)
    )
    n, rate = F.col("n0") + F.col("n1"), t1 / (t0 + t1)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (
        part(F.col("n1"), n * rate) + part(F.col("n0"), n * (1 - rate))
        + part(t1 - F.col("n1"), (t0 + t1 - n) * rate) + part(t0 - F.col("n0"), (t0 + t1 - n) * (1 - rate))
    )
    chosen = found.withColumn("g", F.round(g, 6)).where("g > 12")
    return [r[0] for r in chosen.orderBy(F.desc("g"), "word").limit(most).select("word").collect()], t0 + t1


def train(
    rows: list[tuple[set[str], int]], words: list[str], groups=IDENTITY, penalty: float = 10.0, ridge: float = 1e-4,
    steps: int = 600, rate: float = 0.2,
) -> Model:
    """Full-batch fit of the penalised logistic loss from feature sets with labels; no randomness.

    Both classes weigh the same in the loss, so that one rare insult is enough.
    """
    terms = sorted(with_stems(t for g in groups for t in g) - set(words))
    vocabulary = {w: i for i, w in enumerate([*words, *terms])}
    d = len(vocabulary)

    def matrix(sets):
        x = np.zeros((len(sets), d), np.float32)
        for i, s in enumerate(sets):
            x[i, [vocabulary[w] for w in s & vocabulary.keys()]] = 1
        return x

    x, y = matrix([s for s, _ in rows]), np.array([v for _, v in rows], np.float32)
    changed = [(i, c) for i, (s, _) in enumerate(rows) for c in counterfactuals(s, groups)]
    delta = matrix([c for _, c in changed]) - x[[i for i, _ in changed]] if changed else np.zeros((0, d), np.float32)
    gram = delta.T @ delta / max(1, len(changed))
    positive = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32) / max(1, len(y))
    w, b = np.zeros(d, np.float32), np.float32(0)
    m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    for step in range(1, steps + 1 if len(rows) else 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = (p - y) * weight
        g = np.append(x.T @ error + 2 * ridge * w + 2 * penalty * (gram @ w), error.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(vocabulary, w.astype(float), float(b))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 16_384, max_words: int = 1_024,
    least: int = 5, groups=IDENTITY, **settings,
) -> Model:
    """Fit on ``docs`` (doc_id, text) joined with ``labels`` (doc_id, ``label``).

    The words are chosen over all labelled rows; the weights are fitted on at most
    ``max_rows`` of them, those with the smallest hash of their doc_id modulo 2^20. Rows
    without id or label are left out, an id labelled twice counts as 1 if any
    label is. Without rows of both classes every score is one half or the base rate.
    """
    marks = (
        labels.where(f"doc_id IS NOT NULL AND `{label}` IS NOT NULL").groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    rows = join_small(docs.select("doc_id", "text"), marks, "doc_id", "inner", 16)
    words, n = separating_words(rows, "y", least, max_words)
    kept = set(words) | with_stems(t for g in groups for t in g)

    def features(batches):
        find = finder(kept)
        for batch in batches:
            ids, texts, ys = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([sorted(find(word_set(t))) for t in texts], pa.list_(pa.string())),
                 pa.array(ys, pa.int32())],
                names=["doc_id", "words", "y"],
            )

    order = F.xxhash64(F.col("doc_id"))
    # Rows with a hash this small are hardly more than wanted, so each task sends few of them.
    share = min(1.0, 1.2 * max_rows / max(1, n))
    near = F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    order = F.pmod(order, F.lit(1 << 20))
    chosen = rows.where(near).withColumn("text", F.coalesce("text", F.lit(""))).select(F.col("doc_id").cast("long"), "text", "y")
    sample = (
        chosen.mapInArrow(trimmed(features), "doc_id long, words array<string>, y int")
        .orderBy(order, "doc_id", F.concat_ws(" ", "words")).limit(max_rows)
    )
    return train([(set(r.words), r.y) for r in sample.collect()], words, groups, **settings)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from one half on) to every row; null texts score like empty ones.

    Columns of these names are replaced. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double, predicted int"

    def run(batches):
        model = shared.value
        find = finder(model.vocabulary)
        for batch in batches:
            found = [model.probability(find(word_set(t))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(trimmed(run), schema)
