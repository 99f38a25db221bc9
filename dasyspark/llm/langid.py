"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams by rank. A document
is compared by the out-of-place distance: for each of its own most frequent
n-grams, the difference between its rank in the document and in the profile, or
the profile's length where the profile lacks it. The nearest language wins.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dasyspark.llm.common import pieces, trimmed

SIZE, LONGEST = 300, 3
UNKNOWN = "und"
EDGE = 1  # stands for a word's edge in a code


@functools.cache
def letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or EDGE for what is no letter."""
    table = np.full(sys.maxunicode + 1, EDGE, np.int64)
    for c in range(sys.maxunicode + 1):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str | None, longest: int = LONGEST) -> np.ndarray:
    """Codes of the 1- to 3-grams of all words: letters, with an edge mark on either side.

    21 bits for each character; an n-gram holds an edge only at its ends.
    """
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate(([EDGE], letter_table()[raw], [EDGE]))
    c = c[np.concatenate(([True], (c[1:] != EDGE) | (c[:-1] != EDGE)))]
    if len(c) < 3:
        return np.empty(0, np.int64)
    inner = c != EDGE
    made = [c[inner]]
    if longest >= 2:
        made.append(c[:-1] << 21 | c[1:])
    if longest >= 3:
        made.append((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner[1:-1]])
    return np.concatenate(made)


def top(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes, the smaller first of equally frequent ones."""
    found, count = np.unique(codes, return_counts=True)
    return found[np.argsort(-count, kind="stable")[:size]]


def fit_profiles(docs: DataFrame, size: int = SIZE, longest: int = LONGEST) -> DataFrame:
    """(lang, code, place) from all rows of ``docs`` (text, lang) that have both.

    Tasks count their rows and send one row per language and n-gram; place counts
    from 0. Equal counts are ordered by code.
    """

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for part in pieces(batch):
                by: dict[str, list] = {}
                for text, lang in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    by.setdefault(lang, []).append(grams(text, longest))
                for lang, codes in by.items():
                    codes, n = np.unique(np.concatenate(codes), return_counts=True)
                    if lang in held:
                        codes, at = np.unique(np.concatenate((held[lang][0], codes)), return_inverse=True)
                        n = np.bincount(at, np.concatenate((held[lang][1], n)), len(codes)).astype(np.int64)
                    held[lang] = [codes, n]
        for lang, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())],
                names=["lang", "code", "n"],
            )

    rows = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(trimmed(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).drop("n")


class Profiles:
    """All profiles as one sorted code list and a table of places."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = SIZE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        number = {x: i for i, x in enumerate(self.langs)}
        for lang, code, place in rows:
            self.places[np.searchsorted(self.codes, code), number[lang]] = place

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        """Nearest language, the first in text order of equals, and one minus its distance over the largest one."""
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = top(codes, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        places = self.places[np.where(self.codes[at] == own, at, len(self.codes))]
        far = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / float(self.size * len(own))


def identify(
    docs: DataFrame, profiles: DataFrame, size: int = SIZE, longest: int = LONGEST, text: str = "text"
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row of ``docs``.

    A null text, one without a letter, and any text when nothing was learnt are
    ``und`` with score 0. Columns of these names are replaced. The profiles, of
    ``size`` n-grams for each language, go to every task.
    """
    model = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in profiles.collect()])
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double"

    def run(batches):
        known = Profiles(model.value, size)
        for batch in batches:
            found = [known.predict(grams(t, longest)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(trimmed(run), schema)
