"""Runs of periodically repeated words, found through an enhanced suffix array.

All documents of a piece share one array of word numbers; the first sort key is
(document, word), so no comparison ever leaves a document.

* Prefix doubling sorts the suffixes. The ranks of every level are kept: two
  places with one rank at level k share their next 2^k words, which gives common
  lengths to the right and to the left by binary lifting.
* Each interval of the LCP array (its bounds by lifting over window minima, no
  tree) with depth d names suffixes that share exactly d words. Of its children
  all but the largest are walked: a suffix i whose partner i+d or i-d lies in
  the interval, in another child, starts or ends a square of period d that cannot
  be moved to the right (the branching tandem test).
* Squares are rotated to the left as far as the words allow. Squares that reach
  the same stretch are one run; the least period counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dasyspark.llm.common import pieces, words_of

LEAST = 12  # words of the shortest run
OUT = ("runs", "collapsed")
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def sorted_suffixes(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all documents, and the rank of each place by its first 1, 2, 4, ... words.

    A rank is the first slot of its group; one more entry, -1, stands behind the last place.
    """
    n = len(words)
    key = doc * np.int64(int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable").astype(np.int32)
    fresh = np.ones(n, bool)
    sorted_key = key[order]
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, size = [rank], 1
    while True:
        single = fresh.copy()
        single[:-1] &= fresh[1:]
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order, levels
        at, rank = order[slots], levels[-1]
        after = np.minimum(at + size, n)
        # A suffix that ends here has no next words; there is one such at most in a group.
        following = np.where((after < n) & (doc[np.minimum(after, n - 1)] == doc[at]), rank[after], -1).astype(np.int64)
        pair = rank[at].astype(np.int64) * (n + 1) + following + 1
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        fresh[slots] = new
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank)
        size *= 2


def common_lengths(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that the suffix in each slot shares with the one before it."""
    lcp = np.zeros(len(order) + 1, np.int32)
    first = levels[0][order]
    slots = np.flatnonzero(first[1:] == first[:-1]) + 1
    a, b = order[slots - 1].astype(np.int64), order[slots].astype(np.int64)
    got = np.zeros(len(slots), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + got] == levels[k][b + got]
        got[same] += 1 << k
    lcp[slots] = got
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots with a common length over 0, and the first and last slot of the LCP interval that each one splits."""
    slots = np.flatnonzero(lcp > 0)
    if not len(slots):
        return slots, slots, slots
    depth = lcp[slots]
    stretch = np.flatnonzero(np.diff(slots, append=slots[-1] + 2) != 1)
    longest = int(np.diff(stretch, prepend=-1).max())
    lows, n = [lcp], len(lcp)
    while (1 << len(lows)) <= longest:
        half, low = 1 << (len(lows) - 1), lows[-1]
        wider = low.copy()
        wider[: n - half] = np.minimum(low[: n - half], low[half:])
        wider[n - half :] = 0
        lows.append(wider)
    left, right = slots.copy(), slots.copy()
    for k in range(len(lows) - 1, -1, -1):
        step, low = 1 << k, lows[k]
        to = left - step
        left = np.where((to > 0) & (low[np.maximum(to, 0)] >= depth), to, left)
        to = right + 1
        right = np.where((to < n) & (low[np.minimum(to, n - 1)] >= depth), right + step, right)
    return slots, left - 1, right


def branching_tandems(order: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose next word breaks the period."""
    n = len(order)
    slots, low, high = intervals(lcp)
    if not len(slots):
        return slots, slots
    by = np.argsort(low * np.int64(n + 1) + high, kind="stable")
    slots, low, high = slots[by], low[by], high[by]
    head = np.ones(len(slots), bool)
    head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    # Children start at the interval's first slot and at each slot that splits it.
    group = np.cumsum(head) - 1
    at = np.arange(len(slots)) + group + 1
    starts = np.empty(len(slots) + group[-1] + 1, np.int64)
    owner = np.empty(len(starts), np.int64)
    heads = np.flatnonzero(head)
    starts[at], owner[at] = slots, group
    firsts = heads + np.arange(len(heads))
    starts[firsts], owner[firsts] = low[heads], np.arange(len(heads))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:]
    ends[np.append(firsts[1:] - 1, len(starts) - 1)] = high[heads] + 1
    sizes = ends - starts
    most = np.maximum.reduceat(sizes, firsts)
    largest = np.flatnonzero(sizes == most[owner])
    largest = largest[np.unique(owner[largest], return_index=True)[1]]
    walked = np.ones(len(starts), bool)
    walked[largest] = False
    starts, ends, owner, sizes = starts[walked], ends[walked], owner[walked], sizes[walked]
    child = np.repeat(np.arange(len(starts)), sizes)
    slot = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[child]
    i, depth = order[slot].astype(np.int64), lcp[slots[heads]].astype(np.int64)[owner[child]]
    found = []
    for partner, start in ((i + depth, i), (i - depth, i - depth)):
        inside = (partner >= 0) & (partner < n)
        there = place[np.where(inside, partner, 0)]
        inside &= (there >= low[heads][owner[child]]) & (there <= high[heads][owner[child]])
        inside &= (there < starts[child]) | (there >= ends[child])
        found.append((start[inside], depth[inside]))
    return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` words, by start and period, as places in ``words``."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    order, levels = sorted_suffixes(words, doc)
    start, period = branching_tandems(order, levels[-1], common_lengths(order, levels))
    back = np.zeros(len(start), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        to = start - back - (1 << k)
        same = (to >= 0) & (levels[k][np.maximum(to, 0)] == levels[k][np.maximum(to, 0) + period])
        back[same] += 1 << k
    runs = np.column_stack([start - back, start + 2 * period, period])
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _of_piece(texts: list[str | None], least: int) -> tuple[pa.Array, pa.Array]:
    number = defaultdict(count().__next__)
    split = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    offset = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(offset[-1]))
    runs = find_runs(ids, np.repeat(np.arange(len(split)), sizes), least)
    doc = np.searchsorted(offset, runs[:, 0], side="right") - 1
    # Words after the first period of any run go.
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    touched = set(doc.tolist())
    collapsed = [
        None if text is None else " ".join(compress(ws, kept[offset[i] : offset[i + 1]]) if i in touched else ws)
        for i, (text, ws) in enumerate(zip(texts, split))
    ]
    fields = [pa.array(x) for x in (runs[:, 0] - offset[doc], runs[:, 1] - runs[:, 0], runs[:, 2])]
    edges = pa.array(np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(fields, RUN.names)), pa.array(collapsed, pa.string())


def collapse_runs(docs: DataFrame, carry: Sequence[str] | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` with the runs of every text and the text without their repeats.

    ``runs``: array of (start, length, period) in words, by start and period; a run is a
    stretch that no neighbouring word extends, of at least twice its least period and
    ``least`` words. ``collapsed``: words joined by one space, each run cut down to its
    first period. A null text has no runs and a null ``collapsed``; a blank one has none
    and an empty one. Rows are judged one by one: repeated rows give equal results, an
    empty table an empty one. ``carry`` names the columns returned besides (default all);
    columns named ``runs`` or ``collapsed`` are replaced. A piece of a task holds a
    megabyte of text, or one longer text, at some 300 bytes a word.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = [c for c in (docs.columns if carry is None else carry) if c not in OUT]
    fed = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = T.StructType(
        [fed.schema[c] for c in carry] + [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                runs, collapsed = _of_piece(piece.column("text").to_pylist(), least)
                columns = [*(piece.column(c) for c in carry), runs, collapsed]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return fed.mapInArrow(run, schema)
