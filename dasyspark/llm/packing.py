"""Sum-of-squares online packing of token sequences into windows.

Rows arrive one by one. With N(h) the number of open windows filled to level h,
a document of s tokens goes to the level (or a new window) that leaves the sum
of all N(h)^2 smallest. Only the level array and the pieces of open windows are
kept. Documents longer than a window first fill whole windows; their rest is
placed like a short document. Windows still open when a task's input ends are
poured together in order of their fill and cut anew, so that each task leaves
one rest, which is cut at powers of two, where no padding is needed.

Each input partition packs alone: no shuffle, and a lost task packs the same
rows again with the same result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.llm.common import trimmed

WINDOW = 1024
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Levels:
    """Open windows by level, and the choice of the next one."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, deque] = {}

    def place(self, size: int) -> int:
        """The level (0: a new window) whose choice leaves the least sum of squares; the fullest of equals."""
        c, w = self.count, self.window
        if size == w:
            return 0
        top = w - size
        # Taking a window from level h: -2 N(h) + 1; adding one at h + size: 2 N + 1, nothing when full.
        gain = 1 - 2 * c[1 : top + 1]
        gain[: top - 1] += 2 * c[1 + size : w] + 1
        gain[c[1 : top + 1] == 0] = np.iinfo(np.int64).max
        fresh = 2 * c[size] + 1
        if len(gain):
            at = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[at] <= fresh:
                return at + 1
        return 0

    def take(self, level: int) -> list:
        if not level:
            return []
        self.count[level] -= 1
        return self.open[level].popleft()

    def put(self, level: int, content: list) -> None:
        self.count[level] += 1
        self.open.setdefault(level, deque()).append(content)


class Packer:
    """Feeds documents in, gives finished windows out as lists of pieces.

    A piece is (doc_id, start, ids, doc_tokens).
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.levels = window, Levels(window)

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        total, w = len(ids), self.window
        whole = total // w * w
        for start in range(0, whole, w):
            yield [(doc_id, start, ids[start : start + w], total)]
        size = total - whole
        if not size:
            return
        level = self.levels.place(size)
        content = self.levels.take(level)
        content.append((doc_id, whole, ids[whole:], total))
        if level + size == w:
            yield content
        else:
            self.levels.put(level + size, content)

    def close(self) -> Iterator[list]:
        """Pour what is open together; the last rest is cut at powers of two."""
        room: list = []
        left = self.window
        rest = sum(level * len(found) for level, found in self.levels.open.items())
        left = self.window if rest >= self.window else 1 << (rest.bit_length() - 1) if rest else 0
        for level in sorted(self.levels.open, reverse=True):
            for content in self.levels.open[level]:
                for doc_id, start, ids, total in content:
                    while len(ids):
                        part, ids = ids[:left], ids[left:]
                        room.append((doc_id, start, part, total))
                        start += len(part)
                        left -= len(part)
                        rest -= len(part)
                        if not left:
                            yield room
                            room = []
                            left = self.window if rest >= self.window else 1 << (rest.bit_length() - 1) if rest else 0
        self.levels = Levels(self.window)


def pack_partition(
    docs: Iterator[tuple[object, np.ndarray]], first_id: int, window: int = WINDOW, rows: int = 20_000
) -> Iterator[dict]:
    """Batches of piece rows for (doc_id, ids) pairs."""
    packer, out, number = Packer(window), [], first_id

    def emit(content: list) -> None:
        nonlocal number
        offset = 0
        for doc_id, start, ids, total in content:
            out.append((
                doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset,
            ))
            offset += len(ids)
        number += 1

    def flush() -> dict:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        columns = dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
        out.clear()
        return columns

    for doc_id, ids in docs:
        for content in packer.add(doc_id, ids):
            emit(content)
        if len(out) >= rows:
            yield flush()
    for content in packer.close():
        emit(content)
    if out:
        yield flush()


def pack_documents(
    docs: DataFrame, encode: Callable[[], Callable[[list[str]], list]], end_id: int = 0, window: int = WINDOW
) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text).

    ``encode`` makes, once per task, a function from texts to id lists; ``end_id``
    closes each document. A null text is an empty one and a single end id. Rows
    of one doc_id, or without one, are packed each on its own. Other columns are
    ignored. Which documents share a window depends on how the input is cut into
    partitions; what each piece holds does not.
    """
    arrow = pa.schema([
        (n, pa.int64())
        for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ])

    def run(batches):
        from pyspark import TaskContext

        encoder = encode()

        def each():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(ids), 256):
                    coded = encoder([t or "" for t in texts[at : at + 256]])
                    for doc_id, found in zip(ids[at : at + 256], coded, strict=True):
                        yield doc_id, np.append(np.asarray(found, np.uint32), np.uint32(end_id))

        first = TaskContext.get().partitionId() << 40
        for columns in pack_partition(each(), first, window):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), SCHEMA)
