"""Exact removal of repeated byte strings with a sampled, distributed suffix array.

Only suffixes that can matter are sorted. Every window of ``length`` bytes picks
its anchor, the smallest-hashed gram in it; equal windows pick the same one at
the same place. Consecutive windows with one anchor make a segment, about one for
forty bytes. Segments meet by the hash of their anchor gram:

* segments with equal bytes are settled at once: all but the first repeat it;
* segments with one anchor but other bytes may still share some windows. Of each
  kind the first one sends its bytes. Their suffixes, from the anchor on, are
  range-partitioned by their leading bytes with sampled splitters, sorted by
  multikey quicksort, and the prefixes before the anchor likewise. Neighbours'
  common lengths then say exactly which windows are equal.

Suffixes with the same leading gram always share a bucket, so the comparison at a
boundary between buckets comes down to that gram and never splits a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.llm.common import mix, pieces, shuffle_partitions, trimmed
from dasyspark.session import materialize

LENGTH, GRAM = 100, 24
SEGMENTS_PER_BUCKET = 500_000
PIECE = 500_000  # bytes worked on at a time, by some twenty arrays of eight bytes each

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_UNSTEP = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  kept between calls
    if len(held.get(base, ())) < n:
        size = max(n, 1 << 19)
        made = np.full(size, base, np.uint64)
        made[0] = 1
        held[base] = np.multiply.accumulate(made)
    return held[base][:n]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every position that has so many after it."""
    if len(buf) < GRAM:
        return np.empty(0, np.uint64)
    n, h = len(buf) - GRAM + 1, _BYTES[buf]
    for size in (1, 2, 4):
        h = h[:-size] * np.uint64(pow(_STEP, size, 2**64)) + h[size:]
    tail = h[16 : 16 + n]  # bytes 16 to 23 of each gram
    h = h[:-8] * np.uint64(pow(_STEP, 8, 2**64)) + h[8:]
    return mix(h[:n] * np.uint64(pow(_STEP, 8, 2**64)) + tail)


def segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Segments of the documents buf[starts[i]:ends[i]], which lie one after another.

    row: the document; low: the first window start, from the start of the document;
    width: the number of window starts; anchor: the anchor from ``low``; key: hash
    of the anchor gram; content: hash of all bytes of the segment's windows.
    """
    empty = {"row": np.int64, "low": np.int64, "width": np.int64, "anchor": np.int64, "key": np.uint64, "content": np.uint64}
    g = gram_hashes(buf)
    span = length - GRAM + 1
    n = len(buf) - length + 1
    if n <= 0:
        return {k: np.empty(0, t) for k, t in empty.items()}
    # The least hash of each window, its position in the low bits: the first of equals.
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: n], least[span - reach : span - reach + n])
    at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    fits = ends - starts >= length
    valid[starts[fits]] += 1
    np.add.at(valid, ends[fits] - length + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    edge = np.zeros(n, bool)
    edge[change] = True
    edge[0] = True
    edge[1:] |= valid[1:] & ~valid[:-1]
    first = np.flatnonzero(valid & edge)
    last_edge = np.ones(n, bool)
    last_edge[:-1] = edge[1:] | ~valid[1:]
    last = np.flatnonzero(valid & last_edge)
    row = np.searchsorted(starts, first, side="right") - 1
    total = np.concatenate(([np.uint64(0)], np.cumsum(g * _powers(_STEP, len(g)))))
    stop = last + length - GRAM + 1
    content = (total[stop] - total[first]) * _powers(_UNSTEP, len(g) + 1)[first]
    width, anchor = last - first + 1, at[first] - first
    content = mix(content + mix((width * 256 + anchor).astype(np.uint64)))
    return {"row": row, "low": first - starts[row], "width": width, "anchor": anchor, "key": g[at[first]], "content": content}


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" if t is None else bytes(t) for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends


def cut_segments(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs of segments by bucket of their anchor.

    Of segments that repeat within a piece of the input only the first is sent;
    the others are known repeats and travel as plain ranges (``ranges``).
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch, PIECE):
                ids = np.asarray(part.column("doc_id").to_pylist(), np.int64)
                order = np.argsort(ids, kind="stable")
                texts = part.column("text").to_pylist()
                s = segments(*_joined([texts[i] for i in order]), length)
                if not len(s["row"]):
                    continue
                doc = ids[order][s["row"]]
                # The input is in order of (doc_id, start), so the first of equals is the earliest.
                by = np.lexsort((s["content"], s["key"]))
                key, content = s["key"][by], s["content"][by]
                again = np.zeros(len(by), bool)
                again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
                head = np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))
                other = again & ((doc[by] != doc[by[head]]) | (s["low"][by] != s["low"][by[head]]))
                rows: dict[str, list] = {c: [] for c in ("bucket", "docs", "at", "low", "width", "anchor", "key", "content", "ranges")}
                for known, chosen in ((False, by[~again]), (True, by[other])):
                    if not len(chosen):
                        continue
                    bucket = (s["key"][chosen] % np.uint64(buckets)).astype(np.int64)
                    if known:
                        bucket[:] = int(mix(np.uint64([doc[chosen[0]] & 0xFFFFFFFF]))[0] % np.uint64(buckets))
                    chosen = chosen[np.lexsort((chosen, bucket))]
                    bucket.sort()
                    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)):
                        here = chosen[cuts[b] : cuts[b + 1]]
                        found, at = np.unique(doc[here], return_inverse=True)
                        rows["bucket"].append(int(b))
                        rows["docs"].append(found.tobytes())
                        rows["at"].append(at.astype(np.uint16 if len(found) <= 65_536 else np.uint32).tobytes())
                        rows["low"].append(s["low"][here].astype(np.uint32).tobytes())
                        rows["width"].append(s["width"][here].astype(np.uint16).tobytes() if length > 255 else s["width"][here].astype(np.uint8).tobytes())
                        rows["anchor"].append(b"" if known else s["anchor"][here].astype(np.uint16).tobytes() if length > 255 else s["anchor"][here].astype(np.uint8).tobytes())
                        rows["key"].append(b"" if known else (s["key"][here] >> np.uint64(32)).astype(np.uint32).tobytes())
                        rows["content"].append(b"" if known else s["content"][here].tobytes())
                        rows["ranges"].append(known)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([
                    ("bucket", pa.int32()), *((c, pa.binary()) for c in list(rows)[1:-1]), ("ranges", pa.bool_()),
                ]))

    return docs.mapInArrow(
        trimmed(run), "bucket int, docs binary, at binary, low binary, width binary, anchor binary, key binary, content binary, ranges boolean"
    )


def _settler(length: int):
    small = np.uint8 if length <= 255 else np.uint16

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Ranges of window starts known to repeat (key null), and one segment of each content still in question."""
        made = {c: [] for c in ("doc", "low", "width", "anchor", "key", "content")}
        out = []
        for docs, at, low, width, anchor, key, content, known in pdf.drop(columns="bucket").itertuples(index=False):
            ids = np.frombuffer(docs, np.int64)
            doc = ids[np.frombuffer(at, np.uint16 if len(ids) <= 65_536 else np.uint32)]
            low, width = np.frombuffer(low, np.uint32).astype(np.int64), np.frombuffer(width, small).astype(np.int32)
            if known:
                out.append(pd.DataFrame({"doc_id": doc, "low": low, "width": width, "anchor": 0, "key": pd.array([None] * len(doc), "Int64")}))
                continue
            for c, v in zip(made, (doc, low, width, np.frombuffer(anchor, small), np.frombuffer(key, np.uint32), np.frombuffer(content, np.uint64)), strict=True):
                made[c].append(v)
        if made["doc"]:
            s = {c: np.concatenate(v) for c, v in made.items()}
            # First bring equal keys together; only those that are not alone are sorted in full.
            by = np.argsort(s["key"], kind="stable")
            key = s["key"][by]
            alone = np.ones(len(by), bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
            by = by[~alone]
            by = by[np.lexsort((s["low"][by], s["doc"][by], s["content"][by], s["key"][by]))]
            s = {c: v[by] for c, v in s.items()}
            n = len(by)
            fresh_key, fresh = np.ones(n, bool), np.ones(n, bool)
            fresh_key[1:] = s["key"][1:] != s["key"][:-1]
            fresh[1:] = fresh_key[1:] | (s["content"][1:] != s["content"][:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.empty(0, np.int64)
            repeat = (s["doc"] != s["doc"][head]) | (s["low"] != s["low"][head])
            group = np.cumsum(fresh_key) - 1
            kinds = np.bincount(group, fresh) if n else np.empty(0)
            open_ = fresh & (kinds[group] > 1) if n else fresh
            for chosen, keyed in ((repeat, False), (open_, True)):
                out.append(pd.DataFrame({
                    "doc_id": s["doc"][chosen], "low": s["low"][chosen], "width": s["width"][chosen].astype(np.int32),
                    "anchor": s["anchor"][chosen].astype(np.int32),
                    "key": pd.array(s["key"][chosen].astype(np.int64) if keyed else [None] * int(chosen.sum()), "Int64"),
                }))
        return pd.concat(out, ignore_index=True)

    return settle


# ------------------------------------------------------------- suffix sorting


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of big-endian words, and the number of equal leading words of neighbours.

    Multikey quicksort: rows are sorted by their first word; only rows that tie are
    sorted by the next one.
    """
    n, depth = words.shape
    order, equal = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # places in ``order`` whose rows are not yet told apart
    run = np.zeros(n, np.int64)
    for d in range(depth):
        if not len(tied):
            break
        word = words[order[tied], d]
        by = np.lexsort((word, run))
        order[tied] = order[tied][by]
        word = word[by]
        same = np.zeros(len(tied), bool)
        same[1:] = (run[1:] == run[:-1]) & (word[1:] == word[:-1])
        equal[tied[same]] = d + 1
        run = np.cumsum(~same)
        kept = same.copy()
        kept[:-1] |= same[1:]
        tied, run = tied[kept], run[kept]
    return order, equal


def _prefix_classes(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings and the common length of each with its predecessor, up to ``depth``."""
    padded = -(-depth // 8) * 8
    lengths = np.minimum([len(x) for x in strings], depth)
    raw = np.frombuffer(b"".join(x[:depth].ljust(padded, b"\0") for x in strings), np.uint8).reshape(-1, padded)
    order, words = multikey_order(raw.view(">u8").astype(np.uint64))
    common = np.minimum(words * 8, depth)
    for i in range(8):
        spot = words * 8 + i
        inside = spot < padded
        a = raw[order[1:], np.minimum(spot[1:], padded - 1)]
        b = raw[order[:-1], np.minimum(spot[1:], padded - 1)]
        step = inside[1:] & (a == b) & (common[1:] == spot[1:])
        common[1:][step] += 1
    common[1:] = np.minimum(common[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    common[:1] = 0
    return order, common


def shared_windows(
    text: list[bytes], anchor: np.ndarray, width: np.ndarray, doc: np.ndarray, low: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """Which windows of segments occur in an earlier segment of the list: a matrix, rows as given, by window.

    ``text``: a segment's bytes; windows start at its first ``width`` bytes.
    """
    n = len(text)
    span = length - GRAM + 1
    marks = np.zeros((n, span), bool)
    if not n:
        return marks
    order_r, common_r = _prefix_classes([t[a:] for t, a in zip(text, anchor.tolist(), strict=True)], length)
    order_l, common_l = _prefix_classes([t[:a][::-1] for t, a in zip(text, anchor.tolist(), strict=True)], span)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((low + anchor, doc))] = np.arange(n)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(span):  # bytes of the window before the anchor
        start = anchor - before
        rows = np.flatnonzero((start >= 0) & (start < width))
        if len(rows) < 2:
            continue
        right[order_r] = np.cumsum(common_r < length - before)
        left[order_l] = np.cumsum(common_l < before)
        by = rows[np.lexsort((rank[rows], left[rows], right[rows]))]
        again = (right[by[1:]] == right[by[:-1]]) & (left[by[1:]] == left[by[:-1]])
        marks[by[1:][again], start[by[1:][again]]] = True
    return marks


def _sorter(length: int):
    def sort_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        # Rows that repeat a doc_id send their segments again.
        pdf = pd.concat(held, ignore_index=True).drop_duplicates(["doc_id", "low"], ignore_index=True)
        if not len(pdf):
            return
        marks = shared_windows(
            [bytes(x) for x in pdf["segment"]], pdf["anchor"].to_numpy(np.int64), pdf["width"].to_numpy(np.int64),
            pdf["doc_id"].to_numpy(), pdf["low"].to_numpy(), length,
        )
        edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edges == 1)
        _, end = np.nonzero(edges == -1)
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[row], "low": pdf["low"].to_numpy()[row] + begin,
            "width": (end - begin).astype(np.int32),
        })

    return sort_bucket


# --------------------------------------------------------------------- plan


def _per_document(ranges: DataFrame, *fields: str) -> DataFrame:
    """One row per doc_id with its ranges."""
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("ranges"))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, low, width): runs of window starts in ``docs`` (doc_id, text) whose bytes occur earlier."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(shuffle_partitions(spark), volume // (38 * SEGMENTS_PER_BUCKET)))
    settled = materialize(
        cut_segments(docs, length, buckets).repartition(buckets, "bucket").groupBy("bucket")
        .applyInPandas(_settler(length), "doc_id long, low long, width int, anchor int, key long"),
        "settled",
    )
    known = settled.where("key IS NULL").select("doc_id", "low", "width")
    pairs = docs.join(_per_document(settled.where("key IS NOT NULL"), "low", "width", "anchor"), "doc_id")

    def fetch(batches):
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "low", "width", "anchor", "segment")}
            for doc_id, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in ranges:
                    rows["doc_id"].append(doc_id)
                    for c in ("low", "width", "anchor"):
                        rows[c].append(r[c])
                    rows["segment"].append(raw[r["low"] : r["low"] + r["width"] + length - 1])
            yield pa.RecordBatch.from_pydict(rows, pa.schema([
                ("doc_id", pa.int64()), ("low", pa.int64()), ("width", pa.int32()), ("anchor", pa.int32()), ("segment", pa.binary()),
            ]))

    held = pairs.select("doc_id", "text", "ranges").mapInArrow(
        trimmed(fetch), "doc_id long, low long, width int, anchor int, segment binary"
    )
    lead = F.expr(f"substring(segment, anchor + 1, {GRAM})")
    buckets = shuffle_partitions(spark)
    found = materialize(
        held.withColumn("lead", lead).repartitionByRange(buckets, "lead").drop("lead")
        .mapInPandas(trimmed(_sorter(length)), "doc_id long, low long, width int"),
        "shared",
    )
    return known.unionByName(found)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add ``kept`` (binary) and ``spans`` (array of start, end; end excluded, in bytes) to every row of ``docs``.

    A byte is removed if it lies in a string of ``length`` bytes that also starts
    earlier: in a document of smaller doc_id, or before in the same one. Texts are
    taken as UTF-8; a null one is empty. A doc_id names one text: rows that repeat
    both are one document and get the same result. Rows without a doc_id are kept
    whole and not searched. ``kept`` and ``spans`` replace columns of these names;
    ``_id`` and ``_ranges`` are dropped.
    """
    docs = docs.drop("kept", "spans", "_id", "_ranges")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    ranges = _per_document(repeated_windows(texts, length), "low", "width")
    ranges = ranges.select(F.col("doc_id").alias("_id"), F.col("ranges").alias("_ranges"))
    joined = docs.join(ranges, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    at, last = docs.columns.index("text"), len(docs.columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def cut(batches):
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for start, end in sorted((r["low"], r["low"] + r["width"] + length - 1) for r in found or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(kept, pa.binary()), pa.array(spans, kind)],
                names=[*batch.schema.names[:last], "kept", "spans"],
            )

    return joined.mapInArrow(trimmed(cut), schema + ", kept binary, spans array<struct<start: long, end: long>>")
