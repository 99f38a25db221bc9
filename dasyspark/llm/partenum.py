"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sets fall into bands of sizes so that two similar sets lie in one band or in
neighbours. For a pair of bands the threshold bounds the size k of the symmetric
difference. The shingle domain is hashed into n1 parts of n2 cells each, with n1
so large that some part differs in at most k2 shingles; then n2 - k2 of its cells
agree, and the signature of that subset of cells is shared. Every subset of every
part is enumerated, so two sets that are similar enough always share a signature.

Empty subsets are no signatures: they would join all short sets. Some parts are
held in reserve for them; a set with more parts touched by empty subsets than
that also signs under another hashing, at the last one with its empty subsets
too. A pair that only meets in empty subsets has both its sets in that case.

Equal sets are one node from the start. Sets that share signatures make
candidate groups; large ones are told apart by further signings with larger
subsets, each under another hashing. A group is checked in blocks of bounded size against its most frequent
members first, and then only what is still apart is compared, so that a
tight group of any size costs little more than its members.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.llm.common import join_small, map_batches, mix, pieces, shuffle_partitions, trimmed
from dasyspark.llm.components import Forest, connected
from dasyspark.session import discard, materialize

LEVELS = 3
BLOCK, HUBS, REFININGS = 768, 16, 4
SIGNATURES_PER_BUCKET = 1_500_000
PAIRS_PER_TASK = 2_000_000


# ----------------------------------------------------------------- shingles


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased.

    Fewer words than ``width`` make one shingle of the whole sequence; no words, none.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII case and exactly the blanks \x20, \t to \r
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = mix(h[: len(h) - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def node_of(shingles: np.ndarray) -> int | None:
    """Identity of a set, an even number of 64 bits; None for the empty one."""
    if not len(shingles):
        return None
    return (xxhash.xxh3_64_intdigest(shingles.tobytes()) << 1) % 2**64 - 2**63


# ------------------------------------------------------------------ signing


@functools.lru_cache(maxsize=4096)
def scheme(band: int, num: int, den: int, slack: int, keep: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for pairs of bands ``band`` and ``band + 1``."""
    low, high = band_limits(band, num, den)
    k = (den - num) * (high + high * den // num) // (den + num)
    k2 = min(slack, k)
    n2 = k2 + keep
    needed = k // (k2 + 1) + 1
    if needed < 8:
        return needed, n2, k2, 0
    spare = 0
    for _ in range(4):
        parts = needed + spare
        dead = parts * math.comb(n2, keep) * math.exp(-keep * low / (parts * n2))
        spare = min(needed // 3, math.ceil(dead + 3 * math.sqrt(dead)))
    return needed + spare, n2, k2, spare


@functools.lru_cache(maxsize=65536)
def band_limits(band: int, num: int, den: int) -> tuple[int, int]:
    low = 1 if band == 0 else band_limits(band - 1, num, den)[1] + 1
    return low, low * den // num


@functools.lru_cache(maxsize=65536)
def band_of(size: int, num: int, den: int) -> int:
    band = 0
    while band_limits(band, num, den)[1] < size:
        band += 1
    return band


def signatures(shingles: np.ndarray, num: int, den: int, slack: int = 1, keep: int = 1) -> np.ndarray:
    """All signatures of one non-empty set, for its band and the one below."""
    return np.concatenate([s for _, s in signatures_by_band(shingles, num, den, slack, keep)])


def signatures_by_band(
    shingles: np.ndarray, num: int, den: int, slack: int, keep: int, seed: int = 0
) -> list[tuple[int, np.ndarray]]:
    """(0, signatures with the band below) and (1, signatures with the band above); the lowest band has no 0."""
    own = band_of(len(shingles), num, den)
    bands = []
    for band in sorted({own, max(0, own - 1)}):
        out = []
        n1, n2, k2, spare = scheme(band, num, den, slack, keep)
        for level in range(LEVELS):
            salt = mix(np.uint64([(seed << 32) + band * 64 + level + 1]))[0]
            h = mix(shingles ^ salt)
            cell = ((h >> np.uint64(32)) % np.uint64(n1 * n2)).astype(np.int64)
            total = np.zeros(n1 * n2, np.uint64)
            np.add.at(total, cell, h)
            count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
            total = total.reshape(n1, n2)
            dead = np.zeros(n1, bool)
            for number, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
                cols = list(subset)
                there = count[:, cols].sum(axis=1) > 0
                # Which cells are filled, and with what, for this part and subset.
                sums = total[:, cols[0]]
                for c in cols[1:]:
                    sums = mix(sums) + total[:, c]
                made = mix(sums + mix(np.arange(n1, dtype=np.uint64) * np.uint64(1024) + np.uint64(number)) + salt)
                dead |= ~there
                out.append(made if level == LEVELS - 1 else made[there])
            if dead.sum() <= spare:
                break
        bands.append((int(band == own), np.concatenate(out)))
    return bands


BLOBS = "bucket int, nodes binary, at binary, high binary, low binary"


def blobs(sig: np.ndarray, owner: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket of these (signature, node) pairs."""
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sig, owner, bucket = sig[order] >> np.uint64(16), owner[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: dict[str, list] = {"bucket": [], "nodes": [], "at": [], "high": [], "low": []}
    for b in np.flatnonzero(np.diff(cuts)):
        here = slice(cuts[b], cuts[b + 1])
        found, at = np.unique(owner[here], return_inverse=True)
        rows["bucket"].append(int(b))
        rows["nodes"].append(found.tobytes())
        rows["at"].append(at.astype(np.uint32 if len(found) > 65_535 else np.uint16).tobytes())
        rows["high"].append((sig[here] >> np.uint64(16)).astype(np.uint32).tobytes())
        rows["low"].append((sig[here] & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
    return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in list(rows)[1:])]))


def sign(docs: DataFrame, width: int, num: int, den: int, buckets: int, slack: int, keep: int) -> DataFrame:
    """Blobs of (signature, node) by bucket; a set seen before in the task does not sign again."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch):
                nodes, signed = [], []
                for text in part.column("text").to_pylist():
                    s = shingle_hashes(text, width)
                    node = node_of(s)
                    if node is not None and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        signed.append(signatures(s, num, den, slack, keep))
                if not nodes:
                    continue
                yield blobs(
                    np.concatenate(signed), np.repeat(np.array(nodes, np.int64), [len(x) for x in signed]), buckets
                )

    return docs.select("text").where("text IS NOT NULL").mapInArrow(
        trimmed(run), BLOBS
    )


def refine(rows: DataFrame, num: int, den: int, buckets: int, seed: int) -> DataFrame:
    """Groups of rows (member, node, root, shingles) told apart by an independent signing with larger subsets, written.

    Similar sets share a signature under any hashing, so only chance meetings fall
    apart, and another ``seed`` tells apart what met by chance under this one. Here a
    group also stays within two neighbouring bands: a set takes part once with the
    band below and once with the one above, as member node and node + 1. A null member
    stands for both. Gives (member, node, root, degree, shingles) of rows that still meet another.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sigs, owners = [], []
            for member, node, root, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = mix(np.array([root], np.int64).astype(np.uint64))
                for upper, sig in signatures_by_band(np.frombuffer(raw, np.uint64), num, den, 1, 3, seed=seed):
                    if member is None or member == node + upper:
                        sigs.append(mix(sig ^ inside))
                        owners.append(np.full(len(sig), node + upper))
            if sigs:
                yield blobs(np.concatenate(sigs), np.concatenate(owners), buckets)

    met = meetings(rows.select("member", "node", "root", "shingles").mapInArrow(trimmed(run), BLOBS), buckets, "refined")
    groups = connected(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = met.groupBy("node").agg(F.sum("degree").alias("degree"))
    members = materialize(groups.join(degrees, "node").withColumnRenamed("node", "_member"), "members")
    own = F.col("node") == F.col("_member").bitwiseAND(F.lit(-2))
    on = own & F.coalesce(F.col("member") == F.col("_member"), F.lit(True))
    found = join_small(rows.select("member", "node", "shingles"), members, on, "inner", 48)
    return materialize(found.select(F.col("_member").alias("member"), "node", "root", "degree", "shingles"), "wide")


def meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a bucket that share signatures, as a forest: one row of packed nodes, roots and degrees."""
    sig, node = [], []
    for nodes, at, high, low in zip(pdf["nodes"], pdf["at"], pdf["high"], pdf["low"], strict=True):
        found = np.frombuffer(nodes, np.int64)
        node.append(found[np.frombuffer(at, np.uint32 if len(found) > 65_535 else np.uint16)])
        sig.append(np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(low, np.uint16))
    sig, node = np.concatenate(sig), np.concatenate(node)
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = sig[1:] == sig[:-1]
    shared = np.zeros(len(sig), bool)
    shared[1:] |= same
    shared[:-1] |= same
    sig, node = sig[shared], node[shared]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    names, at = np.unique(node, return_inverse=True)
    forest = Forest(len(names))
    first = np.repeat(at[starts], sizes)
    links = np.unique(np.stack([first, at]), axis=1) if len(at) else np.empty((2, 0), np.int64)
    for i, j in links.T.tolist():
        forest.join(i, j)
    roots = forest.roots()
    degree = np.bincount(at, np.repeat(sizes - 1, sizes), len(names)).astype(np.int64)
    kept = degree > 0
    packed = {"nodes": names[kept], "roots": names[roots[kept]], "degrees": degree[kept]}
    return pd.DataFrame({c: [v.astype(np.int64).tobytes()] for c, v in packed.items()} if kept.any() else {c: [] for c in packed})


def joined_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of ``n`` places under the links (a, b)."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def meetings(signed: DataFrame, buckets: int, label: str) -> DataFrame:
    """(node, root, degree) of sets that share signatures, written.

    Similar sets meet in many buckets. What a bucket finds stays packed in one row, and a task
    joins all that its buckets found, so that a set makes one row a task, however many
    signatures it shares. The number of tasks follows the volume.
    """
    met = materialize(
        signed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "nodes binary, roots binary, degrees binary"),
        f"{label}-buckets",
    )
    pairs = (met.agg(F.sum(F.octet_length("nodes"))).first()[0] or 0) // 8

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        nodes, roots, degrees = (
            np.concatenate([np.frombuffer(x, np.int64) for batch in held for x in batch[c]]) for c in ("nodes", "roots", "degrees")
        )
        names, at = np.unique(np.concatenate([nodes, roots]), return_inverse=True)
        a, b = at[: len(nodes)], at[len(nodes) :]
        root = joined_roots(a, b, len(names))
        yield pd.DataFrame({"node": names, "root": names[root], "degree": np.bincount(a, degrees, len(names)).astype(np.int64)})

    tasks = met.coalesce(int(pairs // PAIRS_PER_TASK) + 1)
    return materialize(tasks.mapInPandas(trimmed(join), "node long, root long, degree long"), label)


# ------------------------------------------------------------- verification


def link(sets: list[np.ndarray], asks: np.ndarray, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the rows that ask and all others, as a forest over rows.

    Rows of one label are joined already. A row is only compared while some other
    row is still apart from it, which loses no component.
    """
    m = len(sets)
    forest = Forest(m)
    first: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):
        forest.join(first.setdefault(x, i), i)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, value = np.unique(values, return_inverse=True)
    order = np.argsort(value, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(value[order], np.arange(value.max() + 2)) if len(value) else np.zeros(1, np.int64)
    ends = np.cumsum(sizes)
    made = []
    for q in np.flatnonzero(asks).tolist():
        roots = forest.roots() if m <= 64 else None
        if roots is not None and (roots == roots[q]).all():
            continue
        mine = value[ends[q] - sizes[q] : ends[q]]
        length = begin[mine + 1] - begin[mine]
        offset = np.repeat(begin[mine] - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        common = np.bincount(posting[np.arange(length.sum()) + offset], minlength=m)
        near = den * common >= num * (sizes + sizes[q] - common)
        near[q] = False
        for t in np.flatnonzero(near).tolist():
            if forest.join(q, t):
                made.append((q, t))
    return made


def verify(rows: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Edges (a, b) among rows (node, ask, label, shingles) of one key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Rows that repeat a doc_id send their set again.
        pdf = pdf.sort_values(["ask", "degree", "node"], ascending=[False, False, True], kind="stable").drop_duplicates("node")
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        found = link(sets, pdf["ask"].to_numpy(bool), pdf["label"].to_numpy(), num, den)
        node = pdf["node"].to_numpy()
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[ends[:, 0]], "b": node[ends[:, 1]]})

    return rows.groupBy(*keys).applyInPandas(run, "a long, b long")


def link_candidates(candidates: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Edges whose components are those of all links among candidate nodes (node, doc_id, root, degree)."""

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("root").agg(F.count("*").alias("size")), "root")

    placed = materialize(sized(candidates), "candidates")
    texts = join_small(docs.select("doc_id", "text"), placed, "doc_id", "inner", 64)
    sets = materialize(
        map_batches(
            texts.select("node", "root", "degree", "size", "text"),
            lambda batch: (
                {
                    **{c: part.column(c) for c in ("node", "root", "degree", "size")},
                    "shingles": [shingle_hashes(t, width).tobytes() for t in part.column("text").to_pylist()],
                }
                for part in pieces(batch)
            ),
            "node long, root long, degree long, size long, shingles binary",
        ),
        "sets",
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")

    def whole(rows: DataFrame) -> DataFrame:
        few = rows.where(F.col("size") <= BLOCK)
        return few.withColumns({"ask": F.lit(True), "label": F.col("node"), "block": F.lit(0)})

    small = whole(sets)
    if not placed.where(F.col("size") > BLOCK).limit(1).count():
        edges = materialize(verify(small, ["root", "block"], num, den), "links")
        discard(sets)
        return edges
    # Large groups are told apart anew as long as that leaves less of them.
    large, left, held = sets.where(F.col("size") > BLOCK).withColumn("member", F.lit(None).cast("long")), None, [sets]
    for seed in range(1, REFININGS + 1):
        wide = refine(large, num, den, shuffle_partitions(docs.sparkSession), seed)
        sizes = materialize(wide.groupBy("root").agg(F.count("*").alias("size")), "sizes")
        held.append(wide)
        wide = join_small(wide, sizes, "root", "inner", 32)
        small = small.unionByName(whole(wide.drop("member")))
        large = wide.where(F.col("size") > BLOCK)
        before, left = left, sizes.where(F.col("size") > BLOCK).agg(F.sum("size")).first()[0] or 0
        if not left or before and left > 0.7 * before:
            break
    if not left:
        edges = materialize(verify(small, ["root", "block"], num, den), "links")
        discard(*held)
        return edges
    placed = large.drop("shingles")
    # Those that stay large: the most frequent member of each of some slots against blocks of all.
    hubs = (
        placed.groupBy("root", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("slot"))
        .agg(F.expr("max_by(node, struct(degree, node))").alias("hub"))
        .groupBy("root").agg(F.collect_list("hub").alias("hubs"))
    )
    hubs = materialize(hubs, "hubs")
    with_hubs = join_small(large.drop("member"), hubs, "root", "inner", 16 * HUBS)
    with_hubs = materialize(with_hubs.withColumn("ask", F.array_contains("hubs", F.col("node"))).drop("hubs"), "hubs")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = with_hubs.withColumns({
        "label": F.col("node"),
        "block": F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))),
    })
    edges = materialize(verify(small.unionByName(spread), ["root", "block"], num, den), "links")

    # What the hubs did not join with the main part of a large group asks all of the group.
    labels = connected(edges).select("node", F.col("root").alias("label"))
    known = with_hubs.drop("ask").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = (
        known.groupBy("root", "label").agg(F.count("*").alias("n"))
        .groupBy("root").agg(F.expr("max_by(label, struct(n, label))").alias("main"), F.sum("n").alias("all"),
                             (F.sum("n") - F.max("n")).alias("rest"))
    )
    known = join_small(known, materialize(main.where("rest > 0"), "main"), "root", "inner", 48)
    asks, targets = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    questions = known.where("label <> main").withColumns({
        "ask": F.lit(True), "qb": F.pmod(F.xxhash64("node"), asks).cast("int"),
        "tb": F.explode(F.sequence(F.lit(0), targets - 1)),
    })
    answers = known.withColumns({
        "ask": F.lit(False), "tb": F.pmod(F.xxhash64("node"), targets).cast("int"),
        "qb": F.explode(F.sequence(F.lit(0), asks - 1)),
    })
    both = materialize(verify(questions.unionByName(answers), ["root", "qb", "tb"], num, den), "links")
    discard(*held, with_hubs)
    return edges.unionByName(both)


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, slack: int = 1, keep: int = 1
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents are linked when ``den`` * |intersection| >= ``num`` * |union| of
    their sets of ``width``-word shingles; the component is named by its smallest
    doc_id. Documents without words have no shingles and stand alone. Rows without
    a doc_id get a null component and link with nothing; rows that repeat a doc_id
    should repeat its text, and each gets a row. Other columns are ignored.

    Sets are known by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")

    def describe(batch):
        for part in pieces(batch):
            sets = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
            yield {
                "doc_id": part.column("doc_id"), "n_shingles": [len(s) for s in sets], "node": [node_of(s) for s in sets],
            }

    members = materialize(map_batches(docs, describe, "doc_id long, n_shingles long, node long"), "members")
    volume = members.agg(F.sum("n_shingles")).first()[0] or 0
    # About one signature a shingle at 0.8, less above.
    buckets = max(shuffle_partitions(spark), volume // SIGNATURES_PER_BUCKET)
    nodes = members.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    shared = meetings(sign(named, width, num, den, buckets, slack, keep), int(buckets), "shared")
    groups = connected(shared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = shared.groupBy("node").agg(F.sum("degree").alias("degree"))
    candidates = groups.join(degrees, "node").join(nodes, "node")
    linked = connected(link_candidates(candidates, named, width, num, den))

    named_roots = linked.join(nodes, "node")
    smallest = named_roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    resolved = named_roots.select("node", "root").join(smallest, "root").select("node", "component_id")
    lone = nodes.select("node", F.col("doc_id").alias("first"))
    names = lone.join(resolved, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return members.join(names, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
