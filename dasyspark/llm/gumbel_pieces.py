"""Sampling distinct segmentations of a text without replacement, and decoding them.

All segmentations of a text into vocabulary pieces form a lattice; a piece weighs
in by Zipf's law of its rank in the vocabulary. Gumbel top-k draws k distinct
segmentations as if one after another without replacement: the k largest of their
log probabilities with Gumbel noise. They are found by A* search. A set of
segmentations is a region: all that agree with a known one up to some chunk and
differ there. The noisy maximum of a region depends only on its total mass, so a
region's bound is drawn exactly, below its parent's, and opened only if it is the
largest left. Opening draws the segmentation that attains the bound and splits
the rest. The bound left after k is the threshold for the inclusion scores.

Pieces never cross from a word into the next one's spaces, so the lattice of a
text is a chain of chunks (spaces and a word), whose lattices are built once for
each distinct chunk. Noise comes from a hash of the row's key, so a row always
gets the same samples.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from dasyspark.llm.common import mix, pieces

CHUNK = re.compile(" *[^ ]+| +")
MOST_CHUNKS = 60_000
TINY = 1e-16  # mass of what is left but lost in rounding


class Vocabulary:
    """Pieces of a model file, spaces as they are, with log weights; single bytes for what has no piece."""

    def __init__(self, path: str, power: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i).replace("▁", " ") for i in range(size)]
        self.bytes = {}
        self.pieces: dict[str, int] = {}
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(self.text[i][3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[self.text[i]] = i
        first = len(self.bytes) + 3
        self.weight = [-power * float(np.log(1 + max(0, i - first))) for i in range(size)]
        self.byte_weight = -power * float(np.log(size))
        self.longest = max(map(len, self.pieces), default=1)
        self.values = {i: bytes([b]) for b, i in self.bytes.items()}
        self.weights = np.array(self.weight)
        self.byte_ids = np.array([self.bytes[b] for b in range(256)])
        # A trie: from a state (0: nothing read) by a code point to the next one, and the piece read there, if any.
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for text, i in self.pieces.items():
            state = 0
            for c in text:
                state = steps.setdefault(state << 21 | ord(c), len(steps) + 1)
            ends[state] = i
        # Steps lie in a table by their hash, each in the first free slot from there.
        bits = (4 * len(steps) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.after = np.full(1 << bits, -1), np.full(1 << bits, -1)
        for (step, state), slot in zip(steps.items(), self._slot(np.array(list(steps), np.int64)).tolist(), strict=True):
            while self.slots[slot] >= 0:
                slot = slot + 1 & self.mask
            self.slots[slot], self.after[slot] = step, state
        self.piece_at = np.full(len(steps) + 1, -1)
        self.piece_at[list(ends)] = list(ends.values())

    def _slot(self, step: np.ndarray) -> np.ndarray:
        return (step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after reading a code point each; -1 where no piece goes on like that."""
        wanted = state << 21 | code
        slot = self._slot(wanted)
        there = self.slots[slot]
        other = np.flatnonzero((there != wanted) & (there >= 0))
        while len(other):
            slot[other] = slot[other] + 1 & self.mask
            there = self.slots[slot[other]]
            other = other[(there != wanted[other]) & (there >= 0)]
        return np.where(self.slots[slot] == wanted, self.after[slot], -1)

    def decode(self, ids) -> str:
        """The text of a sequence of ids; the leading space that every text gets is taken off."""
        out = b"".join(self.values.get(i) or self.text[i].encode("utf-8", "surrogatepass") for i in ids)
        return out.decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, power: float = 1.0) -> Vocabulary:
    return Vocabulary(path, power)


class Lattices:
    """Lattices of chunks in flat arrays: nodes are numbered through, each node's incoming edges lie together.

    ``share`` holds the cumulative probability of a node's edges, above 1 for the last
    one, so that a walk over them finds the edge of a uniform number. The new chunks of a batch are built
    together: their substrings walk the vocabulary's trie a character at a time, and
    the masses of all nodes at one place of their chunk are summed at once.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes = 0
        kinds = (float, np.int64, np.int32, float, np.int64, np.int64, float, float, np.int64, np.int64)
        self.edges = 0
        self.made: list[list[np.ndarray]] = [[np.empty(0, kind)] for kind in kinds]

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk, its lattice built if it is new."""
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if fresh:
            self._build(fresh)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def _build(self, chunks: list[str]) -> None:
        v = self.vocab
        size = np.array([len(c) for c in chunks], np.int64)
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        stop = np.cumsum(size)
        place = np.arange(len(code)) - (stop - size)[owner]
        left = size[owner] - place

        # Pieces that start at a character, by length.
        at, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        froms, lengths, pieces_ = [], [], []
        for depth in range(v.longest):
            live = left[at] > depth
            at, state = at[live], state[live]
            state = v.step(state, code[at + depth])
            live = state >= 0
            at, state = at[live], state[live]
            piece = v.piece_at[state]
            whole = piece >= 0
            froms.append(at[whole])
            lengths.append(np.full(len(froms[-1]), depth + 1))
            pieces_.append(piece[whole])

        # Characters without a piece are written in bytes, with a node between two of them.
        bare = np.ones(len(code), bool)
        bare[froms[0]] = False
        bare = np.flatnonzero(bare)
        many = 1 + (code[bare] >= 0x80) + (code[bare] >= 0x800) + (code[bare] >= 0x10000)
        inner = np.bincount(owner[bare], many - 1, len(size)).astype(np.int64)
        room = size + 1 + inner
        base = np.cumsum(room) - room
        node = base[owner] + place  # of the place before a character
        before = np.cumsum(many - 1) - (many - 1)
        first = (base + size + 1 - (np.cumsum(inner) - inner))[owner[bare]] + before
        char = np.repeat(np.arange(len(bare)), many)
        nth = np.arange(len(char)) - (np.cumsum(many) - many)[char]
        raw = code[bare].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        last = nth == many[char] - 1
        source = node[bare][char]

        # An edge leads from ``pred`` to ``goal``; ``origin`` is the place its character starts at, ``mass`` the weight since.
        starts, length = np.concatenate(froms), np.concatenate(lengths)
        piece = np.concatenate([*pieces_, v.byte_ids[np.frombuffer(raw, np.uint8)]])
        weight = v.weights[piece]
        weight[len(starts):] = v.byte_weight
        goal = np.concatenate([node[starts] + length, np.where(last, source + 1, first[char] + nth)])
        pred = np.concatenate([node[starts], np.where(nth == 0, source, first[char] + nth - 1)])
        origin = np.concatenate([node[starts], source])
        mass = np.concatenate([weight[: len(starts)], (nth + 1) * v.byte_weight])
        span = np.concatenate([length, np.ones(len(char), np.int64)])
        order = np.argsort(goal * (v.longest + 1) + v.longest - span, kind="stable")
        goal, pred, piece, weight, origin, mass = (x[order] for x in (goal, pred, piece, weight, origin, mass))

        n = int(room.sum())
        degree = np.bincount(goal, minlength=n)
        begin = np.cumsum(degree) - degree
        total, ways, share = np.zeros(n), np.ones(n), np.ones(len(goal))
        by = np.argsort(-size, kind="stable")
        tall = len(size) - np.searchsorted(np.sort(size), np.arange(1, size.max() + 1))
        for j, some in enumerate(tall.tolist(), 1):
            here = base[by[:some]] + j
            d = degree[here]
            cut = np.cumsum(d) - d
            edge = np.repeat(begin[here] - cut, d) + np.arange(d.sum())
            score = total[origin[edge]] + mass[edge]
            top = np.maximum.reduceat(score, cut)
            odds = np.exp(score - np.repeat(top, d))
            whole = np.add.reduceat(odds, cut)
            total[here] = top + np.log(whole)
            with np.errstate(over="ignore"):
                ways[here] = np.add.reduceat(ways[origin[edge]], cut)
            share[edge] = odds / np.repeat(whole, d)
        ways[(first[char] + nth)[~last]] = ways[source[~last]]
        for r in range(1, int(degree.max())):
            edge = begin[degree > r] + r
            share[edge] += share[edge - 1]
        ending = begin[degree > 0] + degree[degree > 0] - 1
        share[ending] = 2.0
        new = (
            share, self.nodes + pred, piece.astype(np.int32), weight, self.nodes + base, self.nodes + base + size, total[base + size], ways,
            self.edges + begin, degree,
        )
        for held, x in zip(self.made, new, strict=True):
            held.append(x)
        self.nodes += n
        self.edges += len(goal)

    def ready(self) -> tuple[np.ndarray, ...]:
        """share, predecessors, pieces and weights of edges; start, end and mass of chunks; paths that reach a node, its first edge and their number."""
        for held in self.made:
            if len(held) > 1:
                held[:] = [np.concatenate(held)]
        return tuple(held[0] for held in self.made)


def seeded(seed: np.ndarray, *counters) -> np.ndarray:
    """A 64-bit seed from another one and counters."""
    x = np.asarray(seed, np.uint64)
    for c in counters:
        x = mix(x + np.asarray(c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return x


def uniform(seed: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) from a 64-bit seed and counters."""
    return ((seeded(seed, *counters) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def draw(lattices: Lattices, chunk: np.ndarray, seed: np.ndarray, place: np.ndarray, round_: int):
    """A segmentation of each chunk, drawn by its probability: all pieces in order, where each chunk's end, and log probabilities."""
    share, pred, piece, weight, start, end, mass, _, begin, _ = lattices.ready()
    cur, token = end[chunk], np.arange(len(chunk))
    logp = -mass[chunk]
    out = []
    goal, seed = start[chunk], seeded(seed, place, round_)
    size = np.zeros(len(chunk), np.int64)
    while len(token):
        at, edge = uniform(seed[token], len(out)), begin[cur]
        # The last share of a node is above 1, so rounding cannot leave the node.
        further = np.flatnonzero(share[edge] <= at)
        while len(further):
            edge[further] += 1
            further = further[share[edge[further]] <= at[further]]
        out.append((token, piece[edge]))
        logp[token] += weight[edge]
        size[token] += 1
        cur = pred[edge]
        kept = cur != goal[token]
        token, cur = token[kept], cur[kept]
    stop = np.cumsum(size)
    found = np.empty(int(size.sum()), np.int32)
    for step, (token, ids) in enumerate(out):  # from the end of each chunk
        found[stop[token] - 1 - step] = ids
    return found, stop, logp


def draw_other(lattices: Lattices, chunk: int, known: list[tuple], seed: np.uint64, place: int, round_: int):
    """A segmentation of one chunk other than the known ones (tuples of pieces), and its log probability."""
    share, pred, piece, weight, start, end, mass, ways, begin, degree = lattices.ready()
    cur, goal = int(end[chunk]), int(start[chunk])
    # A character takes at most four steps.
    most = 4 * (cur - goal)
    at_step = uniform(np.full(most, seeded(np.uint64([seed]), place, round_)[0]), np.arange(most)).tolist()

    def edges(node: int) -> list[tuple[int, float, int, int, float]]:
        """(piece, probability, place before, paths there, weight) of a node's edges."""
        e = slice(int(begin[node]), int(begin[node] + degree[node]))
        runs = share[e].tolist()
        odds = [min(x, 1.0) - y for x, y in zip(runs, [0.0, *runs], strict=False)]
        return list(zip(piece[e].tolist(), odds, pred[e].tolist(), ways[pred[e]].tolist(), weight[e].tolist(), strict=True))

    path: list[int] = []
    logp = -float(mass[chunk])

    def chance(left: tuple, node: int) -> float:
        """Probability of finishing with exactly these pieces (from the end) at a node."""
        p = 1.0
        for want in left:
            hit = next((e for e in edges(node) if e[0] == want), None)
            if hit is None:
                return 0.0
            p *= hit[1]
            node = hit[2]
        return p

    live = [tuple(reversed(k)) for k in known]
    while cur != goal:
        room, ways_on = [], edges(cur)
        for name, p, before, paths, _ in ways_on:
            taken = [x[1:] for x in live if x and x[0] == name]
            gone = sum(chance(x, before) for x in taken)
            # Counting says whether anything is left; its mass may be below rounding.
            room.append(p * max(TINY, 1.0 - gone) if paths > len(taken) else 0.0)
        at, e = at_step[len(path)] * sum(room), 0
        for e, run in enumerate(itertools.accumulate(room)):
            if run > at:
                break
        while room[e] == 0.0 and e > 0:
            e -= 1
        name, _, cur, _, own = ways_on[e]
        live = [x[1:] for x in live if x and x[0] == name]
        path.append(name)
        logp += own
    return tuple(reversed(path)), logp


class Paths:
    """The pieces of the chunks of a text, one after another; ``stop``: where each chunk's end."""

    def __init__(self, ids: np.ndarray, stop: np.ndarray):
        self.ids, self.stop = ids, stop

    def begin(self, i: int) -> int:
        return int(self.stop[i - 1]) if i else 0

    def __getitem__(self, i: int) -> tuple:
        if i >= len(self.stop):
            raise IndexError(i)
        return tuple(self.ids[self.begin(i) : self.stop[i]].tolist())

    def with_other(self, i: int, other: tuple, rest: "Paths") -> "Paths":
        """These pieces up to chunk ``i``, others for it, and the rest."""
        at = self.begin(i)
        ids = np.concatenate([self.ids[:at], np.array(other, np.int32), rest.ids])
        return Paths(ids, np.concatenate([self.stop[:i], [at + len(other)], at + len(other) + rest.stop]))


class Row:
    """The search of one text: its found segmentations and the regions still closed."""

    def __init__(self, chunks: np.ndarray, seed: int):
        self.chunks, self.seed = chunks, np.uint64(seed)
        self.found: list[dict] = []
        self.heap: list[tuple] = []
        self.counter = self.pushed = 0

    def keep(self, paths: Paths, logp: np.ndarray, g: float) -> int:
        self.found.append({"paths": paths, "logp": logp, "g": g})
        return len(self.found) - 1


def push(regions: list[tuple], most: int) -> None:
    """Regions (row, masses, limit, sequence, first, without), for all rows at once.

    They leave ``sequence`` of their row at chunk first, first + 1, ...; the first also without
    other segmentations. No more than the ``most`` largest of a row can still be opened or
    give the threshold; the others are not kept.
    """
    sizes = [len(masses) for _, masses, *_ in regions]
    stops = np.cumsum(sizes)
    seed, counter, limit = (
        np.repeat(np.array(x, kind), sizes)
        for x, kind in (([r[0].seed for r in regions], np.uint64), ([r[0].counter for r in regions], np.int64), ([r[2] for r in regions], float))
    )
    place = np.arange(len(seed)) - np.repeat(stops - sizes, sizes)
    every = noisy(np.concatenate([r[1] for r in regions]), limit, uniform(seed, place, 1 << 20, counter))
    for (row, _, _, sequence, first, without), size, stop in zip(regions, sizes, stops.tolist(), strict=True):
        row.counter += 1
        bounds = every[stop - size : stop]
        at = np.argpartition(-bounds, most - 1)[:most] if size > most else np.arange(size)
        for i, g in sorted(zip(at.tolist(), bounds[at].tolist(), strict=True)):
            if g > -np.inf:
                heapq.heappush(row.heap, (-g, row.pushed, sequence, first + i, without if i == 0 else []))
                row.pushed += 1


def noisy(mass: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Noisy maxima of regions of these log masses by uniform numbers, given that they lie below ``limit``."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        free = mass - np.log(-np.log(u))
        return np.where(np.isneginf(mass), -np.inf, np.where(np.isposinf(limit), free, _below(free, limit)))


def _below(free: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """-log(exp(-limit) + exp(-free)) without overflow."""
    low = np.minimum(free, limit)
    return low - np.log1p(np.exp(-np.abs(free - limit)))


def sample_batch(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[Row]:
    """The k best segmentations of each text, in falling order of their noisy log probabilities."""
    if len(lattices.known) > MOST_CHUNKS:
        lattices.clear()
    cut = [CHUNK.findall(" " + t) if t else [] for t in texts]
    number = lattices.numbers([c for chunks in cut for c in chunks])
    stops = np.cumsum([len(chunks) for chunks in cut]).tolist()
    rows = [Row(number[e - len(c) : e], s) for c, e, s in zip(cut, stops, seeds.tolist(), strict=True)]
    if rows:
        push([(row, np.zeros(1), np.inf, -1, 0, []) for row in rows], 1)
    every = lattices.ready()
    for turn in range(k):
        jobs = []
        for row in rows:
            if row.heap:
                jobs.append((row, heapq.heappop(row.heap)))
        if not jobs:
            break
        # All chunks after the place of departure are drawn anew, for all rows at once.
        begin = [place + (sequence >= 0) for _, (_, _, sequence, place, _) in jobs]
        chunk = np.concatenate([row.chunks[b:] for (row, _), b in zip(jobs, begin, strict=True)])
        sizes = [len(row.chunks) - b for (row, _), b in zip(jobs, begin, strict=True)]
        seed = np.repeat(np.array([row.seed for row, _ in jobs], np.uint64), sizes)
        place = np.concatenate([np.arange(b, len(row.chunks)) for (row, _), b in zip(jobs, begin, strict=True)])
        regions = []
        found, stop, logp = draw(lattices, chunk, seed, place, turn)
        at = 0
        for (row, (g, _, sequence, where, without)), size in zip(jobs, sizes, strict=True):
            low = int(stop[at - 1]) if at else 0
            fresh_stop, fresh_logp = stop[at : at + size] - low, logp[at : at + size]
            fresh = Paths(found[low : low + (int(fresh_stop[-1]) if size else 0)], fresh_stop)
            at += size
            if sequence < 0:
                paths, own = fresh, fresh_logp
            else:
                old = row.found[sequence]
                known = [*without, old["paths"][where]]
                other, p = draw_other(lattices, int(row.chunks[where]), known, row.seed, where, (turn << 8) + 255)
                paths = old["paths"].with_other(where, other, fresh)
                own = np.concatenate((old["logp"][:where], [p], fresh_logp))
            number = row.keep(paths, own, -g)
            if not len(own):
                continue
            before = np.concatenate(([0.0], np.cumsum(own)[:-1]))
            with np.errstate(divide="ignore"):
                ways = every[7][every[5][row.chunks]]
                rest = before + np.log(np.where(ways > 1, np.maximum(TINY, -np.expm1(own)), 0.0))
                if sequence >= 0:
                    # The rest of the opened region at its own chunk: without everything drawn there so far.
                    taken = np.exp(own[where]) + sum(np.exp(_logp_of(lattices, int(row.chunks[where]), x)) for x in known)
                    rest[where] = before[where] + np.log(max(TINY, 1.0 - taken)) if ways[where] > len(known) + 1 else -np.inf
                    regions.append((row, rest[where:], -g, number, where, known))
                else:
                    regions.append((row, rest, -g, number, 0, []))
        if regions:
            push(regions, k - turn)
    return rows


def _logp_of(lattices: Lattices, chunk: int, path: tuple) -> float:
    return float(sum(lattices.vocab.byte_weight if i in lattices.vocab.values else lattices.vocab.weight[i] for i in path) - lattices.ready()[6][chunk])


SCHEMA = "sample int, ids array<int>, log_prob double, perturbed double, inclusion double"


def sample_segmentations(
    docs: DataFrame, path: str, k: int = 2, key: str = "doc_id", text: str = "text", power: float = 1.0, seed: int = 0
) -> DataFrame:
    """Up to ``k`` rows for every row of ``docs``: its key, and distinct segmentations in sampled order.

    ``log_prob`` is the natural log probability of a segmentation, ``perturbed``
    that with its noise, and ``inclusion`` the probability of being among the
    sampled ones given the threshold, 1 where all segmentations are listed. A null
    or empty text has one, the empty one. Rows of one key and text get the same
    samples; a null key is seeded like the text "None". Other columns are ignored.
    """
    def run(batches):
        lattices = Lattices(vocabulary(path, power))
        for batch in batches:
            for part in pieces(batch, 1_000_000):
                keys = part.column(0).to_pylist()
                texts = [t or "" for t in part.column("text").to_pylist()]
                seeds = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{x}".encode()) for x in keys], np.uint64)
                out: dict[str, list] = {c: [] for c in ("key", "sample", "ids", "log_prob", "perturbed", "inclusion")}
                for name, row in zip(keys, sample_batch(lattices, texts, mix(seeds), k), strict=True):
                    limit = -row.heap[0][0] if row.heap else -np.inf
                    for i, s in enumerate(row.found):
                        logp = float(s["logp"].sum())
                        out["key"].append(name)
                        out["sample"].append(i + 1)
                        out["ids"].append(s["paths"].ids)
                        out["log_prob"].append(logp)
                        out["perturbed"].append(s["g"])
                        out["inclusion"].append(float(-np.expm1(-np.exp(min(700.0, logp - limit)))) if limit > -np.inf else 1.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["key"], part.schema.field(0).type), pa.array(out["sample"], pa.int32()),
                     pa.array(out["ids"], pa.list_(pa.int32())),
                     *(pa.array(out[c], pa.float64()) for c in ("log_prob", "perturbed", "inclusion"))],
                    names=[key, "sample", "ids", "log_prob", "perturbed", "inclusion"],
                )

    chosen = docs.selectExpr(f"`{key}`", f"CAST(`{text}` AS STRING) AS text")
    return chosen.mapInArrow(run, f"`{key}` {chosen.dtypes[0][1]}, {SCHEMA}")


def decode_segmentations(samples: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids of every row; null ids give null, no ids the empty text."""
    samples = samples.drop("decoded")
    at = samples.columns.index(ids)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return samples.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in samples.dtypes) + ", decoded string")
