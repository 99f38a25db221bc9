"""Importance resampling toward a target distribution of hashed n-grams.

Runs of one to three words fall into 10,000 buckets by crc32. Bucket counts of the
target and of all documents give a gain for each bucket, an array of fixed size
that travels to the tasks and scores whole texts. Gumbel noise drawn from the key
turns "the k highest" into sampling without replacement. The cutoff is found by

* a quantile sketch that names a bracket of scores,
* exact counts above and inside it, which confirm the bracket or widen it, and
* a sort of the bracket alone, down to the one row that is drawn last.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dasyspark.llm.common import pieces
from dasyspark.session import materialize

BUCKETS, LONGEST, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
ACCURACY = 10_000  # of the sketch: ranks are off by a 10,000th of all rows at most
ROWS_PER_TASK = 500_000

# ------------------------------------------------------------------- buckets

# Words in bytes: a-z (A-Z folded), digits and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
# One step of the register over a byte b is (c >> 8) ^ STEP[(c ^ b) & 255].
_STEP = _CRC[np.arange(256) ^ 255] ^ np.uint32(0xFFFFFFFF) ^ np.uint32(0x00FFFFFF)


def _tables(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 from the images of the 32 bits under a linear map."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= images[8 * byte + bit]
    return out


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@functools.cache
def _near() -> np.ndarray:
    """Maps for 0 to 63 more bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_tables(bits)]
    for _ in range(63):
        bits = (bits >> np.uint32(8)) ^ _STEP[bits & 255]
        out.append(_tables(bits))
    return np.stack(out)


@functools.cache
def _far(k: int) -> np.ndarray:
    """The map for 64 * 2^k more bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k:
        return _tables(_apply(_far(k - 1), _apply(_far(k - 1), bits)))
    return _tables(_apply(_near()[63], _apply(_near()[1], bits)))


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What crc ``c`` of some bytes adds to the crc of those bytes and ``length`` more: crc(AB) = shifted(crc(A), |B|) ^ crc(B)."""
    near, low = _near(), length & 63
    out = near[low, 0, c & 255] ^ near[low, 1, c >> 8 & 255] ^ near[low, 2, c >> 16 & 255] ^ near[low, 3, c >> 24]
    high = length >> 6
    for k in range(int(high.max(initial=0)).bit_length()):
        rows = np.flatnonzero(high >> k & 1)
        out[rows] = _apply(_far(k), out[rows])
    return out


def buckets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the text and bucket of every feature of all texts."""
    number = defaultdict(count().__next__)
    split = [_WORD.findall(t.translate(_FOLD)) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    crc = np.fromiter(map(zlib.crc32, number), np.uint32, len(number))[ids]
    spaced = np.fromiter((zlib.crc32(b" ", zlib.crc32(w)) for w in number), np.uint32, len(number))[ids]
    length = np.fromiter(map(len, number), np.int64, len(number))[ids]
    doc = np.repeat(np.arange(len(split)), sizes)
    codes, owners, n = [crc], [doc], len(ids)
    # From a run of words and a space to the run with one more word, and to that with a space again.
    head = spaced
    for width in range(2, LONGEST + 1):
        after = np.arange(width - 1, n)
        head = head[: max(0, n - width + 1)]
        whole = doc[after] == doc[: len(after)] if len(after) else np.empty(0, bool)
        codes.append((shifted(head, length[after]) ^ crc[after])[whole])
        owners.append(doc[after][whole])
        if width < LONGEST:
            head = shifted(head, length[after] + 1) ^ spaced[after]
    return sizes, np.concatenate(owners), np.concatenate(codes).astype(np.int64) % BUCKETS


def _bytes(piece: pa.RecordBatch) -> list[bytes | None]:
    return piece.column("text").cast(pa.large_binary()).to_pylist()


def count_buckets(docs: DataFrame) -> DataFrame:
    """``bucket, n`` over all texts; a task sends at most one row for each bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(buckets_of(_bytes(piece))[2], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=schema)

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to document shares, for each of the 10,000 buckets."""
    both = count_buckets(docs).withColumn("aimed", F.lit(0)).unionByName(count_buckets(target).withColumn("aimed", F.lit(1)))
    s, t = [0] * BUCKETS, [0] * BUCKETS
    for row in both.collect():  # two rows a bucket at most
        (t if row["aimed"] else s)[row["bucket"]] = row["n"]
    all_s, all_t = sum(s) + BUCKETS, sum(t) + BUCKETS
    return np.array([math.floor(1000 * math.log(float((t[b] + 1) * all_s) / float((s[b] + 1) * all_t))) for b in range(BUCKETS)], np.int64)


WEIGHED = ("n_words", "n_features", "weight")


def weigh(docs: DataFrame, gain: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with words and features of each text and the sum of their gains.

    A null text has no words; columns named as the results are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = [c for c in (docs.columns if carry is None else carry) if c not in WEIGHED]
    fed = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = T.StructType([fed.schema[c] for c in carry] + [T.StructField(n, T.LongType()) for n in WEIGHED])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sizes, owner, bucket = buckets_of(_bytes(piece))
                weight = np.zeros(len(sizes), np.int64)
                np.add.at(weight, owner, gain[bucket])
                made = [sizes, np.bincount(owner, minlength=len(sizes)), weight]
                columns = [*(piece.column(c) for c in carry), *map(pa.array, made)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return fed.mapInArrow(run, schema)


def noise(key: Column, seed: int = 42) -> Column:
    """1000 times a standard Gumbel draw of ``<seed>:<key>``, floored; a null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


# -------------------------------------------------------------------- drawing


def numbered(df: DataFrame, order: list[Column], name: str, rows: int) -> DataFrame:
    """``df`` (of about ``rows`` rows) written with the place of each row, from 1, in a total order."""
    tasks = rows // ROWS_PER_TASK + 1
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = materialize(spread.withColumns({"_task": F.spark_partition_id(), "_at": at}), name)
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each task.
    offsets = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), "_task")
    return joined.withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_task", "_at", "_before")


def bracket(pool: DataFrame, wanted: int, rows: int, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int, int]:
    """Scores ``low, high`` between which the ``wanted``-th highest lies, and the exact rows above and inside.

    The sketch proposes, exact counts decide: a side that fails is moved out fourfold,
    at last to infinity (None).
    """
    share = 1 - wanted / rows
    below = above = 2 / accuracy
    while True:
        low_q, high_q = max(0.0, share - below), min(1.0, share + above)
        low, high = pool.agg(F.percentile_approx("score", [low_q, high_q], accuracy)).first()[0]
        low, high = (None if low_q == 0 else low), (None if high_q == 1 else high)
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        counts = pool.agg(F.count_if(over).alias("over"), F.count_if(~over & ~under).alias("inside")).first()
        if counts["over"] < wanted <= counts["over"] + counts["inside"]:
            return low, high, counts["over"], counts["inside"]
        if counts["over"] >= wanted:
            above *= 4
        else:
            below *= 4


def draw(
    scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, accuracy: int = ACCURACY
) -> DataFrame:
    """``scored`` (key, n_words, score, ...) with ``rank``: 1, 2, 3, ... for the ``percent`` in 100 drawn, else null.

    Of all rows with ``least_words`` words, the highest scores are drawn; ties go to the
    smaller key, null keys last, and rows that agree in both to either. No task or driver
    holds more than a range of the drawn rows; only the bracket is sorted to find the cutoff.
    """
    own = [c for c in scored.columns if c not in ("rank", "_row")]
    table = materialize(scored.select(*own).withColumn("_row", F.monotonically_increasing_id()), "scored")
    pool = table.where(F.col("n_words") >= least_words)
    rows = pool.count()
    wanted = percent * rows // 100
    if not wanted:
        return table.drop("_row").withColumn("rank", F.lit(None).cast("long"))
    low, high, over, inside = bracket(pool, wanted, rows, accuracy)
    order = [F.col("score").desc(), F.col(key).isNull().asc(), F.col(key).asc(), F.col("_row").asc()]
    within = pool.where(F.lit(True) if low is None else F.col("score") >= low)
    within = within.where(F.lit(True) if high is None else F.col("score") <= high).select(key, "score", "_row")
    last = numbered(within, order, "place", inside).where(F.col("place") == wanted - over).first()
    place = F.struct((-F.col("score")).alias("a"), F.col(key).isNull().alias("b"), F.col(key).alias("c"), F.col("_row").alias("d"))
    kind = scored.schema[key].dataType
    cutoff = F.struct(
        F.lit(-last["score"]).cast("long").alias("a"), F.lit(last[key] is None).alias("b"), F.lit(last[key]).cast(kind).alias("c"),
        F.lit(last["_row"]).cast("long").alias("d"),
    )
    drawn = (F.col("n_words") >= least_words) & (place <= cutoff)
    ranked = numbered(table.where(drawn), order, "rank", wanted)
    rest = table.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*own, "rank").unionByName(rest.select(*own, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", carry: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank, drawn toward the texts of ``target``.

    Null and blank texts have no features, weight 0 and are never drawn. Repeated rows
    count as often as they occur; an empty table gives an empty result, and an empty
    target gains by the documents' counts alone. Columns named as the results are replaced.
    """
    fed = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "rank")]
    weighed = weigh(docs, gains(docs, target), fed)
    return draw(weighed.withColumn("score", F.col("weight") + noise(F.col(key), seed)), key)
