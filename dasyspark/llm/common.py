"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark.session import BROADCAST_BYTES, materialize

# Words are runs of anything but space and the controls \t to \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ROWS_PER_BATCH = 1_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def crc_mod(key: object, modulus: int) -> int:
    """crc32 of a key written as text, modulo ``modulus``; a null key gives -1."""
    return -1 if key is None else zlib.crc32(str(key).encode()) % modulus


def fold(key: Column, modulus: int) -> Column:
    """The same as a Column; null keys give -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker does not keep the peak of the task before."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(fn: Callable) -> Callable:
    """A task function over batches that gives memory back when it starts and when it is through."""

    @functools.wraps(fn)
    def run(batches: Iterator) -> Iterator:
        give_back()
        yield from fn(batches)
        give_back()

    return run


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to dicts of equally long columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
                )

    return df.mapInArrow(trimmed(run), schema)


def pieces(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``text`` holds about so many bytes at most (single rows may hold more)."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    total = np.cumsum(np.nan_to_num(sizes.astype(float)))
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0.0
        end = max(start + 1, int(np.searchsorted(total, base + chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A full avalanche over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES // 2) -> bool:
    """Whether a count proves that ``df`` stays below ``limit`` bytes."""
    return df.count() * row_bytes <= limit


def join_small(facts: DataFrame, keyed: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Equi-join of a written table; broadcast only if its counted size allows, else shuffled."""
    return facts.join(F.broadcast(keyed) if small(keyed, row_bytes) else keyed, on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python some megabytes at a time; the default of 10,000 rows suits narrow rows only."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


__all__ = [
    "SPACES", "WORD", "LOWER_AZ", "words_of", "crc_mod", "fold", "map_batches", "pieces", "give_back", "trimmed", "mix", "small", "join_small",
    "shuffle_partitions", "small_batches", "documents", "materialize",
]
