"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# A side is broadcast only when a count proves that it stays below this size.
BROADCAST_BYTES = 64 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROW_BYTES, VALUE_BYTES, TEXT_BYTES = 32, 24, 256


def build_session(app: str = "dasyspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key also where an aggregate on the same key follows, at the price of one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Without it only a local session goes on, in a folder that ends with the
    process; on a cluster, executors would write where no other one can read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = os.path.join(tempfile.gettempdir(), f"spark-{os.getpid()}-{uuid.uuid4().hex[:8]}")
        os.makedirs(path)
        atexit.register(shutil.rmtree, path, True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives the optimizer the real
    size of the data, so later joins choose broadcast or shuffle by that size.
    """
    path = scratch_path(df.sparkSession, label)
    _write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def _write(df: DataFrame, path: str) -> None:
    """Write a table; what was shuffled for it goes as soon as it is whole."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables given by ``materialize`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.written)


class Superseding:
    """Written tables of a loop: a table goes when the next one of its label is written.

    The new table is whole by then and reads nothing but its own files, so only one of each
    label takes room, however many rounds there are.
    """

    def __init__(self) -> None:
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        path = scratch_path(spark, label)
        _write(df, path)
        before = self._paths.get(label)
        self._paths[label] = path
        if before:
            _delete(spark, before)
        return spark.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def value_bytes(kind: T.DataType) -> int:
    """Room for a value of a type in memory; texts and collections count as ``TEXT_BYTES``."""
    if isinstance(kind, T.StructType):
        return sum(value_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        return TEXT_BYTES
    return VALUE_BYTES


def fits_broadcast(stats: DataFrame, bound: DataFrame, copies: int = 1) -> bool:
    """Whether ``copies`` rows of ``stats`` for each row of ``bound`` stay below the broadcast size."""
    rows = BROADCAST_BYTES // (ROW_BYTES + value_bytes(stats.schema))
    return has_at_most(bound, max(1, rows // max(1, copies)))
