"""Cutting lineage in the folder that driver and executors share, and joins that broadcast only what is small."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}

#: Rows of a table up to which it is broadcast, if its bytes allow it as well.
BROADCAST_ROWS = 200_000
#: Bytes of its values up to which it is.
BROADCAST_BYTES = 32 << 20


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


#: The paths that each passing() of this thread deletes, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())
#: Spark's own setting by which an execution deletes its shuffle files when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, label: str, stays: bool = False) -> str:
    """A new path in the shared folder. Inside passing() it is deleted at the end unless it stays."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    scopes = _passing.get()[:-1] if stays else _passing.get()
    if scopes:
        scopes[-1].append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that were written to the shared folder inside, but for those that stay.

    For work whose result is written inside (with stays=True) or reads only tables that stay: a DataFrame that still reads a deleted table fails.
    Tables that stay belong to the passing() around this one, if there is one."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, n_bytes: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most so many bytes (or of one row), for plans of large rows that are run inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each execution inside are deleted when it ends."""
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def written(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """df written to the shared folder and read again. The shuffle files of the write are deleted when it ends; stays: see passing()."""
    spark = df.sparkSession
    path = new_path(spark, label, stays)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int | None = None, n_bytes: int | None = None) -> bool:
    """Whether df is counted to have at most `rows` rows and its values at most n_bytes; by default what may be broadcast."""
    rows, n_bytes = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if n_bytes is None else n_bytes
    width = F.lit(0)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(kind, T.ArrayType):
            size = F.size(c) * (8 if isinstance(kind.elementType, T.NumericType) else 64)
        else:
            size = F.lit(8)
        width = width + F.greatest(F.coalesce(size, F.lit(0)), F.lit(8))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return n <= rows and total <= n_bytes


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast it, as it grows with the input: Spark goes by the bytes of compressed files, which can be a tenth of the values'."""
    return df.hint("merge")


def small(df: DataFrame, rows: int | None = None, n_bytes: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is small enough; otherwise for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, n_bytes) else shuffled(df)
