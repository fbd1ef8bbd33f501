"""Helpers that the corpus operators share: paths, Arrow batches, columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cleaned, new_path as scratch, passing, written  # noqa: F401

#: ASCII white space, as the contracts of the text operators define it.
SPACE = r"[\x20\x09-\x0D]+"


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def one_row_batches(spark: SparkSession):
    """Arrow batches of one row, for plans run inside: where a row holds megabytes, a batch of many would fill a worker's memory."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1")


def small_batches(spark: SparkSession, n_bytes: int = 4 << 20):
    """Arrow batches of at most so many bytes (or of one row), for plans run inside."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


#: What workers remember between tasks, by operator. A worker serves the tasks of all stages, one after the other.
_memories: dict[str, dict] = {}


def trim() -> None:
    """Gives memory that this worker doesn't use back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def memory_of(operator: str) -> dict:
    """What this worker remembers for an operator. What it remembered for others is given up, so that stages don't add up in its memory; '' has none."""
    if any(held for name, held in _memories.items() if name != operator):
        for name in [x for x in _memories if x != operator]:
            _memories[name].clear()
        gc.collect()
        trim()
    return _memories.setdefault(operator, {})


def partitions_for(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; every other column stays out of the plan."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
