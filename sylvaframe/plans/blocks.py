"""All-pairs work in blocks: both sides of each key are dealt into blocks, and each pair of blocks is one task's group.

A join without a condition emits every pair as a row; here a pair of blocks is one matrix
operation, and only what a function keeps of it becomes rows. A group holds one block of
each side, however many rows a key has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small

#: Rows of a block on the left and on the right.
LEFT_ROWS, RIGHT_ROWS = 4096, 512


def _dealt(df: DataFrame, key: list[str], by: str, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """df with its own block number, once for each block of the other side."""
    held = df.join(small(sizes), key)
    mine = F.pmod(F.xxhash64(by), F.col(own)).cast("int")
    return held.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def block_pairs(left: DataFrame, right: DataFrame, key: list[str], left_by: str, right_by: str, pair: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """What pair(block of left, block of right) gives for all pairs of blocks of each key; keys that one side lacks give nothing.

    Rows are dealt by a hash of left_by and right_by, so these tell a key's rows apart. The blocks have about left_rows and right_rows rows."""
    a, b = (f"{x}_{uuid.uuid4().hex}" for x in ("a", "b"))
    count = lambda df, rows, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = count(left, left_rows, a).join(count(right, right_rows, b), key)
    dealt_left, dealt_right = _dealt(left, key, left_by, a, b, sizes), _dealt(right, key, right_by, b, a, sizes)
    names = [*key, a, b]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pair(x, y)

    return dealt_left.groupBy(*names).cogroup(dealt_right.groupBy(*names)).applyInPandas(run, schema)
