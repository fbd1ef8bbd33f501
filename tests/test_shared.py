"""Tables in the shared folder: which are deleted, and the shuffle files of their writes."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sylvaframe.plans.shared import passing, written


def exists(df):
    return bool(df.sparkSession.read.parquet(path(df)).columns)


def path(df):
    return df.inputFiles()[0].rsplit("/", 1)[0]


def gone(spark, at):
    with pytest.raises(PySparkException):
        spark.read.parquet(at).count()
    return True


def test_passing_tables_go_and_others_stay(spark):
    before = written(spark.range(3), "before")
    with passing(spark):
        first = written(spark.range(10), "first")
        at = path(first)
        last = written(first.groupBy((F.col("id") % 3).alias("k")).count(), "last", stays=True)
        assert exists(first)
    assert gone(spark, at)
    assert sorted(map(tuple, last.collect())) == [(0, 4), (1, 3), (2, 3)] and before.count() == 3


def test_what_stays_belongs_to_the_outer_one(spark):
    with passing(spark):
        with passing(spark):
            inner, kept = path(written(spark.range(2), "inner")), written(spark.range(4), "kept", stays=True)
        assert gone(spark, inner) and kept.count() == 4
        at = path(kept)
        final = written(kept, "final", stays=True)
    assert gone(spark, at) and final.count() == 4


def test_tables_go_after_an_error_too(spark):
    at = []
    with pytest.raises(ValueError), passing(spark):
        at.append(path(written(spark.range(2), "lost")))
        raise ValueError
    assert gone(spark, at[0])


def test_threads_do_not_delete_each_others_tables(spark):
    def work(k):
        with passing(spark):
            table = written(spark.range(k, k + 5), "own")
            return written(table.repartition(3, "id"), "sum", stays=True).agg(F.sum("id")).first()[0]

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(8))) == [5 * k + 10 for k in range(8)]


def test_a_frame_can_be_used_again_after_its_write(spark):
    shuffled = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    n = shuffled.count()
    assert written(shuffled, "again").count() == n == shuffled.count() == written(shuffled, "again").count()
