import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import vector


def test_fit_takes_all_points(spark):
    rows = [(1, k, [float(k), 2.0]) for k in range(1500)] + [(2, 5000, [1.0, 3.0]), (2, 5001, None)]
    df = spark.createDataFrame(rows, "node_id long, object_id long, vector array<double>")
    for k in (1, 3):
        got = {r.node_id: r.prototypes for r in vector.fit_prototypes(df, "node_id", k).collect()}
        assert sum(p.support for p in got[1]) == 1500
        assert sum(p.support * p.vector[0] for p in got[1]) / 1500 == pytest.approx(749.5)
        assert [(p.vector, p.support) for p in got[2]] == [([1.0, 3.0], 1.0)]
    assert sum(p.support for p in vector.fit_prototypes(df.filter("node_id = 1"), "node_id", 3, sample=1000).first().prototypes) == 1000


def test_many_groups_are_merged_as_one_by_one():
    # A Python call a node and round didn't end over hundreds of thousands of nodes.
    rng = np.random.default_rng(6)
    sizes = np.array([17, 32, 20, 5, 60])
    x, s = rng.integers(0, 6, (int(sizes.sum()), 2)).astype(float), rng.integers(1, 9, int(sizes.sum())).astype(float)
    found, total, many = vector.merge_many(x, s, sizes, 16)
    want = [vector.merge_prototypes_of(a, b, 16) for a, b in zip(np.split(x, np.cumsum(sizes)[:-1]), np.split(s, np.cumsum(sizes)[:-1]))]
    assert many.tolist() == [len(b) for _, b in want]
    assert np.allclose(found, np.concatenate([a for a, _ in want])) and np.allclose(total, np.concatenate([b for _, b in want]))


def test_prototypes_stand_for_all_objects(spark):
    # A sample of 1000 stood for a node's objects.
    from sylvaframe.operators import stats
    from sylvaframe.schema import Tables

    nodes = spark.createDataFrame([(0, None), (1, 0)], "node_id long, parent_id long")
    rows = [(f"o{k}", k % 2, [float(k), 1.0], (k * 7919 % 2601) / 2601) for k in range(2601)]
    held = spark.createDataFrame(rows, "object_id string, node_id long, vector array<double>, rand double").cache()
    t = Tables(nodes, held.select("object_id", "node_id"), held.select("object_id", "vector", "rand"))
    found = {r.node_id: r.prototypes for r in stats.prototypes(t).collect()}
    assert {n: (len(p), sum(x.support for x in p)) for n, p in found.items()} == {0: (16, 2601.0), 1: (16, 1300.0)}
    assert sum(p.support * p.vector[0] for p in found[0]) / 2601 == pytest.approx(1300.0)
    kept = stats.consolidate(t.with_(nodes=nodes.withColumn("cache_valid", F.lit(False))), 0, with_prototypes=True, return_="node").first()
    assert sum(p.support for p in kept._prototypes) == 2601.0


def test_centres_of_large_groups_on_the_driver_and_in_tables(spark, monkeypatch):
    # Each of up to 50 Lloyd rounds was several jobs, with tables written and read.
    monkeypatch.setattr(vector, "MOST_IN_TASK", 100)
    monkeypatch.setattr(vector, "FIT_BLOCK", 50)
    rng = np.random.default_rng(2)
    rows = [(f"g{g}", k, (rng.normal(size=2) + 9 * (k % 4)).tolist()) for g in range(2) for k in range(400)]
    df = spark.createDataFrame(rows, "node_id string, object_id long, vector array<double>").cache()
    fitted = lambda: {r.node_id: sorted((tuple(np.round(p.vector, 6)), p.support) for p in r.prototypes) for r in vector.fit_prototypes(df, "node_id", 4).collect()}
    near = fitted()
    monkeypatch.setattr(vector, "ON_DRIVER", 0)
    assert near == fitted() and [s for _, s in near["g0"]] == [100.0] * 4


def test_large_groups_are_merged_in_pieces(monkeypatch):
    # A group of 416 prototypes took 400 turns over all its pairs; a deep tree has one for each of its upper nodes and rounds.
    most = []
    real = vector.merge_many
    monkeypatch.setattr(vector, "merge_many", lambda x, s, sizes, k: most.append(int(sizes.max())) or real(x, s, sizes, k))
    rng = np.random.default_rng(8)
    groups = [(rng.normal(size=(n, 2)) + 50 * rng.integers(0, 4, (n, 1)), rng.integers(1, 9, n).astype(float)) for n in (416, 20, 3000, 90, 129)]
    got = vector.merge_lists(groups, 16)
    assert max(most) <= vector.MERGED_WHOLE
    for (x, n), (v, s) in zip(groups, got):
        assert len(s) == 16 and s.sum() == n.sum() and np.allclose(s @ v, n @ x)
        # Far points are never merged.
        assert sorted(set(np.round(v[:, 0] / 50))) == sorted(set(np.round(x[:, 0] / 50))) and np.allclose(((v / 50) - np.round(v / 50)), 0, atol=0.1)
    for (x, n), (v, s) in zip(groups[1::2], got[1::2]):
        a, b = vector.merge_prototypes_of(x, n, 16)
        assert np.allclose(v, a) and np.allclose(s, b)
    assert vector.merge_lists([], 16) == []
