"""What must not grow faster than the input: what is broadcast, and what folds hold."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import labels, query, recluster, vector
from sylvaframe.plans.closure import subtree
from sylvaframe.schema import Tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chain(spark):
    n = 200
    return spark.createDataFrame([(k, None if k == 0 else k - 1, f"a/{k % 7}", k % 5 == 0, k % 3 == 0, False) for k in range(n)], "node_id long, parent_id long, name string, starred boolean, approved boolean, filled boolean")


def test_what_folds_return_is_not_broadcast(spark, chain):
    tables = Tables(chain, chain.select(F.col("node_id").cast("string").alias("object_id"), "node_id"))
    for df in (query.n_objects_deep(chain, tables.assignments), query.connect_supertree(chain), subtree(chain, 3), labels.node_labels(chain)):
        assert "BroadcastHashJoin" not in _plan(df) and "SortMergeJoin" in _plan(df)


def test_rounds_of_folds_do_not_broadcast(spark, chain, monkeypatch):
    from sylvaframe.plans import closure

    plans = []
    real = closure.written
    monkeypatch.setattr(closure, "written", lambda df, label: (plans.append(_plan(df)), real(df, label))[1])
    query.levels(chain)
    query.n_descendants(chain)
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def _walked(rows, clean):
    up, found = {k: (p, name) for k, p, name in rows}, {}
    for node in up:
        way, k = [], node
        while up[k][0] is not None:
            way.append(up[k][1])
            k = up[k][0]
        way.reverse()
        way = way[: way.index(None)] if None in way else way
        label = ""
        for name in way:
            label = (name if label == "" else "/".join([label, *(c for c in name.split("/") if c not in label)])) if clean else label
        label = label if clean else "/".join(way)
        if up[node][0] is not None and label:
            found[node] = label
    return found


@pytest.mark.parametrize("clean", [True, False])
def test_labels_against_a_walk(spark, clean):
    rng = random.Random(5)
    names = [None, "", "/", "a", "b/a", "ab", "b", "c//d", "d/", "/c", "a/b/c", "ba"]
    rows = [(0, None, "top")] + [(k, max(0, k - rng.randint(1, 4)), rng.choices(names, [1] + [4] * 11)[0]) for k in range(1, 150)]
    got = labels.node_labels(spark.createDataFrame(rows, "node_id long, parent_id long, name string"), clean).collect()
    assert {r.node_id: r.label for r in got} == _walked(rows, clean)


def test_label_folds_hold_each_component_once(spark, chain, monkeypatch):
    held = []
    real = labels.path_fold
    monkeypatch.setattr(labels, "path_fold", lambda *a: held.append(real(*a)) or held[-1])
    assert labels.node_labels(chain).filter("node_id = 199").first().label == "a/1/2/3/4/5/6/0"
    assert held[0].agg(F.max(F.size("names"))).first()[0] <= 8


def test_fixtures_do_not_broadcast_customers(spark):
    from sylvaframe import fixtures

    for t in (fixtures.geo(spark, "/root/testdata/sf0.001"), fixtures.deep(spark, "/root/testdata/sf0.001")):
        assert "SortMergeJoin" in _plan(t.assignments) and "Broadcast" not in _plan(t.assignments)


def test_prototypes_stand_for_a_sample_of_large_nodes(spark, tmp_path):
    # 1300 objects in a node: its sample of 1000 has another mean than all of them.
    from sylvaframe import queries as library

    from .compare import compare

    rng = random.Random(3)
    rows = [(5 * k, [rng.random(), float(k)], 0) for k in range(1300)] + [(5 * k + 2, [rng.random(), 1.0], k % 2) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "x", "{}")], "event_id long, ts string, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert compare(spark, "a07_prototypes", library.QUERIES["a07_prototypes"], library.ORACLES["a07_prototypes"], str(tmp_path)) == ""


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cosine", "cityblock"])
@pytest.mark.parametrize("least", [True, False])
def test_ends_of_blocks(metric, least):
    rng = np.random.default_rng(4)
    b = np.concatenate([rng.normal(size=(300, 5)), np.ones((200, 5)), rng.normal(size=(100, 5)) * 1e-9 + 7])
    a = np.concatenate([b[::3], rng.normal(size=(400, 5)), np.full((3, 5), 7.0)])
    at, d = vector._ends(a, b, metric, least)
    every = np.stack([vector._in_numpy(metric, a, v) for v in b], 1)
    want = every.argmin(1) if least else every.argmax(1)
    assert (at == want).all() and np.allclose(d, every[np.arange(len(a)), want], atol=0)


def test_many_prototypes_are_compared_by_blocks(spark, monkeypatch):
    # Lists of tens of thousands of prototypes, gone through row by row, took hours.
    calls = []
    real = vector._far_pairs
    monkeypatch.setattr(vector, "_far_pairs", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(300, 3))
    points = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "object_id int, vector array<double>")
    known = spark.createDataFrame([(v, k % 2) for k, v in enumerate(y.tolist())], "vector array<double>, label int")
    d = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    assert {r.object_id: round(r.distance, 9) for r in vector.prototype_distance(points, known).collect()} == dict(enumerate(d.min(1).round(9).tolist()))
    got = {(r.object_id, r.label): round(r.score, 9) for r in vector.predict_scores(points, known, 3).collect()}
    assert got == {(i, k): round(-float(d[i, k::2].min()), 9) if k < 2 else float("-inf") for i in range(50) for k in range(3)}
    assert len(calls) == 4


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    # Each block went through a shuffle once for each block that it meets: quadratic on disk.
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(str(k), v) for k, v in enumerate(rng.normal(size=(400, 3)).tolist())], "object_id string, vector array<double>")
    plans = []
    real = recluster._needed_pairs
    monkeypatch.setattr(recluster, "_needed_pairs", lambda *a: plans.append(real(*a)) or plans[-1])
    got = recluster.neighbours(points, 3)
    plan = _plan(plans[0])
    assert "CartesianProduct" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    x = np.array([r.vector for r in points.collect()])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(str(i), str(j), n + 1) for i in range(400) for n, j in enumerate(d[i].argsort()[:3])}
    assert {(r.object_id, r.other_id, r["rank"]) for r in got.collect()} == want


def test_forests_tell_known_objects_apart_in_larger_tables(spark):
    # Trees of five levels did in hundreds of vectors, not in thousands.
    from sylvaframe import queries as library

    from .compare import compare

    assert compare(spark, "v20_rf_rank", library.QUERIES["v20_rf_rank"], library.ORACLES["v20_rf_rank"], "/root/testdata/sf0.1") == ""


@pytest.mark.parametrize("near, joined", [(16, 65_536), (2, 0)])
def test_spanning_tree_searches_all_pairs_seldom(spark, monkeypatch, near, joined):
    # Each Boruvka round held all blocks against all, point by point in Python.
    monkeypatch.setattr(recluster, "NEAR", near)
    monkeypatch.setattr(recluster, "JOINED_HERE", joined)
    monkeypatch.setattr(recluster, "BLOCK", 32)
    monkeypatch.setattr(recluster, "OTHERS", 100)
    rng = np.random.default_rng(11)
    # Groups of 40 near points: a point's nearest all lie in its own group, so groups are joined by a search.
    x = np.concatenate([c + rng.normal(size=(40, 3)) * 0.01 for c in rng.normal(size=(6, 3)) * 5] + [rng.normal(size=(30, 3)) * 5])
    points, report = spark.createDataFrame([(f"p{k:03d}", v.tolist()) for k, v in enumerate(x)], "object_id string, vector array<double>"), {}
    got = recluster.density_forest(points, 2, report).collect()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(d + np.diag(np.full(len(x), np.inf)), axis=1)[:, 1]
    d = np.maximum(d, np.maximum(core[:, None], core))
    inside, total, least = np.zeros(len(x), bool), [], d[0].copy()
    inside[0] = True
    for _ in range(len(x) - 1):
        least[inside] = np.inf
        k = int(least.argmin())
        total.append(least[k])
        inside[k], least = True, np.minimum(least, d[k])
    assert np.allclose(sorted(r.w for r in got), sorted(total), atol=1e-9)
    assert 1 <= report["searches"] <= 4
