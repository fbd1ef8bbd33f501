"""Vector operators against numpy, and their ways beyond the broadcast limit against those within it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import edit, rank, vector
from sylvaframe.plans import shared
from sylvaframe.schema import Tables


def frame_of(spark, x, name="object_id", prefix="p"):
    return spark.createDataFrame([(f"{prefix}{k:04d}", None if v is None else [float(y) for y in v]) for k, v in enumerate(x)], f"{name} string, vector array<double>")


def test_pca_against_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 1000
    found, share = vector.pca(frame_of(spark, list(x) + [None]), 3)
    rows = {r.object_id: r.projected for r in found.collect()}
    assert rows.pop("p0200") is None
    got = np.array([rows[f"p{k:04d}"] for k in range(200)])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ vt[:3].T
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])
    assert np.allclose(got, want * signs, atol=1e-7) and share == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())


def test_pca_of_null_short_and_no_vectors(spark):
    part = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, None]), ("c", None), ("d", [5.0, 2.0])], "object_id string, vector array<double>")
    found, share = vector.pca(part, 1)
    assert {r.object_id: r.projected for r in found.collect()} == {"a": [-2.0], "b": None, "c": None, "d": [2.0]} and share == 1.0
    none, share = vector.pca(part.filter("vector is null"), 1)
    assert [r.projected for r in none.collect()] == [None] and share == 0.0
    with pytest.raises(ValueError):
        vector.pca(part, 3)
    same, share = vector.pca(part.filter("object_id = 'a'"), 1)
    assert share == 0.0 and same.first().projected == [0.0]


def test_forest_scores_are_the_models_own(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    good, bad = frame_of(spark, rng.normal(1, 1, (80, 3))), frame_of(spark, rng.normal(-1, 1, (80, 3)), prefix="q")
    every = good.unionByName(bad)
    with_null = every.unionByName(frame_of(spark, [None], prefix="n"))
    known = shared.written(good.select(F.lit(1.0).alias("label"), "vector").unionByName(bad.select(F.lit(0.0).alias("label"), "vector")), "known")
    model = RandomForestClassifier(featuresCol="f", labelCol="label", seed=3, numTrees=7).fit(known.select("label", array_to_vector("vector").alias("f")))
    trees = vector.forest_nodes(model)
    own = {r.object_id: float(model.predictProbability(Vectors.dense(r.vector))[1]) for r in every.collect()}
    assert len(trees) == 7 and max(len(t[0]) for t in trees) > 3
    got = {r.object_id: r.score for r in vector.forest_scores(with_null, trees).collect()}
    assert got.pop("n0000") is None
    ranked = {r.object_id: r.score for r in vector.rf_rank(with_null, good, bad, seed=3, numTrees=7).collect()}
    assert all(ranked[f"p{k:04d}"] is not None for k in range(80)) and np.mean([v for k, v in ranked.items() if k[0] == "p"]) > 0.8
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in own.items()}


def test_blocked_ways_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = frame_of(spark, [*rng.normal(size=(60, 4)), None])
    types = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate([*rng.normal(size=(9, 4)), np.zeros(4), np.zeros(4)])], "type_id int, vector array<double>")
    classes = types.select((F.col("type_id") % 3).cast("int").alias("label"), "vector").filter("label < 2")
    named = lambda df, c: df.select(F.col(c).cast("string").alias("id"), "vector")

    def rows():
        out = [vector.prototype_distance(points, types, m) for m in ("euclidean", "sqeuclidean", "cityblock")]
        out += [vector.predict_scores(points.filter("vector is not null"), classes, 3), vector.type_radius(types), vector.distances(types, points.filter("vector is not null"))]
        out += [vector.classify(types, points), vector.classify(types, points, safe=False), vector.prototype_set_distance(named(points.filter("vector is not null"), "object_id"), named(types, "type_id"))]
        out += [rank.by_anchor_distance(points.filter("vector is not null").withColumnRenamed("object_id", "member_id"), types)]
        return [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str) for df in out]

    few = rows()
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    assert rows() == few


def test_quantiles_to_the_last_bit(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=500), np.full(300, 0.25)])
    shares = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    got = rank.quantiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", shares)
    assert got == np.quantile(x, shares).tolist()
    assert rank.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None] and rank.quantiles(spark.createDataFrame([(7.0,)], "x double"), "x", [0.2, 1.0]) == [7.0, 7.0]


def cost(x, prototypes):
    c = np.array([p.vector for p in prototypes])
    return ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum()


def test_large_groups_are_fitted_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_IN_TASK", 100)
    monkeypatch.setattr(vector, "FIT_BLOCK", 64)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 3)) * 20
    groups = {"a": centres[rng.integers(0, 5, 600)] + rng.normal(size=(600, 3)), "b": rng.normal(size=(40, 3)), "c": np.zeros((150, 3))}
    rows = [(g, f"{g}{k}", [float(y) for y in v]) for g, x in groups.items() for k, v in enumerate(x)]
    found = {r.g: r.prototypes for r in vector.fit_prototypes(spark.createDataFrame(rows, "g string, object_id string, vector array<double>"), "g", 5).collect()}
    assert {g: sum(p.support for p in ps) for g, ps in found.items()} == {"a": 600.0, "b": 40.0, "c": 150.0}
    c, n = vector.fit_prototypes_of(groups["a"], 5)
    assert cost(groups["a"], found["a"]) <= 1.02 * ((groups["a"][:, None] - c[None]) ** 2).sum(-1).min(1).sum()
    assert len(found["c"]) == 1 and found["c"][0].vector == [0.0, 0.0, 0.0]


def test_linkage_is_complete_linkage():
    rng = np.random.default_rng(7)
    x, support = rng.normal(size=(14, 2)), rng.integers(1, 9, 14).astype(float)
    groups = [[k] for k in range(14)]
    far = lambda a, b: max(np.linalg.norm(x[i] - x[j]) for i in a for j in b)
    while len(groups) > 4:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[a] += groups.pop(b)
    vectors, n = vector.merge_prototypes_of(x, support, 4)
    want = sorted((support[g].sum(), *np.average(x[g], axis=0, weights=support[g]).round(9)) for g in groups)
    assert sorted((s, *v.round(9)) for s, v in zip(n, vectors)) == want


def test_classify_moves_only_what_stands_in_the_node(spark):
    nodes = spark.createDataFrame([(0, None, 1, False, True), (1, 0, 1, True, True), (2, 0, 1, True, True), (9, None, 2, False, True)], "node_id long, parent_id long, project_id int, starred boolean, approved boolean")
    objects = frame_of(spark, [(0, 0), (9, 9)])
    t = Tables(nodes, spark.createDataFrame([("p0000", 0), ("p0001", 0), ("p0000", 9)], "object_id string, node_id long"), objects)
    centroids = spark.createDataFrame([(1, [0.0, 1.0]), (2, [9.0, 8.0])], "node_id long, vector array<double>")
    out, _ = edit.classify_members(t, 0, centroids, classify_nodes=False, classify_objects=True, safe=False)
    assert sorted(map(tuple, out.assignments.select("object_id", "node_id").collect())) == [("p0000", 1), ("p0000", 9), ("p0001", 2)]
    assert {r.node_id for r in out.nodes.filter("approved").collect()} == {9}


class Halves:
    """Splits points at zero."""

    n_clusters = 2

    def fit_predict(self, x):
        return np.where(x[:, 0] < 0, 7, 3)


def test_a_clusterer_of_ones_own(spark):
    rows = [("g", f"o{k}", [float(v)]) for k, v in enumerate([-4, -2, 1, 2, 6])] + [("h", "x", [5.0])]
    df = spark.createDataFrame(rows, "g string, object_id string, vector array<double>")
    found = {r.g: sorted((p.vector[0], p.support) for p in r.prototypes) for r in vector.fit_prototypes(df, "g", clusterer=Halves()).collect()}
    assert found == {"g": [(-3.0, 2.0), (3.0, 3.0)], "h": [(5.0, 1.0)]}
    with pytest.raises(TypeError):
        vector.fit_prototypes(df, "g", clusterer=object())
