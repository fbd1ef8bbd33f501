"""Hand-made trees: depth, cycles, names, edits, prototypes and clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import edit, labels, query, rank, recluster, stats, vector
from sylvaframe.plans import closure as cl
from sylvaframe.schema import SchemaError, Tables, Tree, check_tree
from sylvaframe.sources import io

NODES = "node_id long, parent_id long, project_id int, name string, starred boolean, approved boolean, filled boolean, preferred boolean"


def nodes_of(spark, rows):
    return spark.createDataFrame([(r[0], r[1], 1, *(list(r[2:]) + [None, False, False, False, False][len(r) - 2 :])) for r in rows], NODES)


def assigned(spark, rows):
    return spark.createDataFrame(rows, "object_id string, node_id long")


def ids(df, column="node_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_long_chain(spark):
    nodes = nodes_of(spark, [(0, None)] + [(k, k - 1) for k in range(1, 300)])
    path = cl.paths(nodes, 299).first().path
    assert path == list(range(300))
    assert query.n_descendants(nodes).filter("node_id = 0").first().n == 300


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        cl.closure(nodes_of(spark, [(0, None), (1, 2), (2, 1)]))
    t = Tables(nodes_of(spark, [(0, None), (1, 0), (2, 1)]), assigned(spark, []))
    with pytest.raises(edit.EditError):
        edit.relocate_nodes(t, [1], 2)
    with pytest.raises(edit.EditError):
        edit.relocate_nodes(t, [1], 1)


def test_empty_tables(spark):
    t = Tables(nodes_of(spark, []), assigned(spark, []))
    assert cl.closure(t.nodes).count() == 0 and query.progress(t).count() == 0 and stats.counts(t).count() == 0
    with pytest.raises(LookupError):
        query.root_id(t.nodes, 1)


def test_schema_check(spark):
    with pytest.raises(SchemaError):
        check_tree(Tree(spark.createDataFrame([(1,)], "node_id long"), assigned(spark, [])))


def test_labels(spark):
    nodes = nodes_of(spark, [(0, None, "root"), (1, 0, "a/b"), (2, 1, "b/c"), (3, 0, None), (4, 3, "x"), (5, 1, None), (6, 5, "deep"), (7, 2, "ab")])
    tree = Tree(nodes, assigned(spark, [(str(k), k) for k in range(8)]))
    assert {r.object_id: r.label for r in labels.flat_labels(tree).collect()} == {"1": "a/b", "2": "a/b/c", "5": "a/b", "6": "a/b", "7": "a/b/c/ab"}
    assert {r.object_id: r.label for r in labels.flat_labels(tree, compat=True).collect()}["4"] == ""
    assert {r.object_id: r.label for r in labels.flat_labels(tree, clean_name=False).collect()}["7"] == "a/b/b/c/ab"


def test_next_node_goes_up(spark):
    nodes = nodes_of(spark, [(0, None), (1, 0, None, False, True), (2, 0), (3, 1, None, False, True), (4, 2), (5, 2, None, False, False, False, True)])
    t = Tables(nodes, assigned(spark, [("a", 4), ("b", 4), ("c", 5)]))
    assert query.next_unapproved(t, 3, leaf=True).first().node_id == 4
    assert query.next_unapproved(t, 3, leaf=True, preferred_first=True).first().node_id == 5
    assert query.next_unapproved(t, 3, leaf=True, order_by="smallest").first().node_id == 5


def test_edits_keep_objects(spark):
    t = Tables(nodes_of(spark, [(0, None), (1, 0), (2, 0), (3, 1)]), assigned(spark, [("a", 1), ("b", 3), ("c", 2)]), rejected=assigned(spark, []).select("node_id", "object_id"))
    moved = edit.relocate_objects(t, ["a", "b"], 2, src_node_id=1)
    assert {(r.object_id, r.node_id) for r in moved.assignments.collect()} == {("a", 2), ("b", 3), ("c", 2)}
    merged = edit.merge_node_into(moved, 1, 2)
    assert {(r.node_id, r.parent_id) for r in merged.nodes.collect()} == {(0, None), (2, 0), (3, 2)}
    new, node = edit.create_node(merged, 2, name="n", object_ids=["c"], node_ids=[3])
    assert node == 4 and {(r.object_id, r.node_id) for r in new.assignments.collect()} == {("a", 2), ("b", 3), ("c", 4)}
    assert new.nodes.filter("node_id = 3").first().parent_id == 4
    with pytest.raises(edit.EditError):
        edit.create_node(t, orig_parent=None)
    with pytest.raises(edit.EditError):
        edit.update_node(t, 1, node_id=3)
    gone = edit.drop_project(t, 1)
    assert gone.nodes.count() == gone.assignments.count() == 0


def test_duplicate_ids(spark, tmp_path):
    (tmp_path / "index.csv").write_text("object_id,path\n1,a\n2,b\n1,c\n")
    with pytest.raises(io.DuplicateIds, match="1"):
        io.read_index(spark, str(tmp_path / "index.csv"))


def test_export_index(spark, tmp_path):
    (tmp_path / "export_a.tsv").write_text("object_id\timg_file_name\tx\n[t]\t[t]\t[f]\no1\ti1.png\t1.5\n")
    row = io.fix_export_index(spark, str(tmp_path / "export_*.tsv")).collect()
    assert [tuple(r) for r in row] == [("o1", f"{tmp_path}/i1.png")]


def test_features_too_wide(spark):
    objects = spark.createDataFrame([("a", None, None, 0.1)], "object_id string, path string, vector array<double>, rand double")
    f = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "object_id string, features array<float>")
    with pytest.raises(ValueError):
        io.set_features(objects, f, max_dim=2)
    assert io.set_features(objects, f, truncate=2).first().vector == [1.0, 2.0]


@pytest.mark.parametrize("n", [5, 10, 100])
@pytest.mark.parametrize("k", [1, 5, 10, 100])
def test_prototypes(n, k):
    x = np.random.default_rng(n).random((n, 32))
    v, s = vector.fit_prototypes_of(x, k)
    assert len(v) <= k and np.isfinite(v).all() and len(s) == len(v) and s.sum() == n
    mv, ms = vector.merge_prototypes_of(np.concatenate([v, v + 1]), np.concatenate([s, s]), k)
    assert len(mv) <= k and mv.shape[1] == 32 and ms.sum() == 2 * n


def test_prototype_set_distance_to_itself(spark):
    p = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id long, vector array<double>")
    assert vector.prototype_set_distance(p, p).first().distance == 0.0


def test_single_type_and_no_prototypes(spark):
    types = spark.createDataFrame([(7, [0.0, 0.0])], "type_id long, vector array<double>")
    points = spark.createDataFrame([("a", [3.0, 4.0])], "object_id string, vector array<double>")
    assert vector.classify(types, points).first().type_id == 7
    assert vector.prototype_distance(points, types.filter("false")).first().distance == float("inf")


def test_trim_and_bottom_up(spark):
    paths = spark.createDataFrame([(1, [0, 5, 1]), (2, [0, 5, 2, 3])], "node_id long, path array<long>")
    assert {r.node_id: r.path for r in query.trim_common(paths).collect()} == {1: [5, 1], 2: [5, 2, 3]}
    assert [r.node_id for r in query.bottom_up(paths).collect()] == [3, 1, 2, 5, 0]


def test_interleave_and_pages(spark):
    df = rank.paginate(spark.range(7).select((F.col("id") * 3).alias("x")), "x", page_size=3)
    assert [(r.x, r.rank, r.page) for r in df.orderBy("rank").collect()] == [(3 * k, k, k // 3) for k in range(7)]
    assert [r.rank for r in rank.interleave(df, 7).orderBy("place").collect()] == [0, 6, 1, 5, 2, 4, 3]
    assert tuple(rank.page_info(df, 1, 3).first()) == (1, 2, 0, 2)


def test_spanning_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.random((60, 3))
    points = spark.createDataFrame([(f"{k:03d}", v.tolist()) for k, v in enumerate(x)], "object_id string, vector array<double>")
    near = recluster.neighbours(points, 59)
    got = sum(r.w for r in recluster.spanning_forest(near.select(F.col("object_id").alias("a"), F.col("other_id").alias("b"), F.col("d").alias("w"))).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, total = {0}, 0.0
    while len(inside) < 60:
        w, j = min((d[i, j], j) for i in inside for j in range(60) if j not in inside)
        inside.add(j)
        total += w
    assert got == pytest.approx(total, abs=1e-6)


def test_density_tree_with_many_equal_points(spark):
    """The tree spans all points, also groups of more equal ones than any number of neighbours holds."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.zeros((40, 2)), np.full((40, 2), 0.5), rng.random((20, 2)) * 3])
    points = spark.createDataFrame([(f"{k:03d}", v.tolist()) for k, v in enumerate(x)], "object_id string, vector array<double>")
    got = recluster.density_forest(points, 2).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d + np.diag(np.full(100, np.inf)), axis=1)[:, 1]
    d = np.maximum(d, np.maximum(core[:, None], core))
    inside, total = {0}, 0.0
    while len(inside) < 100:
        w, j = min((d[i, j], j) for i in inside for j in range(100) if j not in inside)
        inside.add(j)
        total += w
    assert len(got) == 99 and sum(r.w for r in got) == pytest.approx(total, abs=1e-6)


@pytest.mark.parametrize("method", ["leaf", "eom"])
def test_density_clusters(spark, method):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-6, 9, (6, 2)) + 20])
    rows = [(f"{k:03d}", v.tolist()) for k, v in enumerate(x)]
    got = {r.object_id: r.label for r in recluster.density_cluster(spark.createDataFrame(rows, "object_id string, features array<double>"), 10, method=method).collect()}
    groups = [{got[f"{k:03d}"] for k in range(25 * g, 25 * g + 25) if got[f"{k:03d}"] >= 0} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert all(got[f"{k:03d}"] == -1 for k in range(75, 81))


def test_cluster_pipeline(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (20, 4)) for c in (0, 2)])
    features = spark.createDataFrame([(f"{k:03d}", v.tolist()) for k, v in enumerate(x)], "object_id string, features array<double>")
    tree = recluster.cluster(features, [], min_cluster_size=8, n_pca=2)
    assert tree.objects.count() == 40 and query.unconnected(tree.nodes, tree.objects).count() == 0
    assert recluster.merge_all(features, [tree]).objects.select("object_id").distinct().count() == 40


def test_saved_tree(spark, tmp_path):
    tree = Tree(nodes_of(spark, [(0, None), (1, 0)]), assigned(spark, [("a", 1)]), assigned(spark, [("b", 1)]), {"x": 1})
    io.write_tree(tree, str(tmp_path / "t"), {"y": 2})
    back = io.read_tree(spark, str(tmp_path / "t"))
    assert back.meta == {"x": 1, "y": 2, "base": str(tmp_path / "t")} and back.objects.count() == 1 and back.rejected.count() == 1


def test_similarity_order(spark):
    t = np.linspace(0, 3, 60)
    curve = np.stack([np.cos(t), np.sin(t)], 1)
    members = spark.createDataFrame([(int(k), curve[k].tolist()) for k in np.random.default_rng(1).permutation(60)], "member_id long, vector array<double>")
    got = [r.member_id for r in rank.by_similarity(members, 40).orderBy("key").collect()]
    assert got in (list(range(60)), list(range(59, -1, -1)))
    assert rank.by_similarity(members.limit(4)).count() == 4


def test_labels_keep_the_first_name_whole(spark):
    """A component is held against the label before its name, not against components of the same name."""
    nodes = nodes_of(spark, [(0, None), (1, 0, "x/x"), (2, 1, "ab/a"), (3, 1, "q/q"), (4, 0, "ab/a"), (5, 4, "b")])
    tree = Tree(nodes, assigned(spark, [(str(k), k) for k in range(1, 6)]))
    assert {r.object_id: r.label for r in labels.flat_labels(tree).collect()} == {"1": "x/x", "2": "x/x/ab/a", "3": "x/x/q/q", "4": "ab/a", "5": "ab/a"}


def test_connectivity_reports_cycles(spark):
    nodes = nodes_of(spark, [(0, None), (1, 0), (2, 3), (3, 2), (4, 3), (5, 99), (6, 6)])
    got = {(r.kind, r.id) for r in query.unconnected(nodes, assigned(spark, [("a", 1), ("b", 50)])).collect()}
    assert got == {("node", k) for k in "23456"} | {("object", "b")}
    with pytest.raises(ValueError, match="cycle"):
        query.levels(nodes.filter("node_id <> 6"))


def test_chain_of_100000(spark):
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1).alias("project_id"), F.lit("a").alias("name"), *((F.col("id") % 1000 == 7).alias(c) for c in ("starred", "approved", "filled", "preferred")))
    assert tuple(query.levels(nodes).agg(F.count(F.lit(1)), F.sum((F.col("level") == F.col("node_id")).cast("int"))).first()) == (n, n)
    assert tuple(query.n_descendants(nodes).agg(F.count(F.lit(1)), F.sum((F.col("n") == n - F.col("node_id")).cast("int"))).first()) == (n, n)
    assert cl.ancestors(nodes, 70_000).count() == 70_001
    assert cl.subtree(nodes, 70_000).count() == 30_000
    assert query.connect_supertree(nodes).filter("node_id = 99999").first().superparent_id == 99_007
    assert edit.invalidate_path(nodes, [5, 9]).filter("not cache_valid").count() == 10


def test_projections_and_missing_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 5))
    objects = spark.createDataFrame([(str(k), None, None, 0.5) for k in range(30)], "object_id string, path string, vector array<double>, rand double")
    f = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "object_id string, features array<double>")
    got = np.array([r.vector for r in io.set_features(objects, f, pca=2).orderBy(F.col("object_id").cast("int")).collect()])
    c = x - x.mean(0)
    want = np.linalg.svd(c, full_matrices=False)[1][:2] ** 2
    assert got.shape == (30, 2) and np.allclose((got**2).sum(0), want)
    assert recluster.keep_unexplored(f, [], f, 0.1).count() == 30
    found, share = vector.pca(f.withColumnRenamed("features", "__p").withColumn("__v", F.lit(1)), 2, "__p")
    assert found.columns == ["object_id", "__p", "__v", "projected"] and 0 < share <= 1


def test_node_members(spark):
    rng = np.random.default_rng(3)
    nodes = nodes_of(spark, [(0, None), (1, 0, "a", True), (2, 0, "b"), (3, 0, None), (4, 2), (5, 2)])
    vectors = {f"o{k}": rng.random(3).tolist() for k in range(9)}
    objects = spark.createDataFrame(list(vectors.items()), "object_id string, vector array<double>")
    t = Tables(nodes, assigned(spark, [(o, 0) for o in vectors]), objects)
    centroids = spark.createDataFrame([(k, rng.random(3).tolist()) for k in range(1, 6)], "node_id long, vector array<double>")
    order = lambda **kw: [(r.kind, r.member_id) for r in rank.node_members(t, 0, centroids=centroids, dim=3, **kw).orderBy("rank").collect()]
    plain = order(starred_first=False)
    assert plain == [("node", "1"), ("node", "2"), ("node", "3"), *(("object", o) for o in sorted(vectors))]
    assert order() == plain
    for by in ("sim", "interleaved", "random", "starred_sim", "nleaves"):
        one, other = order(arrange_by=by, starred_first=False), order(arrange_by=by, starred_first=False, descending=True)
        assert sorted(one) == sorted(plain) and other == one[::-1]
        assert order(arrange_by=by)[0] == ("node", "1")
    assert order(arrange_by="nleaves", starred_first=False)[:3] == [("node", "2"), ("node", "1"), ("node", "3")]
    sim = order(arrange_by="sim", starred_first=False)
    folded = order(arrange_by="interleaved", starred_first=False)
    assert folded[::2] == sim[:6] and folded[1::2] == sim[6:][::-1]
    with pytest.raises(ValueError):
        rank.node_members(t, 0, arrange_by="other")
    with pytest.raises(LookupError):
        query.node(t, 77)
    shown = rank.project_members(t, rank.node_members(t, 0)).collect()
    assert {r.name for r in shown if r.kind == "node"} == {"a", "b", "3"} and {r.object_id for r in shown if r.kind == "object"} == set(vectors)


def test_consolidate_forms(spark):
    nodes = nodes_of(spark, [(0, None), (1, 0, None, False, True), (2, 1), (3, 0)]).withColumn("cache_valid", F.col("node_id") == 1)
    t = Tables(nodes, assigned(spark, [("a", 2), ("b", 3)]), spark.createDataFrame([("a", [1.0]), ("b", [3.0])], "object_id string, vector array<double>"))
    valid = lambda **kw: {r.node_id for r in stats.consolidate(t, 0, **kw).filter("cache_valid").collect()}
    # A stale node needs its children, so the stale ones among them are refreshed at any depth; the valid one isn't passed.
    assert valid() == {0, 1, 2, 3} and valid(depth=0) == {0, 1, 3} and valid(depth="children") == {0, 1, 3}
    assert valid(descend_approved=False) == {0, 1, 3}
    row = stats.consolidate(t, 0, return_="node").first()
    assert row._n_objects_deep == 2 and row._centroid == [2.0]
    assert ids(stats.consolidate(t, 0, return_="children")) == [1, 3] and ids(stats.consolidate(t, 1, return_="raw")) == [1, 2]


def test_merged_metadata(spark):
    tree = lambda k: Tree(nodes_of(spark, [(0, None)]).select("node_id", "parent_id", "name"), assigned(spark, []), None, {"k": k})
    assert io.merge_trees(io.merge_trees(tree(1), tree(2)), tree(3)).meta == {"k": 1, "merged": [{"k": 2}, {"k": 3}]}
