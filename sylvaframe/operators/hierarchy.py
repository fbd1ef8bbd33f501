"""The density hierarchy of a spanning tree: dendrogram, condensed clusters, choice; all of it tables.

Edges are ranked by weight. A merge's children are the components that its ends have among
the lighter edges. They are found by halving ranges of ranks: the components of the lighter
half of a range are contracted, each to its heaviest merge, and that is what the edges of
the heavier half then join. Both halves go on by themselves, all ranges at once, until a
range is small enough for one task.

Clusters follow the rule of HDBSCAN (Campello, Moulavi, Sander 2013): a merge of two parts
of min_cluster_size or more is where two clusters begin; any other part falls out of the
cluster around it. The cluster of all points is never chosen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.closure import path_fold, subtree_sums
from ..plans.components import components
from ..plans.shared import written
from .rank import numbered

#: Edges of a range of ranks that one task merges.
LOCAL_EDGES = 4096
#: Weights below this count as this, as a cluster's density is one over a weight.
LEAST_WEIGHT = 1e-12


def dendrogram(edges: DataFrame, n: int, local: int = LOCAL_EDGES) -> DataFrame:
    """(node_id, left, right, w): the merges of a forest's edges (u, v, w, rank), lightest first. Ends are numbered 0..n-1 and ranks from 0; the merge of an edge is node n + rank, and left and right are what it joins."""
    held = written(edges.select("u", "v", "w", "rank", F.lit(0).cast("long").alias("lo"), (F.lit(0) + edges.count()).cast("long").alias("hi")), "ranges")
    widest = edges.count()
    at = lambda c: F.struct("lo", F.col(c).alias("end"))
    while widest > local:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        halves = held.withColumn("middle", middle).withColumn("light", F.col("rank") < F.col("middle"))
        light, heavy = halves.filter("light"), halves.filter("not light")
        parts = components(light.select(at("u").alias("a"), at("v").alias("b")))
        heaviest = light.select(at("u").alias("node"), "rank").join(parts, "node").groupBy("root").agg((F.max("rank") + n).alias("top"))
        tops = written(parts.join(heaviest, "root").select("node", "top"), "tops")
        named = heavy
        for c in ("u", "v"):
            named = named.withColumn("node", at(c)).join(tops, "node", "left").withColumn(c, F.coalesce("top", c)).drop("node", "top")
        split = light.select("u", "v", "w", "rank", "lo", F.col("middle").alias("hi")).unionByName(named.select("u", "v", "w", "rank", F.col("middle").alias("lo"), "hi"))
        held = written(split, "ranges")
        widest = widest - widest // 2

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        left, right = [], []
        for u, v, rank in zip(frame["u"].tolist(), frame["v"].tolist(), frame["rank"].tolist()):
            a, b = top(u), top(v)
            left.append(a), right.append(b)
            up[a] = up[b] = n + rank
        return pd.DataFrame({"node_id": frame["rank"] + n, "left": left, "right": right, "w": frame["w"]})

    return written(held.groupBy("lo").applyInPandas(merge, "node_id long, left long, right long, w double"), "merges")


def condensed(merges: DataFrame, n: int, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """(clusters, points) of merges (node_id, left, right, w) over points 0..n-1.

    clusters: (node_id, parent_id, size, birth, stability); the one of all points has no parent. points: (node_id, cluster): the cluster that each point falls out of."""
    up = merges.select(F.explode(F.array("left", "right")).alias("node_id"), F.col("node_id").alias("parent_id"))
    points = merges.sparkSession.range(n).select(F.col("id").alias("node_id"), F.lit(None).cast("double").alias("w"))
    nodes = written(points.unionByName(merges.select("node_id", "w")).join(up, "node_id", "left"), "nodes")
    sizes = subtree_sums(nodes, points.select("node_id", F.lit(1).cast("long").alias("size")))
    nodes = written(nodes.join(sizes, "node_id"), "sized")
    big = F.col("size") >= min_cluster_size
    inner = nodes.filter(big & F.col("w").isNotNull())
    # A merge with two big parts ends a cluster, and each part begins one.
    parts = nodes.filter(big & F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("parts"))
    ends = parts.filter("parts > 1").select(F.col("node_id").alias("parent_id"), F.lit(True).alias("ends"))
    marked = inner.join(ends, "parent_id", "left").select("node_id", F.lit(True).alias("is_big"), (F.col("parent_id").isNull() | F.coalesce("ends", F.lit(False))).alias("begins"))
    facts = nodes.join(marked, "node_id", "left")
    values = {"cluster": F.when(F.col("begins"), F.col("node_id")), "left_at": F.when(F.col("is_big"), F.col("w"))}
    first = lambda near, far: {c: F.coalesce(near(c), far(c)) for c in values}
    folded = written(path_fold(facts, values, first), "clusters")
    density = lambda w: 1.0 / F.greatest(w, F.lit(LEAST_WEIGHT))
    begun = folded.filter("node_id = cluster").select("node_id").join(nodes, "node_id")
    above = folded.select(F.col("node_id").alias("parent_id"), F.col("cluster").alias("around"))
    weight = nodes.select(F.col("node_id").alias("parent_id"), F.col("w").alias("birth_w"))
    clusters = written(begun.join(weight, "parent_id", "left").join(above, "parent_id", "left").select("node_id", F.col("around").alias("parent_id"), "size", F.coalesce(density(F.col("birth_w")), F.lit(0.0)).alias("birth")), "begun")
    fallen = folded.filter(F.col("node_id") < n).filter("cluster is not null")
    # What leaves a cluster, points or the clusters that begin where it ends, and at what density.
    left = fallen.select("cluster", density(F.col("left_at")).alias("density"), F.lit(1).cast("long").alias("size"))
    left = left.unionByName(clusters.filter("parent_id is not null").select(F.col("parent_id").alias("cluster"), F.col("birth").alias("density"), "size"))
    total = left.groupBy(F.col("cluster").alias("node_id")).agg(F.sum(F.col("density") * F.col("size")).alias("total"), F.sum("size").alias("n"))
    stable = clusters.join(total, "node_id", "left").select("node_id", "parent_id", "size", "birth", F.greatest(F.coalesce(F.col("total") - F.col("birth") * F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("stability"))
    return written(stable, "stable"), fallen.select("node_id", "cluster")


def best_cuts(nodes: DataFrame) -> DataFrame:
    """(node_id, value, below): value is the larger of own and below, the sum of the children's values, of rows (node_id, parent_id, own); own isn't negative.

    Leaves, and the chains that end at leaves, are solved in each round: on a chain the value is a function max(a, b + x) of the next one's, and such functions
    combine to one of their kind. Each round at least halves the leaves that are left."""
    open_ = written(nodes.select("node_id", "parent_id", "own", F.lit(0.0).alias("known")), "open")
    solved = None
    while not open_.isEmpty():
        kids = open_.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("next"))
        state = open_.join(kids, "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        low = F.lit(float("-inf"))
        # Where several children are open a chain ends without a value.
        chain = state.select("node_id", F.when(F.col("n") == 1, F.col("next")).alias("parent_id"), F.when(F.col("n") == 0, F.greatest("own", "known")).when(F.col("n") == 1, F.col("own")).alias("a"), F.when(F.col("n") == 1, F.col("known")).otherwise(low).alias("b"))
        both = lambda near, far: {"a": F.when(far("a").isNotNull(), F.greatest(near("a"), near("b") + far("a"))), "b": near("b") + far("b")}
        found = path_fold(chain, {"a": F.col("a"), "b": F.col("b")}, both).filter("a is not null").select("node_id", F.col("a").alias("value"))
        found = written(found, "found")
        solved = found if solved is None else written(solved.unionByName(found), "solved")
        rest = open_.join(found, "node_id", "left_anti")
        given = open_.join(found, "node_id").filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("value").alias("more"))
        open_ = written(rest.join(given, "node_id", "left").select("node_id", "parent_id", "own", (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("known")), "open")
    if solved is None:
        return nodes.select("node_id", F.lit(0.0).alias("value"), F.lit(0.0).alias("below"))
    below = nodes.join(solved, "node_id").filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("value").alias("below"))
    return solved.join(below, "node_id", "left").select("node_id", "value", F.coalesce("below", F.lit(0.0)).alias("below"))


def chosen_of(clusters: DataFrame, method: str) -> DataFrame:
    """(node_id, chosen): for each cluster the chosen one that it belongs to, if there is one. 'leaf': those in which no other begins. 'eom': of a cluster and all below it, whichever has the larger stability."""
    if method == "leaf":
        inner = clusters.select(F.col("parent_id").alias("node_id"))
        return clusters.filter("parent_id is not null").join(inner, "node_id", "left_anti").select("node_id", F.col("node_id").alias("chosen"))
    cuts = best_cuts(clusters.select("node_id", "parent_id", F.col("stability").alias("own")))
    wins = clusters.join(cuts, "node_id").withColumn("win", F.when(F.col("parent_id").isNotNull() & (F.col("stability") >= F.col("below")), F.col("node_id")))
    # The topmost winner.
    return path_fold(wins.select("node_id", "parent_id", "win"), {"chosen": F.col("win")}, lambda near, far: {"chosen": F.coalesce(far("chosen"), near("chosen"))}).filter("chosen is not null")


def clusters_of(points: DataFrame, forest: DataFrame, min_cluster_size: int, method: str = "leaf", local: int = LOCAL_EDGES) -> DataFrame:
    """(object_id, label) of points (object_id) that a cluster of their spanning forest (a, b, w) holds; labels count from 0, by the clusters' smallest ids."""
    if method not in ("leaf", "eom"):
        raise ValueError(method)
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")
    ids = written(numbered(points.select("object_id"), "object_id", name="at"), "ids")
    n = ids.count()
    ends = lambda c, name: ids.select(F.col("object_id").alias(c), F.col("at").alias(name))
    ranked = numbered(forest.join(ends("a", "u"), "a").join(ends("b", "v"), "b"), "w", "u", "v").select("u", "v", "w", "rank")
    clusters, fallen = condensed(dendrogram(written(ranked, "ranked"), n, local), n, min_cluster_size)
    held = fallen.join(chosen_of(clusters, method).withColumnRenamed("node_id", "cluster"), "cluster").select("node_id", "chosen")
    named = written(held.join(ids.select(F.col("at").alias("node_id"), "object_id"), "node_id").select("object_id", "chosen"), "held")
    labels = numbered(named.groupBy("chosen").agg(F.min("object_id").alias("first")), "first", name="label").select("chosen", F.col("label").cast("int").alias("label"))
    return named.join(labels, "chosen").select("object_id", "label")
