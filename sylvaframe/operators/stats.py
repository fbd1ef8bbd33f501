"""Node statistics: counts, samples, type objects, centroids and prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import euclidean
from ..plans.closure import nearest, path_fold, subtree, subtree_fold, subtree_sums
from ..plans.shared import small, written
from ..schema import Tables
from .query import n_objects_deep
from .vector import PROTOTYPES, fit_prototypes, merge_prototypes

SAMPLE, TYPES, PROTOTYPES_PER_NODE = 1000, 9, 16


def counts(tables: Tables) -> DataFrame:
    """A1, A2: (node_id, n_objects, n_children, n_objects_deep) of every node."""
    own = tables.assignments.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_objects"))
    kids = tables.nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    found = tables.nodes.select("node_id").join(own, "node_id", "left").join(kids, "node_id", "left").join(n_objects_deep(tables.nodes, tables.assignments), "node_id")
    return found.select("node_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_objects", "n_children", "n_objects_deep")))


def sample_objects(tables: Tables, n: int = SAMPLE) -> DataFrame:
    """A3: (node_id, object_id, vector, rand, r): at most n objects of each node, those with the least rand."""
    rows = tables.assignments.select("node_id", "object_id").join(tables.objects.select("object_id", "vector", "rand"), "object_id")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("rand", "object_id"))).filter(F.col("r") <= n)


def centroids(tables: Tables) -> DataFrame:
    """(node_id, vector, n): the mean of all vectors in each node's subtree. Each node's own sum is made first; subtrees add up sums, one row per node and dimension."""
    rows = tables.assignments.select("node_id", "object_id").join(tables.objects.select("object_id", "vector"), "object_id").filter("vector is not null")
    own = rows.select("node_id", F.posexplode("vector").alias("pos", "x")).groupBy("node_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    deep = subtree_sums(tables.nodes, own, ["pos"])
    listed = deep.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("n").alias("n"))  # one entry per dimension
    return listed.select("node_id", F.transform("v", lambda p: p["x"] / F.col("n")).alias("vector"), F.col("n").cast("double").alias("n"))


def own_type_objects(tables: Tables, k: int = TYPES, n: int = SAMPLE) -> DataFrame:
    """A4: (node_id, object_id, key, r): of a node's sampled objects the k farthest from its children: by the largest distance to a child's centroid. Leaves have none."""
    kids = tables.nodes.filter("parent_id is not null").select("node_id", "parent_id").join(centroids(tables).select("node_id", F.col("vector").alias("c")), "node_id").select(F.col("parent_id").alias("node_id"), "c")
    far = sample_objects(tables, n).join(kids, "node_id").groupBy("node_id", "object_id").agg(F.max(euclidean(F.col("vector"), F.col("c"))).alias("key"))
    return far.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("key"), "object_id"))).filter(F.col("r") <= k)


def type_objects(tables: Tables, k: int = TYPES, n: int = SAMPLE) -> DataFrame:
    """A5: (node_id, pos, object_id): up to k objects that stand for each node. A leaf has its first sampled ones; an inner node takes turns through the lists of at most k children, chosen by a hash of their ids.

    How long each list is follows from sums over the chosen edges, as min(k, .) of a sum of lists is that of the sum of their lengths. So each place of a node's
    list is known to be a certain place of a certain child's, and places form chains that end at leaves: these are followed by doubled pointers, k rows a
    node, in log2(depth) rounds."""
    kids = tables.nodes.filter("parent_id is not null").select("node_id", "parent_id").withColumn("h", F.pmod(F.col("node_id") * F.lit(2654435761), F.lit(4294967296)))
    chosen = written(kids.withColumn("turn", F.row_number().over(Window.partitionBy("parent_id").orderBy("h", "node_id"))).filter(F.col("turn") <= k).select("node_id", "parent_id", "turn"), "chosen")
    inner = chosen.select(F.col("parent_id").alias("node_id")).distinct()
    leaf = written(sample_objects(tables, n).filter(F.col("r") <= k).join(inner, "node_id", "left_anti").select("node_id", (F.col("r") - 1).alias("pos"), "object_id"), "leaves")
    forest = tables.nodes.select("node_id").join(chosen.select("node_id", "parent_id"), "node_id", "left")
    lengths = subtree_sums(forest, leaf.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))).select("node_id", F.least("n", F.lit(k)).cast("int").alias("n"))
    # At most k places of at most k children.
    offered = chosen.join(lengths, "node_id").select("parent_id", "turn", "node_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("from"))
    taken = offered.withColumn("pos", F.row_number().over(Window.partitionBy("parent_id").orderBy("from", "turn")) - 1).filter(F.col("pos") < k)
    place = lambda node, pos: F.struct(F.col(node).cast("long").alias("node"), F.col(pos).cast("int").alias("pos"))
    none = F.lit(None)
    places = taken.select(place("parent_id", "pos").alias("node_id"), place("node_id", "from").alias("parent_id"), none.cast("string").alias("object_id"))
    ends = leaf.select(place("node_id", "pos").alias("node_id"), none.cast("struct<node: bigint, pos: int>").alias("parent_id"), "object_id")
    found = path_fold(places.unionByName(ends), {"object_id": F.col("object_id")}, lambda near, far: {"object_id": far("object_id")})
    return found.select(F.col("node_id.node").alias("node_id"), F.col("node_id.pos").alias("pos"), "object_id")


def prototypes(tables: Tables, k: int = PROTOTYPES_PER_NODE, n_init: int = 2, seed: int = 0, sample: int | None = None) -> DataFrame:
    """(node_id, prototypes): of all of a node's own objects, or of a sample of them, merged with those of all below it, down to k, in log2(depth) rounds: k prototypes a node are handed up twice as far in each.

    Merging keeps supports and weighted means, so which levels are merged first changes the choice of prototypes, not what they stand for together."""
    own = tables.assignments.select("node_id", "object_id").join(tables.objects.select("object_id", "vector", "rand"), "object_id")
    fitted = written(fit_prototypes(own, "node_id", k, seed, n_init, sample), "fitted")
    return subtree_fold(tables.nodes, fitted, lambda rows: merge_prototypes(rows, "node_id", k))


def _reached(nodes: DataFrame, node_id: int, depth: int | None, open_: Column) -> DataFrame:
    """(node_id, level) of the nodes that a refresh comes to: from node_id down through nodes for which open_ holds, and through all above the level `depth`; None for the whole subtree."""
    if depth is None:
        return subtree(nodes, node_id).select("node_id", "level")
    start = nodes.filter(F.col("node_id") == node_id).select("node_id", F.lit(0).alias("level"))
    top = start
    if depth == 1:
        top = start.unionByName(nodes.filter(F.col("parent_id") == node_id).select("node_id", F.lit(1).alias("level")))
    elif depth > 1:
        top = subtree(nodes, node_id).filter(F.col("level") <= depth).select("node_id", "level")
    top = written(top, "top")
    # The fold runs over the children of open nodes only, and over the nodes above `depth`.
    ways = nodes.filter("parent_id is not null").join(nodes.filter(open_).select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id", "parent_id")
    small_forest = ways.join(top, "node_id", "left_anti").unionByName(top.select("node_id", F.lit(None).cast("long").alias("parent_id")))
    return nearest(small_forest, top.select("node_id")).join(top.select(F.col("node_id").alias("mark"), F.col("level").alias("from")), "mark").select("node_id", (F.col("from") + F.col("distance")).cast("int").alias("level"))


#: The columns of nodes that hold statistics, and the support of the centroid: how many vectors it is the mean of.
CACHED = {"_n_objects": "long", "_n_children": "long", "_n_objects_deep": "long", "_centroid": "array<double>", "_n_vectors": "double"}


def consolidate(tables: Tables, node_id: int, depth: int | str | None = None, with_prototypes: bool = False, descend_approved: bool = True, return_: str | None = None) -> DataFrame:
    """Nodes with their statistics as _n_objects, _n_children, _n_objects_deep, _centroid and _n_vectors (and _prototypes), refreshed where cache_valid is false, all others as they are.

    From node_id, a refresh goes down through stale nodes, and through all above `depth`: a number, 'children' (1) or 'full' (None) for the whole subtree.
    Without descend_approved, a full refresh stops below approved nodes with a valid cache. Only objects of the stale nodes are read. A valid node hands its
    cached count and mean up as one row and nothing below it is read; one that lacks them is passed through and what is below it is counted, but stays as it is.
    return_: None for all nodes, 'node' for the node's row, 'children' for those of its children, 'raw' for the rows that were come to, with their level."""
    if return_ not in (None, "node", "children", "raw"):
        raise ValueError(return_)
    nodes = tables.nodes
    depth = {"children": 1, "full": None}.get(depth, depth) if isinstance(depth, str) else depth
    wanted = CACHED | ({"_prototypes": PROTOTYPES} if with_prototypes else {})
    missing = {c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in nodes.columns}
    nodes = nodes.withColumns(missing | ({} if "cache_valid" in nodes.columns else {"cache_valid": F.lit(False)}))
    stale_, held = F.coalesce(~F.col("cache_valid"), F.lit(True)), F.col("_n_objects_deep").isNotNull()
    if with_prototypes:
        held = held & (F.col("_prototypes").isNotNull() | (F.col("_n_objects_deep") == 0))
    flags = nodes.select("node_id", "parent_id", "approved" if "approved" in nodes.columns else F.lit(False).alias("approved"), stale_.alias("stale"), held.alias("held"))
    if depth is None and not descend_approved:
        reached = subtree(flags, node_id, lambda up, down: ~F.coalesce(up("approved"), F.lit(False)) | up("stale")).select("node_id", "level")
    else:
        reached = _reached(flags, node_id, depth, F.col("stale"))
    reached = written(reached, "reached")
    facts = lambda ids, fresh: nodes.select("node_id", "parent_id", *wanted, (stale_ & F.lit(fresh)).alias("stale"), (stale_ | ~held).alias("open")).join(ids, "node_id", "left_semi")
    here = written(facts(reached, True), "facts")
    gaps = here.filter("open and not stale").select("node_id")
    if not gaps.isEmpty():
        below = nearest(flags, gaps, lambda up, down: up("stale") | ~up("held")).select("node_id").join(reached, "node_id", "left_anti")
        here = written(here.unionByName(facts(below, False)), "facts")
    # Stale nodes, and those passed through, with what valid nodes hand up to them.
    forest = here.filter("open").select("node_id", "parent_id")
    ids = small(forest.select("node_id"))
    lent = here.filter("not open").join(forest.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
    own = written(tables.assignments.select("node_id", "object_id").join(ids, "node_id", "left_semi"), "own")
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n_own = own.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    kids = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).join(ids, "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("kids"))
    deep = subtree_sums(forest, n_own.unionByName(lent.select(F.col("parent_id").alias("node_id"), F.col("_n_objects_deep").cast("long").alias("n"))))
    support = F.coalesce(F.col("_n_vectors"), F.col("_n_objects_deep").cast("double"))
    fresh = here.filter("stale").select("node_id").join(n_own.withColumnRenamed("n", "own"), "node_id", "left").join(kids, "node_id", "left").join(deep, "node_id", "left")
    fresh = fresh.select("node_id", long(F.col("own")).alias("_n_objects"), long(F.col("kids")).alias("_n_children"), long(F.col("n")).alias("_n_objects_deep"))
    if tables.objects is not None and "vector" in tables.objects.columns:
        points = own.join(tables.objects.filter("vector is not null").select("object_id", "vector"), "object_id").select("node_id", F.posexplode("vector").alias("pos", "x"))
        sums = points.groupBy("node_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
        handed = lent.filter("_centroid is not null").select(F.col("parent_id").alias("node_id"), support.alias("n"), F.posexplode("_centroid").alias("pos", "x")).select("node_id", "pos", (F.col("x") * F.col("n")).alias("x"), "n")
        total = subtree_sums(forest, sums.unionByName(handed), ["pos"])
        listed = total.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("n").alias("_n_vectors"))  # one entry per dimension
        fresh = fresh.join(listed.select("node_id", F.transform("v", lambda p: p["x"] / F.col("_n_vectors")).alias("_centroid"), "_n_vectors"), "node_id", "left")
    else:
        fresh = fresh.withColumns({c: F.lit(None).cast(CACHED[c]) for c in ("_centroid", "_n_vectors")})
    if with_prototypes:
        drawn = own.join(tables.objects.select("object_id", "vector", "rand"), "object_id")
        fitted = fit_prototypes(drawn, "node_id", PROTOTYPES_PER_NODE, 0, 2)
        rows = fitted.unionByName(lent.filter("_prototypes is not null").select(F.col("parent_id").alias("node_id"), F.col("_prototypes").alias("prototypes")))
        merged = subtree_fold(forest, rows, lambda several: merge_prototypes(several, "node_id", PROTOTYPES_PER_NODE))
        fresh = fresh.join(merged.withColumnRenamed("prototypes", "_prototypes"), "node_id", "left")
    new = fresh.select("node_id", F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in wanted))
    isnew = F.coalesce(F.col("__new"), F.lit(False))
    out = [F.when(isnew, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in wanted else F.when(isnew, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "cache_valid" else F.col(c) for c in nodes.columns]
    found = nodes.join(new, "node_id", "left").select(*out)
    if return_ == "node":
        return found.filter(F.col("node_id") == node_id)
    if return_ == "children":
        return found.filter(F.col("parent_id") == node_id)
    return found.join(reached, "node_id") if return_ == "raw" else found
