"""Reading trees: projections, lookups, counts, traversal and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.closure import Descend, ancestors, edges_of, nearest, path_fold, paths, subtree, subtree_sums
from ..plans.shared import shuffled, small, written
from ..schema import Tables


def flag(name: str, include: str | None) -> Column:
    """The filter for `include` = 'starred', 'unstarred' or None."""
    if include not in (None, "starred", "unstarred"):
        raise ValueError(include)
    return F.lit(True) if include is None else F.coalesce(F.col(name), F.lit(False)) == F.lit(include == "starred")


def n_descendants(nodes: DataFrame) -> DataFrame:
    """T4: (node_id, n): the size of each node's subtree, the node included."""
    return subtree_sums(nodes, nodes.select("node_id", F.lit(1).cast("long").alias("n")))


def objects_recursive(tables: Tables, node_id: int) -> DataFrame:
    """T5: the distinct objects below a node."""
    below = subtree(tables.nodes, node_id).select("node_id")
    return tables.assignments.join(below, "node_id", "left_semi").select("object_id").distinct()


def n_objects_deep(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(node_id, n_objects_deep) for every node: the objects assigned in its subtree. Objects are counted per node first."""
    own = assignments.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    deep = subtree_sums(nodes, own)
    return nodes.select("node_id").join(shuffled(deep), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_objects_deep"))


def root_of(nodes: DataFrame, project_id: int) -> DataFrame:
    """The node of a project without a parent."""
    return nodes.filter((F.col("project_id") == project_id) & F.col("parent_id").isNull())


def root_id(nodes: DataFrame, project_id: int) -> int:
    """Its id; an error if there is none."""
    found = root_of(nodes, project_id).select("node_id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"project {project_id} has {'no root' if not found else 'several roots'}")
    return found[0][0]


def projects(tables: Tables, visible_only: bool = True) -> DataFrame:
    """Projects with the id of their root."""
    roots = tables.nodes.filter("parent_id is null").select("project_id", F.col("node_id").alias("root_id"))
    found = tables.projects.join(roots, "project_id")
    return found.filter("visible") if visible_only else found


def children(nodes: DataFrame, node_id: int, include: str | None = None, supertree: bool = False, order_by: Sequence[Column] | None = None) -> DataFrame:
    """Children by parent_id, or by superparent_id."""
    found = nodes.filter((F.col("superparent_id" if supertree else "parent_id") == node_id) & flag("starred", include))
    return found.orderBy(*order_by) if order_by else found


def direct_objects(tables: Tables, node_id: int, offset: int | None = None, limit: int | None = None, order_by: Sequence[Column] | None = None) -> DataFrame:
    """The objects of a node."""
    found = tables.objects.join(tables.assignments.filter(F.col("node_id") == node_id).select("object_id"), "object_id")
    found = found.orderBy(*order_by) if order_by else found
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def n_objects(assignments: DataFrame) -> DataFrame:
    """(node_id, n): the objects of each node that has some."""
    return assignments.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def levels(nodes: DataFrame) -> DataFrame:
    """(node_id, level): each node's distance from its root."""
    return path_fold(nodes, {"level": F.lit(0)}, lambda near, far: {"level": (near("level") + far("level") + 1).cast("int")})


def topological(nodes: DataFrame, order_by_name: bool = False) -> DataFrame:
    """Nodes with a level, parents before children."""
    found = nodes.join(shuffled(levels(nodes)), "node_id")
    return found.orderBy("level", *(["name"] if order_by_name else []), "node_id")


def walk(nodes: DataFrame) -> DataFrame:
    """(node_id, path, children): each node's path and the ids of its children."""
    kids = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list("node_id")).alias("children"))
    return paths(nodes).join(shuffled(kids), "node_id", "left").select("node_id", "path", F.coalesce("children", F.array().cast("array<long>")).alias("children"))


def proper_ancestors(nodes: DataFrame, node_id: int) -> DataFrame:
    """The ancestors of a node, root first, the node left out."""
    return ancestors(nodes, node_id).filter("level < 0").orderBy("level")


def not_done(up, down) -> Column:
    """Descends through nodes that are neither approved nor starred."""
    return ~(F.coalesce(up("approved"), F.lit(False)) | F.coalesce(up("starred"), F.lit(False)))


def tip(nodes: DataFrame, node_id: int) -> DataFrame:
    """The deepest node with children that is reached from a node through nodes neither approved nor starred; the smallest id of several."""
    below = subtree(nodes, node_id, lambda up, down: ~(F.coalesce(down("approved"), F.lit(False)) | F.coalesce(down("starred"), F.lit(False))))
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return below.join(parents, "node_id", "left_semi").orderBy(F.desc("level"), "node_id").limit(1)


def minlevel_starred(nodes: DataFrame, node_id: int) -> DataFrame:
    """The first starred node on each way down from a node."""
    return subtree(nodes, node_id, lambda up, down: ~F.coalesce(up("starred"), F.lit(False))).filter("starred")


def n_sorted(tables: Tables, node_id: int) -> DataFrame:
    """The objects below the nodes of T16."""
    deep = n_objects_deep(tables.nodes, tables.assignments)
    return minlevel_starred(tables.nodes, node_id).join(deep, "node_id").agg(F.coalesce(F.sum("n_objects_deep"), F.lit(0)).alias("n_sorted"))


def next_node(tables: Tables, node_id: int, where: Column, descend: Descend | None = None, leaf: bool = False, preferred_first: bool = False, order_by: str | None = None) -> DataFrame:
    """The best candidate below a node, else below its nearest ancestor that has one.

    Candidates are ranked by preferred (if asked), depth below the ancestor, then their objects ('largest', 'smallest'), then id. All ancestors
    are tried in one plan: a candidate counts for the nearest of them that it can be reached from, and the nearest with a candidate wins."""
    nodes = tables.nodes
    starts = ancestors(nodes, node_id).select("node_id", F.col("level").alias("up"))
    reach = nearest(nodes, starts, descend).join(starts.withColumnRenamed("node_id", "mark"), "mark").select("node_id", "up", F.col("distance").alias("depth"))
    found = nodes.filter(where)
    if leaf:
        found = found.join(nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")
    found = found.join(reach, "node_id").join(n_objects_deep(nodes, tables.assignments), "node_id")
    order = [F.desc("up")]
    if preferred_first:
        order.append(F.desc(F.coalesce("preferred", F.lit(False))))
    order.append(F.desc("depth"))
    if order_by:
        order.append({"largest": F.desc, "smallest": F.asc}[order_by]("n_objects_deep"))
    return found.orderBy(*order, "node_id").limit(1)


def next_unapproved(tables: Tables, node_id: int, leaf: bool = False, preferred_first: bool = False, order_by: str | None = None) -> DataFrame:
    """T17 for unapproved nodes, through unapproved ones only."""
    open_ = lambda up, down: ~F.coalesce(down("approved"), F.lit(False))
    return next_node(tables, node_id, ~F.coalesce(F.col("approved"), F.lit(False)), open_, leaf, preferred_first, order_by)


def next_unfilled(tables: Tables, node_id: int, with_prototypes: DataFrame, leaf: bool = False, preferred_first: bool = False, order_by: str | None = "largest") -> DataFrame:
    """T17 for approved nodes that aren't filled and have prototypes (node_id)."""
    usable = tables.nodes.join(with_prototypes.select("node_id", F.lit(True).alias("usable")).distinct(), "node_id", "left")
    where = F.col("approved") & ~F.coalesce(F.col("filled"), F.lit(False)) & F.coalesce(F.col("usable"), F.lit(False))
    return next_node(tables.with_(nodes=usable), node_id, where, None, leaf, preferred_first, order_by).drop("usable")


def connect_supertree(nodes: DataFrame) -> DataFrame:
    """Nodes with superparent_id: the nearest starred proper ancestor, else the root; null for roots."""
    found = nearest(nodes, nodes.filter("coalesce(starred, false) or parent_id is null")).select(F.col("node_id").alias("parent_id"), F.col("mark").alias("superparent_id"))
    kept = nodes.drop("superparent_id")
    return kept.join(shuffled(found), "parent_id", "left").select(*kept.columns, "superparent_id")


def superchildren(nodes: DataFrame) -> DataFrame:
    """(node_id, n_superchildren) of nodes with superparent_id: how many have a node as their superparent."""
    n = nodes.filter("superparent_id is not null").groupBy(F.col("superparent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_superchildren"))


def unfilled(tables: Tables, with_prototypes: DataFrame, project_id: int | None = None) -> DataFrame:
    """T17b as a table: (node_id, level, n_objects_deep) of all approved nodes that aren't filled and have prototypes (node_id), of one project or of all."""
    found = tables.nodes.filter(F.coalesce("approved", F.lit(False)) & ~F.coalesce("filled", F.lit(False))).join(with_prototypes.select("node_id").distinct(), "node_id", "left_semi")
    if project_id is not None:
        found = found.filter(F.col("project_id") == project_id)
    return found.select("node_id").join(levels(tables.nodes), "node_id").join(n_objects_deep(tables.nodes, tables.assignments), "node_id").select("node_id", "level", "n_objects_deep")


def unconnected(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """(kind, id) of nodes that reach no root, those on cycles too, and objects whose node doesn't exist."""
    top = path_fold(nodes, {"rooted": F.col("parent_id").isNull()}, lambda near, far: {"rooted": far("rooted")}, cycles=True)
    lost = top.filter("not coalesce(rooted, false)").select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("id"))
    return lost.unionByName(objects.join(nodes, "node_id", "left_anti").select(F.lit("object").alias("kind"), F.col("object_id").alias("id")))


def trim_common(paths_: DataFrame) -> DataFrame:
    """(node_id, path) without the prefix that all paths share, but for its last node."""
    flat = paths_.select(F.posexplode("path").alias("pos", "id"))
    n = paths_.agg(F.count(F.lit(1)).alias("n"))
    shared = flat.groupBy("pos").agg(F.count_distinct("id").alias("kinds"), F.count(F.lit(1)).alias("has")).crossJoin(F.broadcast(n))  # one row
    first = shared.filter("kinds > 1 or has < n").agg(F.min("pos").alias("first"))
    most = paths_.agg(F.min(F.size("path")).alias("shortest"))
    cut = first.crossJoin(F.broadcast(most)).select(F.greatest(F.coalesce("first", "shortest") - 1, F.lit(0)).alias("cut"))
    return paths_.crossJoin(F.broadcast(cut)).select("node_id", F.expr("slice(path, cut + 1, size(path))").alias("path"))


def bottom_up(paths_: DataFrame) -> DataFrame:
    """(node_id, depth) of the nodes on the paths, each once, deepest first."""
    return paths_.select(F.posexplode("path").alias("depth", "node_id")).groupBy("node_id").agg(F.max("depth").alias("depth")).orderBy(F.desc("depth"), "node_id")


def progress(tables: Tables, descend_approved: bool = True, starts: DataFrame | None = None) -> DataFrame:
    """One row per start node (by default all roots) with the counts below it, and the same over leaves only.

    An approved node stands for all objects below it, so the deep count of approved objects is the sum over approved nodes without an
    approved ancestor in the subtree; named nodes likewise. Without descend_approved the subtree ends below approved nodes."""
    nodes = tables.nodes
    descend = None if descend_approved else (lambda up, down: ~F.coalesce(up("approved"), F.lit(False)))
    if starts is None:
        starts = nodes.filter("parent_id is null").select("node_id")
    inner = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    own = nodes.select("node_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("approved", "filled")), F.col("name").isNotNull().alias("named"))
    own = written(own.join(shuffled(n_objects_deep(nodes, tables.assignments)), "node_id").join(shuffled(inner), "node_id", "left").withColumn("leaf", F.col("inner").isNull()).drop("inner"), "progress")
    # What counts for a marked node: its objects without those of the next marked ones below it, so that sums over a subtree hold each top one once.
    edges = edges_of(nodes, descend)
    is_marked = {"approved": F.coalesce("approved", F.lit(False)), "named": F.col("name").isNotNull()}
    marks = path_fold(nodes, {c: F.when(cond, F.col("node_id")) for c, cond in is_marked.items()}, lambda near, far: {c: F.coalesce(near(c), far(c)) for c in is_marked}, descend)
    above = marks.select(F.col("node_id").alias("parent_id"), *(F.col(c).alias(f"above_{c}") for c in is_marked))
    handed = F.array(*(F.struct(F.when(F.col(c), F.col(f"above_{c}")).alias("node_id"), *(F.when(F.lit(c == k), F.col("n_objects_deep")).alias(f"below_{k}") for k in is_marked)) for c in is_marked))
    nested = edges.join(shuffled(own.select("node_id", *is_marked, "n_objects_deep")), "node_id").join(shuffled(above), "parent_id").select(F.explode(handed).alias("e")).select("e.*").filter("node_id is not null")
    parts = own.join(shuffled(nested.groupBy("node_id").agg(*(F.sum(f"below_{c}").alias(f"below_{c}") for c in is_marked))), "node_id", "left")
    for c in is_marked:
        parts = parts.withColumn(f"net_{c}", F.when(F.col(c), F.col("n_objects_deep") - F.coalesce(f"below_{c}", F.lit(0))).otherwise(0))
    n, one = F.col("n_objects_deep"), F.lit(1).cast("long")
    when = lambda cond, value: F.when(cond, value).otherwise(0).cast("long")
    summed = {"n_approved_objects": F.col("net_approved"), "n_named_objects": F.col("net_named"), "n_nodes": one, "leaves_n_nodes": when(F.col("leaf"), one), "leaves_n_objects": when(F.col("leaf"), n)}
    for c in ("approved", "filled", "named"):
        summed |= {f"n_{c}_nodes": when(F.col(c), one), f"leaves_n_{c}_objects": when(F.col("leaf") & F.col(c), n), f"leaves_n_{c}_nodes": when(F.col("leaf") & F.col(c), one)}
    total = subtree_sums(nodes, parts.select("node_id", *(v.cast("long").alias(k) for k, v in summed.items())), descend=descend)
    at = own.select("node_id", when(F.col("filled"), n).alias("n_filled_objects"), n.alias("n_objects"))
    kinds = ("approved", "filled", "named")
    order = [f"n_{c}_objects" for c in ("approved", "named", "filled")] + [f"n_{c}_nodes" for c in kinds] + ["n_nodes", "n_objects"]
    order += [f"leaves_n_{c}_objects" for c in kinds] + [f"leaves_n_{c}_nodes" for c in kinds] + ["leaves_n_nodes", "leaves_n_objects"]
    return small(starts.select("node_id").distinct()).join(shuffled(total), "node_id").join(shuffled(at), "node_id").select("node_id", *order)


def node_view(tables: Tables) -> DataFrame:
    """What a service shows of nodes: name or id, path, counts with 0 for none, and a status."""
    kids = tables.nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    found = tables.nodes.join(paths(tables.nodes), "node_id").join(kids, "node_id", "left").join(n_objects(tables.assignments).withColumnRenamed("n", "n_objects"), "node_id", "left")
    found = found.join(n_objects_deep(tables.nodes, tables.assignments), "node_id")
    status = F.when(F.col("starred"), "starred").when(F.col("approved"), "approved").otherwise("other")
    return found.select("node_id", F.coalesce("name", F.col("node_id").cast("string")).alias("name"), "path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_objects", "n_objects_deep")), status.alias("status"))


def export_log(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """The log with the project of each row's node, null where the node is gone."""
    return log.join(nodes.select("node_id", "project_id"), "node_id", "left")



def node(tables: Tables, node_id: int, refresh: bool = False) -> DataFrame:
    """The row of a node, with `refresh` after its statistics were brought up to date; an error if there is none."""
    if refresh:
        from .stats import consolidate

        tables = tables.with_(nodes=consolidate(tables, node_id, 0))
    found = tables.nodes.filter(F.col("node_id") == node_id)
    if found.isEmpty():
        raise LookupError(f"node {node_id} is unknown")
    return found
