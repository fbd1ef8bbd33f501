"""Editing trees: tables in, new tables out. The caller writes them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.closure import ancestors, subtree_sums
from ..plans.shared import written
from ..schema import Tables
from .query import children

FLAGS = ("starred", "approved", "filled", "preferred")


class EditError(ValueError):
    """An edit that would break the tree."""


def ids_frame(like: DataFrame, ids: Iterable | DataFrame, name: str) -> DataFrame:
    """Ids as a one-column DataFrame; a DataFrame stays one."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    kind = like.schema[name].dataType.simpleString()
    return like.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], f"{name} {kind}")


def _where_in(df: DataFrame, ids: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """df with columns changed in the rows whose key is in ids."""
    marked = df.join(ids.select(F.col(key), F.lit(True).alias("__in")), key, "left")
    out = marked.select(*(F.when(F.col("__in"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))
    return out


def create_project(tables: Tables, name: str, visible: bool = True) -> Tables:
    """M1: one more project, with the next id."""
    new = tables.projects.agg((F.coalesce(F.max("project_id"), F.lit(0)) + 1).cast("int").alias("project_id")).select("project_id", F.lit(name).alias("name"), F.lit(visible).alias("visible"))
    return tables.with_(projects=tables.projects.unionByName(new, allowMissingColumns=True))


def next_node_id(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0] + 1


def create_node(tables: Tables, parent_id: int | None = None, project_id: int | None = None, orig_parent: int | None = None, name: str | None = None, object_ids=None, node_ids=None, **flags: bool) -> tuple[Tables, int]:
    """M2: one more node, and what moves into it. The parent is given by its id or its orig_id; the project is the parent's."""
    nodes = tables.nodes
    if orig_parent is not None:
        found = nodes.filter((F.col("orig_id") == orig_parent) & (F.lit(project_id is None) | (F.col("project_id") == F.lit(project_id)))).select("node_id").limit(1).collect()
        if not found:
            raise EditError(f"no node has orig_id {orig_parent}")
        parent_id = found[0][0]
    if parent_id is not None:
        found = nodes.filter(F.col("node_id") == parent_id).select("project_id").limit(1).collect()
        if not found:
            raise EditError(f"no node {parent_id}")
        project_id = found[0][0] if project_id is None else project_id
    if project_id is None:
        raise EditError("a node needs a project")
    if set(flags) - set(FLAGS):
        raise EditError(f"unknown columns: {set(flags) - set(FLAGS)}")
    node_id = next_node_id(nodes)
    row = {"node_id": node_id, "parent_id": parent_id, "project_id": project_id, "name": name} | dict.fromkeys(FLAGS, False) | flags
    kept = [f for f in nodes.schema.fields if f.name in row]
    new = nodes.sparkSession.range(1).select(*(F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kept))
    out = tables.with_(nodes=nodes.unionByName(new, allowMissingColumns=True))
    if node_ids is not None:
        out = relocate_nodes(out, node_ids, node_id)
    if object_ids is not None:
        out = relocate_objects(out, object_ids, node_id)
    return out, node_id


def invalidate_path(nodes: DataFrame, node_ids: Iterable | DataFrame, unapprove: bool = False) -> DataFrame:
    """Nodes with cache_valid false on the paths of the given nodes; `unapprove` clears approved as well."""
    ids = ids_frame(nodes, node_ids, "node_id")
    stale = subtree_sums(nodes, ids.select("node_id", F.lit(1).alias("n"))).select("node_id")
    return invalidate(nodes, stale, unapprove)


def invalidate(nodes: DataFrame, node_ids: Iterable | DataFrame, unapprove: bool = False) -> DataFrame:
    """Nodes with cache_valid false in the given rows."""
    if "cache_valid" not in nodes.columns:
        nodes = nodes.withColumn("cache_valid", F.lit(True))
    changes = {"cache_valid": F.lit(False)} | ({"approved": F.lit(False)} if unapprove else {})
    return _where_in(nodes, ids_frame(nodes, node_ids, "node_id"), "node_id", changes)


def stale_of_move(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(node_id) of what a move between the nodes `ends` (node_id) changes: their paths from the deepest node on that all of them share, that node included. Ends without a common root have their whole paths."""
    ids = ends.distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    through = written(subtree_sums(nodes, ids.select("node_id", F.lit(1).alias("n"))), "through")
    common = through.join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n"))), "n").select("node_id")  # one row; the nodes that all ends are below
    above = nodes.join(common, "node_id", "left_semi").select(F.col("parent_id").alias("node_id"))
    return through.select("node_id").join(above, "node_id", "left_anti")


def _same_project(nodes: DataFrame, node_id: int) -> DataFrame:
    """(node_id) of the nodes in the project of a node; all, where nodes have no projects."""
    if "project_id" not in nodes.columns:
        return nodes.select("node_id")
    own = nodes.filter(F.col("node_id") == node_id).select(F.col("project_id").alias("__own")).limit(1)
    return nodes.join(F.broadcast(own), F.col("project_id").eqNullSafe(F.col("__own")), "left_semi").select("node_id")


def relocate_nodes(tables: Tables, node_ids: Iterable | DataFrame, parent_id: int, unapprove: bool = False) -> Tables:
    """M3: nodes under another parent; an error if one of them lies on the new parent's path. What the move changes, from the deepest node on that the old and new parents share, becomes stale, and unapproved with `unapprove`."""
    nodes = tables.nodes
    ids = ids_frame(nodes, node_ids, "node_id")
    if ancestors(nodes, parent_id).join(ids, "node_id", "left_semi").limit(1).count():
        raise EditError("a node can't move below itself")
    marked = nodes
    if "cache_valid" in nodes.columns or unapprove:
        moved = nodes.join(ids, "node_id", "left_semi")
        new = nodes.filter(F.col("node_id") == parent_id).select("node_id").join(F.broadcast(moved.limit(1).select(F.lit(True).alias("__any"))), F.col("__any")).select("node_id")  # one row
        marked = invalidate(nodes, stale_of_move(nodes, new.unionByName(moved.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")))), unapprove)
    return tables.with_(nodes=_where_in(marked, ids, "node_id", {"parent_id": F.lit(parent_id).cast("long")}))


def relocate_objects(tables: Tables, object_ids: Iterable | DataFrame, node_id: int, src_node_id: int | None = None, unapprove: bool = False) -> Tables:
    """M4: objects to another node, optionally only those that are in src_node_id. Rows of other projects than the node's stay as they are; stale as M3."""
    assigned, nodes = tables.assignments, tables.nodes
    ids = ids_frame(assigned, object_ids, "object_id").select("object_id", F.lit(True).alias("__asked"))
    inside = _same_project(nodes, node_id).select("node_id", F.lit(True).alias("__inside"))
    here = F.col("__inside") & F.col("__asked")
    if src_node_id is not None:
        here = here & (F.col("node_id") == src_node_id)
    marked = assigned.join(ids, "object_id", "left").join(inside, "node_id", "left").withColumn("__moves", F.coalesce(here, F.lit(False)))
    if "cache_valid" in nodes.columns or unapprove:
        old = marked.filter("__moves").select("node_id").distinct()
        new = nodes.filter(F.col("node_id") == node_id).select("node_id").join(F.broadcast(ids.limit(1)), F.col("__asked")).select("node_id")  # one row
        nodes = invalidate(nodes, stale_of_move(nodes, new.unionByName(old)), unapprove)
    to = F.when(F.col("__moves"), F.lit(node_id).cast("long")).otherwise(F.col("node_id"))
    return tables.with_(nodes=nodes, assignments=marked.select(*(to.alias(c) if c == "node_id" else F.col(c) for c in assigned.columns)))


def reject_objects(tables: Tables, node_id: int, object_ids: Iterable | DataFrame) -> Tables:
    """M5: (node, object) pairs appended to the rejected ones."""
    ids = ids_frame(tables.rejected, object_ids, "object_id")
    return tables.with_(rejected=tables.rejected.unionByName(ids.select(F.lit(node_id).cast("long").alias("node_id"), "object_id")))


def merge_node_into(tables: Tables, node_id: int, dest: int) -> Tables:
    """M6: a node's objects and children go to another node, and the node goes."""
    if ancestors(tables.nodes, dest).filter(F.col("node_id") == node_id).limit(1).count():
        raise EditError("a node can't merge into its own subtree")
    nodes = invalidate_path(tables.nodes, [dest]) if "cache_valid" in tables.nodes.columns else tables.nodes
    moved = nodes.filter(F.col("node_id") != node_id).withColumn("parent_id", F.when(F.col("parent_id") == node_id, F.lit(dest).cast("long")).otherwise(F.col("parent_id")))
    return tables.with_(nodes=moved, assignments=tables.assignments.withColumn("node_id", F.when(F.col("node_id") == node_id, F.lit(dest).cast("long")).otherwise(F.col("node_id"))))


def update_node(tables: Tables, node_id: int, /, **columns) -> Tables:
    """M7: columns of one node; its ids aren't among them."""
    if bad := {"node_id", "parent_id"} & set(columns) or set(columns) - set(tables.nodes.columns):
        raise EditError(f"can't set {bad}")
    kinds = {f.name: f.dataType for f in tables.nodes.schema.fields}
    here = F.col("node_id") == node_id
    return tables.with_(nodes=tables.nodes.withColumns({c: F.when(here, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in columns.items()}))


def reset_grown(tables: Tables, project_id: int) -> Tables:
    """M8: filled false in a project."""
    return tables.with_(nodes=tables.nodes.withColumn("filled", F.when(F.col("project_id") == project_id, F.lit(False)).otherwise(F.col("filled"))))


def clear_cache(nodes: DataFrame) -> DataFrame:
    """Null in every cached column (those that begin with _), cache_valid false."""
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    return nodes.withColumns({c: F.lit(None).cast(kinds[c]) for c in nodes.columns if c.startswith("_")} | {"cache_valid": F.lit(False)})


def accept_recommended(tables: Tables, node_id: int, paged: DataFrame, last_page: int, rejected_ids: Iterable | DataFrame, log_data: str | None = None) -> tuple[Tables, DataFrame]:
    """Objects of the pages up to last_page (object_id, rank, page) move to the node, but the rejected ones, which are noted. Also (object_id, rank, rejected) in rank order."""
    seen = paged.filter(F.col("page") <= last_page)
    no = ids_frame(tables.rejected, rejected_ids, "object_id")
    stats = accept_reject_stats(seen, no)
    out = relocate_objects(tables, stats.filter("not rejected").select("object_id"), node_id)
    out = reject_objects(out, node_id, stats.filter("rejected").select("object_id"))
    if out.log is not None:
        out = append_log(out, "accept_recommended_objects", node_id, log_data)
    return out, stats


def accept_reject_stats(ranked: DataFrame, rejected_ids: DataFrame) -> DataFrame:
    """(object_id, rank, rejected) in rank order."""
    flags = rejected_ids.select("object_id", F.lit(True).alias("__no"))
    return ranked.join(flags, "object_id", "left").select("object_id", "rank", F.coalesce("__no", F.lit(False)).alias("rejected")).orderBy("rank")


def adopt(tables: Tables, parent_id: int, node_ids: Iterable | DataFrame | None = None, object_ids: Iterable | DataFrame | None = None) -> Tables:
    """Nodes and objects to a parent."""
    out = relocate_nodes(tables, node_ids, parent_id) if node_ids is not None else tables
    return relocate_objects(out, object_ids, parent_id) if object_ids is not None else out


def append_log(tables: Tables, action: str, node_id: int | None = None, data: str | dict | list | None = None, username: str | None = None, reverse_action: str | None = None) -> Tables:
    """One more row of the log; data that isn't a string is written as JSON."""
    log = tables.log
    data = data if data is None or isinstance(data, str) else json.dumps(data)
    row = {"action": action, "node_id": node_id, "data": data, "username": username, "reverse_action": reverse_action}
    new = log.agg((F.coalesce(F.max("log_id"), F.lit(-1)) + 1).alias("log_id"))
    for f in log.schema.fields:
        if f.name != "log_id":
            new = new.withColumn(f.name, F.current_timestamp().cast(f.dataType) if f.name == "timestamp" else F.lit(row.get(f.name)).cast(f.dataType))
    return tables.with_(log=log.unionByName(new.withColumn("log_id", F.col("log_id").cast(log.schema["log_id"].dataType))))


def log_data(log: DataFrame, schema: str) -> DataFrame:
    """the log with its data read as JSON of the given schema; null where it isn't."""
    return log.withColumn("data", F.from_json("data", schema))


def drop_project(tables: Tables, project_id: int) -> Tables:
    """A project, its nodes and what hangs on them go; the log keeps its rows without a node."""
    gone = tables.nodes.filter(F.col("project_id") == project_id).select("node_id")
    keep = lambda df: None if df is None else df.join(gone, "node_id", "left_anti")
    log = tables.log
    if log is not None:
        log = _where_in(log, gone, "node_id", {"node_id": F.lit(None).cast(log.schema["node_id"].dataType)})
    projects = tables.projects.filter(F.col("project_id") != project_id) if tables.projects is not None else None
    return tables.with_(nodes=keep(tables.nodes), assignments=keep(tables.assignments), rejected=keep(tables.rejected), projects=projects, log=log)


def classify_members(tables: Tables, node_id: int, centroids: DataFrame, classify_nodes: bool = True, classify_objects: bool = False, safe: bool = True, subnode: bool = False) -> tuple[Tables, DataFrame]:
    """Unstarred children (by centroids: node_id, vector) and direct objects of a node go to its starred children, the nearest by centroid, or to a new child `classified` of it. The node and those that got members are unapproved, and stale.

    Also (kind, member_id, type_id) of all that were classified; -1 stays."""
    from .vector import classify

    starred = children(tables.nodes, node_id, "starred").select("node_id")
    types = centroids.join(starred, "node_id", "left_semi").filter("vector is not null").select(F.col("node_id").alias("type_id"), "vector")
    found = []
    if classify_nodes:
        open_ = children(tables.nodes, node_id, "unstarred").select("node_id")
        points = centroids.join(open_, "node_id", "left_semi").filter("vector is not null").select(F.col("node_id").cast("string").alias("object_id"), "vector")
        found.append(classify(types, points, safe).select(F.lit("node").alias("kind"), F.col("object_id").alias("member_id"), "type_id"))
    if classify_objects:
        points = tables.objects.join(tables.assignments.filter(F.col("node_id") == node_id).select("object_id"), "object_id").filter("vector is not null").select("object_id", "vector")
        found.append(classify(types, points, safe).select(F.lit("object").alias("kind"), F.col("object_id").alias("member_id"), "type_id"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    moved = every.filter("type_id <> -1")
    target = moved.select("kind", "member_id", F.col("type_id").alias("target"))
    nodes, out = tables.nodes, tables
    if subnode:
        top = next_node_id(nodes)
        used = moved.select("type_id").distinct().select("type_id", (F.rank().over(_by("type_id")) + top - 1).cast("long").alias("new_id"))
        row = used.join(nodes.select(F.col("node_id").alias("type_id"), "project_id"), "type_id").select(F.col("new_id").alias("node_id"), F.col("type_id").alias("parent_id"), "project_id", F.lit("classified").alias("name"), *(F.lit(False).alias(c) for c in FLAGS if c in nodes.columns))
        nodes = nodes.unionByName(row, allowMissingColumns=True)
        target = moved.join(used, "type_id").select("kind", "member_id", F.col("new_id").alias("target"))
    of_nodes = target.filter("kind = 'node'").select(F.col("member_id").cast("long").alias("node_id"), F.col("target").cast("long"))
    nodes = nodes.join(of_nodes, "node_id", "left").withColumn("parent_id", F.coalesce("target", "parent_id")).drop("target").select(*nodes.columns)
    of_objects = target.filter("kind = 'object'").select(F.col("member_id").alias("object_id"), F.col("target").cast("long"))
    # Only what stands in the node itself moves; other projects can hold the same objects.
    here = F.when(F.col("node_id") == node_id, F.col("target"))
    assigned = tables.assignments.join(of_objects, "object_id", "left").withColumn("node_id", F.coalesce(here, "node_id")).select(*tables.assignments.columns)
    # The node is the common ancestor of all these moves.
    touched = moved.select(F.explode(F.array(F.lit(node_id).cast("long"), F.col("type_id").cast("long"))).alias("node_id")).unionByName(target.select(F.col("target").cast("long").alias("node_id")))
    nodes = invalidate(nodes, touched.distinct(), True) if "cache_valid" in nodes.columns else _where_in(nodes, touched.distinct(), "node_id", {"approved": F.lit(False)})
    return out.with_(nodes=nodes, assignments=assigned), every


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over the types of one node
