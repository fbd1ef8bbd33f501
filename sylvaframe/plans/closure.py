"""Paths and subtrees of a forest by pointer doubling.

A round joins each node's pointer to its 2^k-th ancestor with itself, so a forest of
depth d takes log2(d) rounds, and a chain of a million nodes twenty. What is asked for
travels along: path_fold carries a value for the part of the path that the pointer has
passed, subtree_sums a sum for the part of the subtree below. Both hold one row a node,
not one for each node and ancestor; only closure() makes those pairs. Rounds are
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .shared import shuffled, small, written

#: A predicate over (column of the parent's row, column of the child's row), as functions from a column's name.
Descend = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
#: From (column of the nearer part of a path, column of the farther part), the columns of both together.
Combine = Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]


class CycleError(ValueError):
    """The nodes have a cycle."""


def edges_of(nodes: DataFrame, descend: Descend | None = None, parent: str = "parent_id") -> DataFrame:
    """(node_id, parent_id) of nodes with a parent; with `descend`, only edges for which it holds."""
    if descend is None:
        return nodes.filter(F.col(parent).isNotNull()).select("node_id", F.col(parent).alias("parent_id"))
    up = nodes.select(*(F.col(c).alias(f"up_{c}") for c in nodes.columns))
    joined = nodes.join(shuffled(up), F.col(parent) == F.col("up_node_id"))
    return joined.filter(descend(lambda c: F.col(f"up_{c}"), F.col)).select("node_id", F.col(parent).alias("parent_id"))


def _counted(df: DataFrame, label: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """df as it is written, and for how many of its rows the condition holds."""
    seen = Observation()
    held = written(df.observe(seen, F.count(F.lit(1) if condition is None else F.when(condition, 1)).alias("n")), label)
    return held, seen.get["n"]


def path_fold(nodes: DataFrame, values: dict[str, Column], combine: Combine, descend: Descend | None = None, cycles: bool = False) -> DataFrame:
    """(node_id, *values): for each node, its values combined with those of all nodes on the way up to its root, nearest first; combine must be associative.

    With `descend`, a way ends where an edge may not be followed. A cycle is an error, or with `cycles` its nodes come without values."""
    own = nodes.select("node_id", *(v.alias(k) for k, v in values.items()))
    held, most = _counted(own.join(shuffled(edges_of(nodes, descend).withColumnRenamed("parent_id", "up")), "node_id", "left").select("node_id", "up", *values), "fold")
    more, passed = most, 1
    while more:
        if passed > 2 * most:
            if cycles:
                return held.select("node_id", *(F.when(F.col("up").isNull(), F.col(k)).alias(k) for k in values))
            raise CycleError("the nodes have a cycle")
        far = held.select(F.col("node_id").alias("up"), F.col("up").alias("far_up"), F.lit(True).alias("far"), *(F.col(k).alias(f"far_{k}") for k in values))
        both = combine(F.col, lambda k: F.col(f"far_{k}"))
        # What has reached its end stays where it is, so that the ends don't meet in one task.
        step = held.filter("up is not null").join(shuffled(far), "up", "left").select("node_id", F.col("far_up").alias("up"), *(F.when(F.col("far"), both[k]).otherwise(F.col(k)).alias(k) for k in values))
        step = step.unionByName(held.filter("up is null"))
        held, more = _counted(step, "fold", F.col("up").isNotNull())
        passed *= 2
    return held.select("node_id", *values)


def subtree_sums(nodes: DataFrame, own: DataFrame, by: Sequence[str] = (), descend: Descend | None = None) -> DataFrame:
    """own (node_id, *by, numbers) summed over each node's subtree, the node included; nodes without any below them have no row."""
    keys, numbers = ["node_id", *by], [c for c in own.columns if c not in ("node_id", *by)]
    total = own.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in numbers))
    jump, more = _counted(edges_of(nodes, descend).withColumnRenamed("parent_id", "up"), "jumps")
    limit, passed = 2 * more + 2, 1
    while more:
        if passed > limit:
            raise CycleError("the nodes have a cycle")
        moved = total.join(shuffled(jump), "node_id").select(F.col("up").alias("node_id"), *by, *numbers)
        total = written(total.unionByName(moved).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in numbers)), "sums")
        jump, more = _counted(jump.join(shuffled(jump.select(F.col("node_id").alias("up"), F.col("up").alias("far"))), "up").select("node_id", F.col("far").alias("up")), "jumps")
        passed *= 2
    return total


def closure(nodes: DataFrame, descend: Descend | None = None, parent: str = "parent_id") -> DataFrame:
    """(ancestor_id, node_id, distance) for each node and each of its ancestors, itself included at distance 0: a row for every pair, so for shallow forests, or where the pairs are what is asked for."""
    pairs = nodes.select(F.col("node_id").alias("ancestor_id"), "node_id", F.lit(0).alias("distance"))
    step, more = _counted(edges_of(nodes, descend, parent).select("node_id", F.col("parent_id").alias("up")), "step")
    span, most = 1, more + 1
    while more:
        if span > most:
            raise CycleError("the nodes have a cycle")
        longer = pairs.join(shuffled(step.withColumnRenamed("node_id", "ancestor_id")), "ancestor_id")
        pairs = pairs.unionByName(longer.select(F.col("up").alias("ancestor_id"), "node_id", (F.col("distance") + span).alias("distance")))
        nearer = step.select("node_id", F.col("up").alias("mid"))
        step, more = _counted(nearer.join(shuffled(step.select(F.col("node_id").alias("mid"), "up")), "mid").select("node_id", "up"), "step")
        span *= 2
        if span >= 4:
            pairs = written(pairs, "closure")
    return pairs


def subtree_fold(nodes: DataFrame, own: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """own (node_id, values) merged over each node's subtree, the node included. merge takes rows with several for a node and gives one for each; the order and grouping of its rows must not matter.

    As subtree_sums, in log2(depth) rounds: what is held for a node covers the levels near below it, and a round adds those twice as far. Only nodes that get something are merged."""
    total = written(merge(own), "folded")
    jump, more = _counted(edges_of(nodes).withColumnRenamed("parent_id", "up"), "jumps")
    limit, passed = 2 * more + 2, 1
    while more:
        if passed > limit:
            raise CycleError("the nodes have a cycle")
        moved = written(total.join(shuffled(jump), "node_id").select(F.col("up").alias("node_id"), *(c for c in total.columns if c != "node_id")), "moved")
        takers = shuffled(moved.select("node_id").distinct())
        merged = merge(total.join(takers, "node_id", "left_semi").unionByName(moved))
        total = written(total.join(takers, "node_id", "left_anti").unionByName(merged), "folded")
        jump, more = _counted(jump.join(shuffled(jump.select(F.col("node_id").alias("up"), F.col("up").alias("far"))), "up").select("node_id", F.col("far").alias("up")), "jumps")
        passed *= 2
    return total


def _targets(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(target_id, node_id, distance 0) of the nodes among ids, a frame of one column."""
    asked = ids.select(F.col(ids.columns[0]).cast("long").alias("node_id")).distinct()
    return nodes.join(small(asked), "node_id", "left_semi").select(F.col("node_id").alias("target_id"), "node_id", F.lit(0).alias("distance"))


def _spread(found: DataFrame, nodes: DataFrame, descend: Descend | None, up: bool) -> DataFrame:
    """found (target_id, node_id, distance) with all nodes above, or below, in log2(depth) rounds that all targets share: each round steps from what is there over pointers of that length."""
    jump, more = _counted(edges_of(nodes, descend).withColumnRenamed("parent_id", "up"), "jumps")
    begin, end = ("node_id", "up") if up else ("up", "node_id")
    span, most = 1, more + 1
    while more:
        if span > most:
            raise CycleError("the nodes have a cycle")
        steps = jump.select(F.col(begin).alias("node_id"), F.col(end).alias("end"))
        farther, n = _counted(found.join(shuffled(steps), "node_id").select("target_id", F.col("end").alias("node_id"), (F.col("distance") + span).cast("int").alias("distance")), "way")
        if not n:
            break
        found = written(found.unionByName(farther), "way")
        jump, more = _counted(jump.join(shuffled(jump.select(F.col("node_id").alias("up"), F.col("up").alias("far"))), "up").select("node_id", F.col("far").alias("up")), "jumps")
        span *= 2
    return found


def ways_up(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(target_id, node_id, distance): each of ids (one column) that is a node, and all its ancestors."""
    return _spread(_targets(nodes, ids), nodes, None, True)


def _one(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id).select("node_id")


def ancestors(nodes: DataFrame, node_id: int | DataFrame) -> DataFrame:
    """The node at level 0 and its ancestors at levels -1, -2, ..., with all columns of nodes; for a one-column DataFrame of ids, with target_id."""
    many = isinstance(node_id, DataFrame)
    way = ways_up(nodes, node_id if many else _one(nodes, node_id)).select(*(["target_id"] if many else []), "node_id", (-F.col("distance")).alias("level"))
    return nodes.join(small(way), "node_id")


def paths(nodes: DataFrame, node_id: int | DataFrame | None = None) -> DataFrame:
    """(node_id, path): the ids from the root to each node, to one, or to those in a one-column DataFrame."""
    if node_id is not None:
        way = ways_up(nodes, node_id if isinstance(node_id, DataFrame) else _one(nodes, node_id))
        rows = way.groupBy(F.col("target_id").alias("at")).agg(F.sort_array(F.collect_list(F.struct("distance", "node_id")), asc=False).alias("p"))
        return rows.select(F.col("at").alias("node_id"), F.col("p.node_id").alias("path"))
    return path_fold(nodes, {"path": F.array("node_id")}, lambda near, far: {"path": F.concat(far("path"), near("path"))})


def nearest(nodes: DataFrame, marks: DataFrame, descend: Descend | None = None) -> DataFrame:
    """(node_id, mark, distance): the nearest of marks (node_id) on each node's way up, itself included, and how far it is; only nodes that have one."""
    marked = nodes.join(small(marks.select("node_id", F.lit(True).alias("is_mark")).distinct()), "node_id", "left")
    values = {"mark": F.when(F.col("is_mark"), F.col("node_id")), "distance": F.when(F.col("is_mark"), F.lit(0)), "n": F.lit(1)}
    both = lambda near, far: {"mark": F.coalesce(near("mark"), far("mark")), "distance": F.coalesce(near("distance"), (near("n") + far("distance")).cast("int")), "n": (near("n") + far("n")).cast("int")}
    return path_fold(marked, values, both, descend).filter("mark is not null").select("node_id", "mark", "distance")


def subtree(nodes: DataFrame, node_id: int | DataFrame, descend: Descend | None = None) -> DataFrame:
    """The node and its descendants with their level below it; `descend` decides which edges are followed. For a one-column DataFrame of ids, with target_id: each one's subtree, though they may lie in one another."""
    if isinstance(node_id, DataFrame):
        below = _spread(_targets(nodes, node_id), nodes, descend, False).select("target_id", "node_id", F.col("distance").alias("level"))
    else:
        below = nearest(nodes, _one(nodes, node_id), descend).select("node_id", F.col("distance").alias("level"))
    return nodes.join(shuffled(below), "node_id")
