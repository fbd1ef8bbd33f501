"""Flat labels of objects from the names on their way down the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.closure import path_fold
from ..plans.shared import shuffled
from ..schema import Tree


def node_labels(nodes: DataFrame, clean_name: bool = True, compat: bool = False) -> DataFrame:
    """(node_id, label) of nodes below the root. The label joins the names from below the root down to the first unnamed node, which has its parent's label, as has all below it.

    With clean_name the first name stands whole, and of each further name the components (between slashes) that the label before it holds already, as
    a part of it, are left out. Nodes without any name on their way have no label; with `compat` they have an empty one."""
    # The names of a node and those above it down to the first null, without the root's, root first. A cleaned label has all components of the names
    # before, so a name of components that all stand before it adds nothing, and a list holds no more names than there are components on a way.
    below, named = F.col("parent_id").isNotNull(), F.col("name") != "" if clean_name else F.col("name").isNotNull()
    way = F.when(below & named, F.array("name")).otherwise(F.array().cast("array<string>"))
    values = {"names": way, "seen": F.array_distinct(F.flatten(F.transform(way, lambda n: F.split(n, "/")))), "stopped": below & F.col("name").isNull()}

    def both(near, far):
        more = F.filter(near("names"), lambda n: F.size(F.array_except(F.split(n, "/"), far("seen"))) > 0) if clean_name else near("names")
        kept = lambda c, joined: F.when(far("stopped"), far(c)).otherwise(joined)
        return {"names": kept("names", F.concat(far("names"), more)), "seen": kept("seen", F.array_union(far("seen"), near("seen"))), "stopped": far("stopped") | near("stopped")}

    listed = path_fold(nodes, values if clean_name else values | {"seen": F.array().cast("array<string>")}, both)
    listed = listed.join(shuffled(nodes.filter("parent_id is not null").select("node_id")), "node_id", "left_semi")
    used = F.col("names")
    if clean_name:
        further = lambda acc, name: F.concat_ws("/", F.array(acc), F.filter(F.split(name, "/"), lambda c: F.instr(acc, c) == 0))
        label = F.aggregate(used, F.lit(""), lambda acc, name: F.when(acc == "", name).otherwise(further(acc, name)))
    else:
        label = F.concat_ws("/", used)
    found = listed.select("node_id", label.alias("label"))
    return found if compat else found.filter("label <> ''")


def flat_labels(tree: Tree, clean_name: bool = True, compat: bool = False) -> DataFrame:
    """(object_id, label) of the objects below the root that have a label."""
    return tree.objects.join(shuffled(node_labels(tree.nodes, clean_name, compat)), "node_id").select("object_id", "label")
