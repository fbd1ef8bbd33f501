"""Tables and trees: the DataFrames that operators take and return."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Columns of nodes that a saved tree keeps, besides any other column of its own.
TREE_NODES = ("node_id", "parent_id", "name")
NODES = T.StructType([
    T.StructField("node_id", T.LongType(), False), T.StructField("orig_id", T.LongType()), T.StructField("project_id", T.IntegerType()), T.StructField("parent_id", T.LongType()),
    T.StructField("name", T.StringType()), *(T.StructField(c, T.BooleanType()) for c in ("starred", "approved", "filled", "preferred")), T.StructField("superparent_id", T.LongType()),
])
OBJECTS = T.StructType([T.StructField("object_id", T.StringType(), False), T.StructField("path", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("rand", T.DoubleType())])


@dataclass(frozen=True)
class Tables:
    """The tables of a service: nodes, assignments (node_id, object_id), objects, rejected (node_id, object_id), projects, log."""

    nodes: DataFrame
    assignments: DataFrame
    objects: DataFrame | None = None
    rejected: DataFrame | None = None
    projects: DataFrame | None = None
    log: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Tables:
        return replace(self, **tables)


@dataclass(frozen=True)
class Tree:
    """A tree file: nodes (node_id, parent_id, ...), objects (object_id, node_id), rejected objects, and its metadata."""

    nodes: DataFrame
    objects: DataFrame
    rejected: DataFrame | None = None
    meta: dict = field(default_factory=dict)


class SchemaError(ValueError):
    """A table lacks required columns."""


def check_columns(df: DataFrame, required: tuple[str, ...], what: str) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise SchemaError(f"{what} lacks {', '.join(missing)}")
    return df


def check_tree(tree: Tree) -> Tree:
    """The tree, if each member has its required columns."""
    check_columns(tree.nodes, ("node_id", "parent_id"), "nodes")
    check_columns(tree.objects, ("object_id", "node_id"), "objects")
    if tree.rejected is not None:
        check_columns(tree.rejected, ("object_id", "node_id"), "rejected objects")
    return tree
