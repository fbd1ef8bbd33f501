"""Reading and writing trees, objects, features and labels."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import truncate as first_dims
from ..operators.labels import flat_labels
from ..plans.closure import subtree
from ..plans.shared import written
from ..schema import Tables, Tree, check_columns, check_tree


class DuplicateIds(ValueError):
    """Ids that should be unique aren't."""


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, path) of an index CSV; an error that names ids if object_id isn't unique."""
    raw = spark.read.option("header", True).csv(path)
    index = check_columns(raw, ("object_id", "path"), "the index").select("object_id", "path")
    if double := duplicates(index).limit(20).collect():
        raise DuplicateIds(", ".join(r.object_id for r in double))
    return index


def duplicates(index: DataFrame) -> DataFrame:
    """(object_id, n) of ids that occur more than once."""
    return index.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def upsert_objects(objects: DataFrame, index: DataFrame, add: bool = True, update: bool = True) -> DataFrame:
    """Objects with the rows of an index added and the paths of known ones updated."""
    new = index.select("object_id", F.col("path").alias("path_new"))
    both = objects.withColumn("__old", F.lit(True)).join(new, "object_id", "full" if add else "left")
    path = F.coalesce("path_new", "path") if update else F.when(F.col("__old"), F.col("path")).otherwise(F.col("path_new"))
    return both.select(*(path.alias("path") if c == "path" else F.col(c) for c in objects.columns))


def read_features(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(object_id, features) of one feature dataset or several, one after the other."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(F.col("object_id").cast("string").alias("object_id"), "features")


def set_features(objects: DataFrame, *features: DataFrame, truncate: int | None = None, pca: int | None = None, max_dim: int | None = None, clear: bool = False) -> DataFrame:
    """S3: objects with vectors set from features (object_id, features); ids that objects lack are ignored. `clear` empties the others.

    Of several rows of an id, the one of the last dataset that has it stands; of those within it, the one with the largest features."""
    numbered = [f.select("object_id", "features", F.lit(k).alias("__file")) for k, f in enumerate(features)]
    rows = numbered[0]
    for f in numbered[1:]:
        rows = rows.unionByName(f)
    rows = rows.groupBy("object_id").agg(F.max(F.struct("__file", "features")).alias("__last")).select("object_id", "__last.features")
    if truncate:
        rows = rows.withColumn("features", first_dims(F.col("features"), truncate))
    if pca:
        from ..operators.vector import pca as project

        rows = project(rows, pca, "features", "features")[0].select("object_id", "features")
    if max_dim is not None and (n := rows.agg(F.max(F.size("features"))).first()[0] or 0) > max_dim:
        raise ValueError(f"vectors have {n} dimensions; {max_dim} are allowed")
    new = rows.select("object_id", F.transform("features", lambda x: x.cast("double")).alias("__v"))
    found = objects.join(new, "object_id", "left")
    return found.withColumn("vector", F.col("__v") if clear else F.coalesce("__v", "vector")).select(*objects.columns)


def with_rand(objects: DataFrame, seed: int = 0) -> DataFrame:
    """objects with the stored random number `rand` in 0..1, made of their ids so that it can be made again; numbers that are there stay."""
    made = F.pmod(F.xxhash64("object_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return objects.withColumn("rand", F.coalesce("rand", made) if "rand" in objects.columns else made)


def vector_counts(objects: DataFrame) -> DataFrame:
    """S3: one row (n_set, n_total)."""
    return objects.agg(F.count("vector").alias("n_set"), F.count(F.lit(1)).alias("n_total"))


def write_tree(tree: Tree, path: str, meta: dict | None = None) -> None:
    """The members of a tree as Parquet folders and its metadata, merged with `meta`, as JSON."""
    spark = check_tree(tree).nodes.sparkSession
    tree.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    tree.objects.write.mode("overwrite").parquet(f"{path}/objects")
    if tree.rejected is not None:
        tree.rejected.write.mode("overwrite").parquet(f"{path}/rejected_objects")
    spark.createDataFrame([(json.dumps(tree.meta | (meta or {})),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_tree(spark: SparkSession, path: str) -> Tree:
    """What write_tree wrote; the metadata also say where it came from."""
    from pyspark.errors import AnalysisException

    def optional(read):
        try:
            return read()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    meta = optional(lambda: spark.read.text(f"{path}/meta", wholetext=True).first())
    rejected = optional(lambda: spark.read.parquet(f"{path}/rejected_objects"))
    found = json.loads(meta[0]) if meta else {}
    return check_tree(Tree(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/objects"), rejected, found | {"base": path}))


def tree_of(nodes: DataFrame, objects: DataFrame, **meta) -> Tree:
    return Tree(nodes.select(F.col("node_id").cast("long"), F.col("parent_id").cast("long"), "name"), objects.select("object_id", F.col("node_id").cast("long")), None, meta)


def tree_from_collection(df: DataFrame, unlabeled: DataFrame | None = None) -> Tree:
    """A node for each label of rows (object_id, label), numbered from 0 in the order of labels; the root comes after them and holds the unlabelled objects. Rows without a label vanish."""
    known = df.filter("label is not null")
    names = written(known.select("label").distinct().withColumn("node_id", F.dense_rank().over(Window.orderBy("label")) - 1), "labels")  # one row per label
    n = names.count()
    nodes = names.select("node_id", F.lit(n).alias("parent_id"), F.col("label").alias("name")).unionByName(_root(df, n))
    objects = known.join(names, "label").select("object_id", "node_id")
    if unlabeled is not None:
        objects = objects.unionByName(unlabeled.select("object_id", F.lit(n).alias("node_id")))
    return tree_of(nodes, objects)


def _root(like: DataFrame, node_id: int) -> DataFrame:
    return like.sparkSession.range(1).select(F.lit(node_id).alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("name"))


def tree_from_labels(df: DataFrame, noise: str = "root") -> Tree:
    """A node for each label of rows (object_id, label); the root is the largest label + 1. Label -1 is the root's, or with noise='node' a node as any other."""
    top = (df.agg(F.max("label")).first()[0] or 0) + 1 if not df.isEmpty() else 0
    kept = df.filter("label <> -1") if noise == "root" else df
    nodes = kept.select(F.col("label").cast("long").alias("node_id")).distinct().select("node_id", F.lit(top).alias("parent_id"), F.lit(None).cast("string").alias("name")).unionByName(_root(df, top))
    node = F.when(F.col("label") == -1, F.lit(top)).otherwise(F.col("label")) if noise == "root" else F.col("label")
    return tree_of(nodes, df.select("object_id", node.alias("node_id")))


def tree_from_cluster_labels(df: DataFrame, all_ids: DataFrame | None = None) -> Tree:
    """As S8 with -1 as any other label; ids that have no label go to the root."""
    tree = tree_from_labels(df, noise="node")
    if all_ids is None:
        return tree
    root = tree.nodes.filter("parent_id is null").select("node_id")
    lost = all_ids.select("object_id").join(df.select("object_id"), "object_id", "left_anti").crossJoin(F.broadcast(root))  # one row
    return Tree(tree.nodes, tree.objects.unionByName(lost.select("object_id", "node_id")), None, tree.meta)


def tree_from_condensed(edges: DataFrame, ids: DataFrame) -> Tree:
    """Of rows (parent, child, child_size) those of size over 1 are nodes and the others objects, whose child is the position in ids (position, object_id); the smallest parent is the root."""
    root = edges.agg(F.min("parent")).first()[0]
    nodes = edges.filter("child_size > 1").select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), F.lit(None).cast("string").alias("name")).unionByName(_root(edges, root))
    objects = edges.filter("child_size = 1").select(F.col("child").alias("position"), F.col("parent").alias("node_id")).join(ids, "position").select("object_id", "node_id")
    return tree_of(nodes, objects)


def fix_export_index(spark: SparkSession, path: str, delimiter: str = "\t", encoding: str = "UTF-8") -> DataFrame:
    """(object_id, path) of all export files that path matches: a first row of types ([t] or [f]) goes, and paths get their file's folder."""
    raw = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).csv(path).withColumn("file", F.col("_metadata.file_path"))
    raw = check_columns(raw, ("object_id", "img_file_name"), "the export")
    is_type = F.lower(F.coalesce("object_id", F.lit(""))).isin("[t]", "[f]")
    folder = F.regexp_extract("file", r"^(?:[a-zA-Z]+:/*)?(/.*)/[^/]*$", 1)
    return raw.filter(~is_type).select("object_id", F.concat_ws("/", folder, "img_file_name").alias("path"))


def load_project(tables: Tables, tree: Tree, project_id: int, first_node_id: int | None = None) -> Tables:
    """A tree file as a project: fresh node ids in parent-first order, orig_id from the file, parents by orig_id; flags only where they aren't null. A node whose parent the file lacks is an error."""
    from ..operators.query import levels
    from ..operators.rank import numbered

    top = tables.nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0] + 1 if first_node_id is None else first_node_id
    if tree.nodes.filter("parent_id is not null").join(tree.nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti").limit(1).count():
        raise ValueError("a node's parent isn't in the tree")
    order = numbered(tree.nodes.join(levels(tree.nodes), "node_id"), "level", "node_id", name="__n").withColumn("__id", (F.col("__n") + top).cast("long"))
    ids = order.select(F.col("node_id").alias("__orig"), "__id")
    nodes = order.drop("orig_id").withColumnRenamed("node_id", "orig_id").withColumnRenamed("__id", "node_id").join(ids.select(F.col("__orig").alias("parent_id"), F.col("__id").alias("__parent")), "parent_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) if c in tree.nodes.columns else F.lit(False).alias(c) for c in ("starred", "approved", "filled", "preferred") if c in tables.nodes.columns]
    new = nodes.select("node_id", "orig_id", F.lit(project_id).alias("project_id"), F.col("__parent").alias("parent_id"), "name", *flags)
    objects = tree.objects.join(ids.select(F.col("__orig").alias("node_id"), "__id"), "node_id").select(F.col("__id").alias("node_id"), "object_id")
    return tables.with_(nodes=tables.nodes.unionByName(new, allowMissingColumns=True), assignments=tables.assignments.unionByName(objects, allowMissingColumns=True))


def id_offset(nodes: DataFrame, tree: Tree, project_id: int) -> int:
    """What to add to a file's ids so that they follow the project's."""
    most = nodes.filter(F.col("project_id") == project_id).agg(F.max("orig_id")).first()[0]
    least = tree.nodes.agg(F.min("node_id")).first()[0] or 0
    return (0 if most is None else most + 1) - least


def update_project(tables: Tables, project_id: int, tree: Tree) -> Tables:
    """A tree file merged into a project: its root's children hang under the project's root, and only objects that still are at that root move."""
    from ..operators.query import root_id

    root = root_id(tables.nodes, project_id)
    held = tables.with_(assignments=tables.assignments.filter("false"))
    loaded = load_project(held, tree, project_id)
    new = loaded.nodes.join(tables.nodes.select("node_id"), "node_id", "left_anti")
    file_root = new.filter("parent_id is null").select("node_id")
    new = new.join(file_root, "node_id", "left_anti").join(file_root.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("__top")), "parent_id", "left")
    new = new.withColumn("parent_id", F.when(F.col("__top"), F.lit(root).cast("long")).otherwise(F.col("parent_id"))).select(*tables.nodes.columns)
    to = loaded.assignments.join(file_root, "node_id", "left_anti").select("object_id", F.col("node_id").alias("__to"))
    moved = tables.assignments.join(to, "object_id", "left").withColumn("node_id", F.when((F.col("node_id") == root) & F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("node_id")))
    return tables.with_(nodes=tables.nodes.unionByName(new), assignments=moved.select(*tables.assignments.columns))


def dump_tree(tables: Tables, root_id: int) -> Tree:
    """The subtree of a node with its counts, objects and rejected objects."""
    from ..operators.stats import counts

    below = subtree(tables.nodes, root_id)
    kept = [c for c in ("node_id", "orig_id", "parent_id", "name", "starred", "filled", "approved") if c in below.columns]
    nodes = below.select(*kept).withColumn("parent_id", F.when(F.col("node_id") != root_id, F.col("parent_id"))).join(counts(tables), "node_id")
    nodes = nodes.withColumnsRenamed({"n_children": "_n_children", "n_objects": "_n_objects", "n_objects_deep": "_n_objects_deep"})
    inside = below.select("node_id")
    rejected = tables.rejected.join(inside, "node_id", "left_semi").select("object_id", "node_id") if tables.rejected is not None else None
    return Tree(nodes, tables.assignments.join(inside, "node_id", "left_semi").select("object_id", "node_id"), rejected, {"root": root_id})


def export_labels(tree: Tree, path: str, clean_name: bool = True) -> None:
    """object_id,label as CSV."""
    flat_labels(tree, clean_name).write.mode("overwrite").option("header", True).csv(path)


def export_direct_objects(tables: Tables, node_id: int, path: str) -> None:
    """The ids of a node's objects, one a line."""
    tables.assignments.filter(F.col("node_id") == node_id).select("object_id").write.mode("overwrite").text(path)


def edges(nodes: DataFrame) -> DataFrame:
    """(parent_id, node_id), the root's null edge included."""
    return nodes.select("parent_id", "node_id")


def offset_ids(tree: Tree, n: int) -> Tree:
    """A tree with n added to all node ids."""
    add = lambda c: (F.col(c) + n).alias(c)
    nodes = tree.nodes.select(*(add(c) if c in ("node_id", "parent_id") else F.col(c) for c in tree.nodes.columns))
    move = lambda df: None if df is None else df.select(*(add(c) if c == "node_id" else F.col(c) for c in df.columns))
    return Tree(nodes, move(tree.objects), move(tree.rejected), tree.meta)


def merge_trees(a: Tree, b: Tree) -> Tree:
    """b's nodes after a's; b's root goes and its children and objects are a's root's; objects in both are where b has them."""
    most, least = a.nodes.agg(F.max("node_id")).first()[0], b.nodes.agg(F.min("node_id")).first()[0]
    moved = offset_ids(b, (most + 1 if most is not None else 0) - (least or 0))
    roots = [t.nodes.filter("parent_id is null").select("node_id").first()[0] for t in (a, moved)]
    swap = lambda c: F.when(F.col(c) == roots[1], F.lit(roots[0]).cast("long")).otherwise(F.col(c))
    nodes = a.nodes.unionByName(moved.nodes.filter(F.col("node_id") != roots[1]).withColumn("parent_id", swap("parent_id")), allowMissingColumns=True)
    objects = a.objects.join(b.objects.select("object_id"), "object_id", "left_anti").select("object_id", "node_id").unionByName(moved.objects.withColumn("node_id", swap("node_id")).select("object_id", "node_id"))
    rejected = [t.rejected for t in (a, moved) if t.rejected is not None]
    both = rejected[0].unionByName(rejected[1].withColumn("node_id", swap("node_id"))) if len(rejected) == 2 else rejected[0] if rejected else None
    return Tree(nodes, objects, both, a.meta | {"merged": [*a.meta.get("merged", []), b.meta]})
