"""One query per operator of the library, over trees made of the benchmark tables, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions.vectors import euclidean, l2_normalize, mean_vectors
from .operators import edit, labels, query, rank, recluster, stats, vector
from .plans import closure as cl
from .plans.shared import shared_root
from .schema import Tables, Tree, check_tree
from .sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query_of(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL of the fixtures ---------------------------------------------------------------------------------------------

_duck = lambda s: s.replace("STRING", "VARCHAR")
GEO = f"WITH RECURSIVE nodes AS ({_duck(fx.GEO_NODES)}), assignments AS ({_duck(fx.GEO_ASSIGNMENTS)}), rejected AS ({_duck(fx.GEO_REJECTED)})"
VEC = (
    f"WITH RECURSIVE nodes AS ({_duck(fx.VEC_NODES)}), assignments AS ({_duck(fx.VEC_ASSIGNMENTS)}), rejected AS ({_duck(fx.VEC_REJECTED)}), "
    "objects AS (SELECT CAST(vec_id AS VARCHAR) AS object_id, CAST(embedding AS DOUBLE[]) AS vector, ((vec_id * 2654435761) % 4294967296) / CAST(4294967296 AS DOUBLE) AS rand FROM embeddings)"
)
CLOSURE = ", cl AS (SELECT node_id AS ancestor_id, node_id, 0 AS distance FROM nodes UNION ALL SELECT n.parent_id, cl.node_id, cl.distance + 1 FROM cl JOIN nodes n ON n.node_id = cl.ancestor_id WHERE n.parent_id IS NOT NULL)"
DEEP = CLOSURE + ", deep AS (SELECT n.node_id, count(a.object_id) AS n_objects_deep FROM nodes n LEFT JOIN cl ON cl.ancestor_id = n.node_id LEFT JOIN assignments a ON a.node_id = cl.node_id GROUP BY n.node_id)"
MEANS = ", flat AS (SELECT node_id, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM assignments JOIN objects USING (object_id))"
CENTROIDS = CLOSURE + MEANS + ", dims AS (SELECT cl.ancestor_id AS node_id, pos, avg(x) AS x FROM cl JOIN flat USING (node_id) GROUP BY 1, 2), centroids AS (SELECT node_id, list(x ORDER BY pos) AS vector FROM dims GROUP BY node_id)"
TYPES = ", types AS (SELECT c.node_id AS type_id, c.vector FROM centroids c JOIN nodes n USING (node_id) WHERE n.starred)"
_text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))

def _exploded(df: DataFrame, key: str, vector: str = "vector", digits: int = 6) -> DataFrame:
    """(key, pos, x): one row for each dimension, from 1, rounded; zero has no sign."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), (F.round("x", digits) + F.lit(0.0)).alias("x"))


def _mean_of(prototypes: DataFrame, key: str) -> DataFrame:
    """(key, vector): the mean that prototypes stand for, weighted by their support."""
    rows = prototypes.select(key, F.explode("prototypes").alias("p")).select(key, "p.vector", "p.support")
    return mean_vectors(rows, key, weight=F.col("support"))


# --- traversal -------------------------------------------------------------------------------------------------------


@query_of("t01_ancestors", GEO + CLOSURE + " SELECT ancestor_id AS node_id, CAST(-distance AS INT) AS level FROM cl WHERE node_id = 1007")
def _(s, d):
    return cl.ancestors(fx.geo(s, d).nodes, 1007).select("node_id", "level")


@query_of("t02_path_ids", GEO + CLOSURE + " SELECT node_id, string_agg(CAST(ancestor_id AS VARCHAR), ',' ORDER BY distance DESC) AS path FROM cl GROUP BY node_id")
def _(s, d):
    return cl.paths(fx.geo(s, d).nodes).select("node_id", _text("path").alias("path"))


@query_of("t03_subtree", GEO + ", sub AS (SELECT node_id, starred, 0 AS level FROM nodes WHERE node_id = 2 UNION ALL SELECT n.node_id, n.starred, sub.level + 1 FROM sub JOIN nodes n ON n.parent_id = sub.node_id WHERE NOT sub.starred) SELECT node_id, level FROM sub")
def _(s, d):
    return cl.subtree(fx.geo(s, d).nodes, 2, lambda up, down: ~up("starred")).select("node_id", "level")


@query_of("t04_descendants", GEO + CLOSURE + " SELECT ancestor_id AS node_id, count(*) AS n FROM cl GROUP BY ancestor_id")
def _(s, d):
    return query.n_descendants(fx.geo(s, d).nodes)


@query_of("t05_objects_recursive", GEO + CLOSURE + " SELECT DISTINCT object_id FROM assignments JOIN cl USING (node_id) WHERE ancestor_id = 3")
def _(s, d):
    return query.objects_recursive(fx.geo(s, d), 3)


@query_of("t06_deep_counts", GEO + DEEP + " SELECT node_id, n_objects_deep FROM deep")
def _(s, d):
    t = fx.geo(s, d)
    return query.n_objects_deep(t.nodes, t.assignments)


@query_of("t07_root", GEO + " SELECT node_id FROM nodes WHERE parent_id IS NULL")
def _(s, d):
    return query.root_of(fx.geo(s, d).nodes, 1).select("node_id")


@query_of("t08_projects", "SELECT CAST(1 + r_regionkey AS BIGINT) AS project_id, r_name AS name, CAST(100 + min(n_nationkey) AS BIGINT) AS root_id FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey % 2 = 0 GROUP BY r_regionkey, r_name")
def _(s, d):
    # Each region is a project; its first nation is the root of the others.
    nation = fx.load(s, d, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    nodes = nation.join(first, "n_regionkey").select((100 + F.col("n_nationkey")).cast("long").alias("node_id"), F.when(F.col("n_nationkey") != F.col("first"), (100 + F.col("first")).cast("long")).alias("parent_id"), (1 + F.col("n_regionkey")).cast("long").alias("project_id"))
    projects = fx.load(s, d, "region").select((1 + F.col("r_regionkey")).cast("long").alias("project_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("visible"))
    return query.projects(Tables(nodes, nodes, projects=projects)).select("project_id", "name", "root_id")


@query_of("t09_children", GEO + " SELECT node_id, name FROM nodes WHERE parent_id = 102 AND starred")
def _(s, d):
    return query.children(fx.geo(s, d).nodes, 102, "starred").select("node_id", "name")


@query_of("t10_direct_objects", GEO + " SELECT object_id FROM assignments WHERE node_id = 0 ORDER BY CAST(object_id AS BIGINT) LIMIT 40 OFFSET 5")
def _(s, d):
    return query.direct_objects(fx.geo(s, d), 0, 5, 40, [F.col("object_id").cast("long")])


@query_of("t11_object_counts", GEO + " SELECT node_id, count(*) AS n FROM assignments GROUP BY node_id")
def _(s, d):
    return query.n_objects(fx.geo(s, d).assignments)


@query_of("t12_topological", GEO + CLOSURE + " SELECT node_id, max(distance) AS level FROM cl GROUP BY node_id")
def _(s, d):
    return query.topological(fx.geo(s, d).nodes).select("node_id", "level")


@query_of("t13_walk", GEO + CLOSURE + ", p AS (SELECT node_id, string_agg(CAST(ancestor_id AS VARCHAR), ',' ORDER BY distance DESC) AS path FROM cl GROUP BY node_id), k AS (SELECT parent_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS kids FROM nodes GROUP BY parent_id) SELECT p.node_id, path, coalesce(kids, '') AS children FROM p LEFT JOIN k ON k.parent_id = p.node_id")
def _(s, d):
    return query.walk(fx.geo(s, d).nodes).select("node_id", _text("path").alias("path"), _text("children").alias("children"))


@query_of("t14_file_path", GEO + CLOSURE + " SELECT ancestor_id AS node_id, CAST(-distance AS INT) AS level FROM cl WHERE node_id = 1009 AND distance > 0")
def _(s, d):
    return query.proper_ancestors(fx.geo(s, d).nodes, 1009).select("node_id", "level")


@query_of("t15_tip", GEO + ", sub AS (SELECT node_id, 0 AS level FROM nodes WHERE node_id = 0 UNION ALL SELECT n.node_id, sub.level + 1 FROM sub JOIN nodes n ON n.parent_id = sub.node_id WHERE NOT n.approved AND NOT n.starred) SELECT node_id, level FROM sub WHERE node_id IN (SELECT parent_id FROM nodes) ORDER BY level DESC, node_id LIMIT 1")
def _(s, d):
    return query.tip(fx.geo(s, d).nodes, 0).select("node_id", "level")


_STARRED = ", sub AS (SELECT node_id, starred FROM nodes WHERE node_id = 0 UNION ALL SELECT n.node_id, n.starred FROM sub JOIN nodes n ON n.parent_id = sub.node_id WHERE NOT sub.starred)"


@query_of("t16_minlevel_starred", GEO + _STARRED + " SELECT node_id FROM sub WHERE starred")
def _(s, d):
    return query.minlevel_starred(fx.geo(s, d).nodes, 0).select("node_id")


@query_of("t16b_sorted_count", GEO + DEEP + _STARRED + " SELECT CAST(sum(n_objects_deep) AS BIGINT) AS n_sorted FROM sub JOIN deep USING (node_id) WHERE starred")
def _(s, d):
    return query.n_sorted(fx.geo(s, d), 0)


@query_of("t17a_next_unapproved", GEO + DEEP + ", sub AS (SELECT node_id, 0 AS level FROM nodes WHERE node_id = 104 UNION ALL SELECT n.node_id, sub.level + 1 FROM sub JOIN nodes n ON n.parent_id = sub.node_id WHERE NOT n.approved) SELECT node_id FROM sub JOIN nodes USING (node_id) JOIN deep USING (node_id) WHERE NOT approved AND node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) ORDER BY preferred DESC, level DESC, n_objects_deep DESC, node_id LIMIT 1")
def _(s, d):
    return query.next_unapproved(fx.geo(s, d), 104, leaf=True, preferred_first=True, order_by="largest").select("node_id")


@query_of("t17b_next_unfilled", GEO + DEEP + " SELECT n.node_id FROM nodes n JOIN cl ON cl.node_id = n.node_id AND cl.ancestor_id = 2 JOIN deep ON deep.node_id = n.node_id WHERE approved AND NOT filled AND n.node_id IN (SELECT node_id FROM assignments) ORDER BY distance DESC, n_objects_deep DESC, n.node_id LIMIT 1")
def _(s, d):
    t = fx.geo(s, d)
    return query.next_unfilled(t, 2, t.assignments).select("node_id")  # nodes with objects have prototypes


@query_of("t18_supertree", GEO + CLOSURE + ", up AS (SELECT cl.node_id, cl.ancestor_id, row_number() OVER (PARTITION BY cl.node_id ORDER BY distance) AS r FROM cl JOIN nodes a ON a.node_id = cl.ancestor_id WHERE distance > 0 AND (a.starred OR a.parent_id IS NULL)) SELECT n.node_id, up.ancestor_id AS superparent_id FROM nodes n LEFT JOIN up ON up.node_id = n.node_id AND r = 1")
def _(s, d):
    return query.connect_supertree(fx.geo(s, d).nodes).select("node_id", "superparent_id")


@query_of("t18_superchildren", GEO + CLOSURE + ", sup AS (SELECT n.node_id, (SELECT cl.ancestor_id FROM cl JOIN nodes a ON a.node_id = cl.ancestor_id WHERE cl.node_id = n.node_id AND cl.distance > 0 AND (a.starred OR a.parent_id IS NULL) ORDER BY cl.distance LIMIT 1) AS s FROM nodes n) SELECT n.node_id, count(s.node_id) AS n_superchildren FROM nodes n LEFT JOIN sup s ON s.s = n.node_id GROUP BY 1")
def _(s, d):
    return query.superchildren(query.connect_supertree(fx.geo(s, d).nodes))


@query_of("t17b_unfilled_table", GEO + DEEP + ", depth AS (SELECT node_id, max(distance) AS level FROM cl GROUP BY 1) SELECT n.node_id, level, n_objects_deep FROM nodes n JOIN depth USING (node_id) JOIN deep ON deep.node_id = n.node_id WHERE approved AND NOT filled AND n.node_id IN (SELECT node_id FROM assignments)")
def _(s, d):
    # Nodes with objects stand for those with prototypes.
    t = fx.geo(s, d)
    return query.unfilled(t, t.assignments.select("node_id"), 1)


@query_of("t19_connectivity", GEO + ", kept AS (SELECT * FROM nodes WHERE node_id <> 103), down AS (SELECT node_id FROM kept WHERE parent_id IS NULL UNION ALL SELECT n.node_id FROM down JOIN kept n ON n.parent_id = down.node_id) SELECT 'node' AS kind, CAST(node_id AS VARCHAR) AS id FROM kept WHERE node_id NOT IN (SELECT node_id FROM down) UNION ALL SELECT 'object', object_id FROM assignments WHERE node_id NOT IN (SELECT node_id FROM kept)")
def _(s, d):
    t = fx.geo(s, d)
    return query.unconnected(t.nodes.filter("node_id <> 103"), t.assignments)


_LABELS = ", lab AS (SELECT node_id, CAST(NULL AS VARCHAR) AS label, true AS opened FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, CASE WHEN lab.opened AND n.name IS NOT NULL THEN {step} ELSE lab.label END, lab.opened AND n.name IS NOT NULL FROM lab JOIN nodes n ON n.parent_id = lab.node_id)"


@query_of("t20_flat_labels_raw", GEO + _LABELS.format(step="concat_ws('/', lab.label, n.name)") + " SELECT object_id, label FROM assignments JOIN lab USING (node_id) WHERE label IS NOT NULL")
def _(s, d):
    return labels.flat_labels(fx.geo_tree(s, d), clean_name=False)


_CLEAN = "CASE WHEN coalesce(lab.label, '') = '' THEN n.name ELSE array_to_string(list_prepend(lab.label, list_filter(string_split(n.name, '/'), lambda c: NOT contains(lab.label, c))), '/') END"


@query_of("t20_flat_labels", GEO + _LABELS.format(step=_CLEAN) + " SELECT object_id, label FROM assignments JOIN lab USING (node_id) WHERE label IS NOT NULL")
def _(s, d):
    return labels.flat_labels(fx.geo_tree(s, d))


@query_of("t21_trim_common", GEO + CLOSURE + " SELECT node_id, string_agg(CAST(ancestor_id AS VARCHAR), ',' ORDER BY distance DESC) AS path FROM cl WHERE node_id IN (SELECT node_id FROM nodes WHERE parent_id = 102) AND ancestor_id NOT IN (0, (SELECT parent_id FROM nodes WHERE node_id = 102)) GROUP BY node_id")
def _(s, d):
    nodes = fx.geo(s, d).nodes
    return query.trim_common(cl.paths(nodes).join(nodes.filter("parent_id = 102").select("node_id"), "node_id", "left_semi")).select("node_id", _text("path").alias("path"))


@query_of("t22_bottom_up", GEO + CLOSURE + " SELECT ancestor_id AS node_id, CAST(max(depth - distance) AS INT) AS depth FROM cl JOIN (SELECT node_id, max(distance) AS depth FROM cl GROUP BY node_id) USING (node_id) GROUP BY ancestor_id")
def _(s, d):
    return query.bottom_up(cl.paths(fx.geo(s, d).nodes))


_COUNTS = ", ".join(
    ["{top}"]
    + [f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS n_{c}_nodes" for c in ("approved", "filled", "named")]
    + [f"CAST(sum(CASE WHEN leaf AND {c} THEN n ELSE 0 END) AS BIGINT) AS leaves_n_{c}_objects, CAST(sum(CASE WHEN leaf AND {c} THEN 1 ELSE 0 END) AS BIGINT) AS leaves_n_{c}_nodes" for c in ("approved", "filled", "named")]
    + ["count(*) AS n_nodes, CAST(sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS BIGINT) AS leaves_n_nodes, CAST(sum(CASE WHEN leaf THEN n ELSE 0 END) AS BIGINT) AS leaves_n_objects"]
    + ["CAST(sum(CASE WHEN root AND filled THEN n ELSE 0 END) AS BIGINT) AS n_filled_objects, CAST(sum(CASE WHEN root THEN n ELSE 0 END) AS BIGINT) AS n_objects"]
)
_PROGRESS = (
    """, kids AS (SELECT DISTINCT parent_id AS node_id FROM nodes), own AS (SELECT n.node_id, parent_id IS NULL AS root, approved, filled, name IS NOT NULL AS named, n_objects_deep AS n, n.node_id NOT IN (SELECT node_id FROM kids WHERE node_id IS NOT NULL) AS leaf FROM nodes n JOIN deep USING (node_id)),
above AS (SELECT cl.node_id, bool_or(a.approved) AS ua, bool_or(a.named) AS un FROM cl JOIN own a ON a.node_id = cl.ancestor_id WHERE distance > 0 GROUP BY cl.node_id),
tops AS (SELECT cl.node_id, cl.ancestor_id AS top FROM cl JOIN nodes t ON t.node_id = cl.ancestor_id WHERE t.parent_id IS NULL) SELECT top AS node_id, """
    + _COUNTS.format(top="CAST(sum(CASE WHEN approved AND NOT coalesce(ua, false) THEN n ELSE 0 END) AS BIGINT) AS n_approved_objects, CAST(sum(CASE WHEN named AND NOT coalesce(un, false) THEN n ELSE 0 END) AS BIGINT) AS n_named_objects")
    + " FROM own JOIN tops USING (node_id) LEFT JOIN above USING (node_id) GROUP BY top"
)
DEEPTREE = f"WITH RECURSIVE nodes AS ({_duck(fx.DEEP_NODES)}), assignments AS ({_duck(fx.DEEP_ASSIGNMENTS)})"
PROJECTS = "WITH RECURSIVE nodes AS (SELECT 1 + r_regionkey AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS VARCHAR) AS name, false AS starred, false AS approved, false AS filled FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, CASE WHEN n_nationkey % 4 <> 3 THEN n_name END, n_nationkey % 5 = 0, n_nationkey % 7 = 0, n_nationkey % 2 = 0 FROM nation), assignments AS (SELECT CAST(c_custkey AS VARCHAR) AS object_id, 100 + c_nationkey AS node_id FROM customer)"


@query_of("t23_progress", GEO + DEEP + _PROGRESS)
def _(s, d):
    return query.progress(fx.geo(s, d))


@query_of("t23_deep_progress", DEEPTREE + DEEP + _PROGRESS)
def _(s, d):
    return query.progress(fx.deep(s, d))


@query_of("g12_all_projects", PROJECTS + DEEP + _PROGRESS)
def _(s, d):
    return query.progress(fx.many_projects(s, d)).withColumn("node_id", F.col("node_id"))


@query_of("t03_deep_subtree", DEEPTREE + CLOSURE + " SELECT node_id, distance AS level FROM cl WHERE ancestor_id = 25")
def _(s, d):
    return cl.subtree(fx.deep(s, d).nodes, 25).select("node_id", "level")


@query_of("t01_deep_ancestors", DEEPTREE + CLOSURE + " SELECT ancestor_id AS node_id, CAST(-distance AS INT) AS level FROM cl WHERE node_id = 149")
def _(s, d):
    return cl.ancestors(fx.deep(s, d).nodes, 149).select("node_id", "level")


@query_of("t06_deep_counts_of_chains", DEEPTREE + DEEP + " SELECT node_id, n_objects_deep FROM deep")
def _(s, d):
    t = fx.deep(s, d)
    return query.n_objects_deep(t.nodes, t.assignments)


@query_of("t12_deep_levels", DEEPTREE + CLOSURE + " SELECT node_id, max(distance) AS level FROM cl GROUP BY node_id")
def _(s, d):
    return query.levels(fx.deep(s, d).nodes)


@query_of("t18_deep_supertree", DEEPTREE + CLOSURE + ", up AS (SELECT cl.node_id, cl.ancestor_id, row_number() OVER (PARTITION BY cl.node_id ORDER BY distance) AS r FROM cl JOIN nodes a ON a.node_id = cl.ancestor_id WHERE distance > 0 AND (a.starred OR a.parent_id IS NULL)) SELECT n.node_id, up.ancestor_id AS superparent_id FROM nodes n LEFT JOIN up ON up.node_id = n.node_id AND r = 1")
def _(s, d):
    return query.connect_supertree(fx.deep(s, d).nodes).select("node_id", "superparent_id")


@query_of("t20_deep_labels", DEEPTREE + _LABELS.format(step=_CLEAN) + " SELECT object_id, label FROM assignments JOIN lab USING (node_id) WHERE label IS NOT NULL")
def _(s, d):
    t = fx.deep(s, d)
    return labels.flat_labels(Tree(t.nodes, t.assignments))


@query_of("t01_many", GEO + CLOSURE + " SELECT node_id AS target_id, ancestor_id AS node_id, -distance AS level FROM cl WHERE node_id >= 1000")
def _(s, d):
    nodes = fx.geo(s, d).nodes
    return cl.ancestors(nodes, nodes.filter("node_id >= 1000").select("node_id")).select("target_id", "node_id", "level")


@query_of("t02_many", GEO + CLOSURE + " SELECT node_id, list(ancestor_id ORDER BY distance DESC) AS path FROM cl WHERE node_id >= 1000 GROUP BY node_id")
def _(s, d):
    nodes = fx.geo(s, d).nodes
    return cl.paths(nodes, nodes.filter("node_id >= 1000").select("node_id"))


@query_of("t03_many", GEO + CLOSURE + " SELECT ancestor_id AS target_id, node_id, distance AS level FROM cl WHERE ancestor_id BETWEEN 1 AND 999")
def _(s, d):
    # Regions and nations: subtrees that lie in one another.
    nodes = fx.geo(s, d).nodes
    return cl.subtree(nodes, nodes.filter("node_id between 1 and 999").select("node_id")).select("target_id", "node_id", "level")


@query_of("t25_node", GEO + DEEP + " SELECT node_id, name, n_objects_deep AS n FROM nodes JOIN deep USING (node_id) WHERE node_id = 102")
def _(s, d):
    t = fx.geo(s, d)
    t = t.with_(objects=t.objects.withColumn("vector", F.lit(None).cast("array<double>")))
    return query.node(t, 102, refresh=True).select("node_id", "name", F.col("_n_objects_deep").alias("n"))


@query_of("p06_node_view", GEO + DEEP + ", k AS (SELECT parent_id, count(*) AS n FROM nodes GROUP BY 1), o AS (SELECT node_id, count(*) AS n FROM assignments GROUP BY 1), p AS (SELECT node_id, string_agg(CAST(ancestor_id AS VARCHAR), ',' ORDER BY distance DESC) AS path FROM cl GROUP BY node_id) SELECT n.node_id, p.path, coalesce(n.name, CAST(n.node_id AS VARCHAR)) AS name, coalesce(k.n, 0) AS n_children, coalesce(o.n, 0) AS n_objects, n_objects_deep, CASE WHEN starred THEN 'starred' WHEN approved THEN 'approved' ELSE 'other' END AS status FROM nodes n JOIN deep USING (node_id) JOIN p ON p.node_id = n.node_id LEFT JOIN k ON k.parent_id = n.node_id LEFT JOIN o ON o.node_id = n.node_id")
def _(s, d):
    return query.node_view(fx.geo(s, d)).withColumn("path", _text("path"))


@query_of("s18_export_log", VEC + " SELECT event_id AS log_id, event_type AS action, CASE WHEN node_id IS NOT NULL THEN 1 END AS project_id FROM events LEFT JOIN nodes ON node_id = 10 + event_id % 12")
def _(s, d):
    return query.export_log(fx.log(s, d), fx.vectors(s, d).nodes).select("log_id", "action", "project_id")


# --- statistics ------------------------------------------------------------------------------------------------------


@query_of("a01_counts", GEO + DEEP + ", k AS (SELECT parent_id, count(*) AS n FROM nodes GROUP BY 1), o AS (SELECT node_id, count(*) AS n FROM assignments GROUP BY 1) SELECT n.node_id, coalesce(o.n, 0) AS n_objects, coalesce(k.n, 0) AS n_children, n_objects_deep FROM nodes n JOIN deep USING (node_id) LEFT JOIN k ON k.parent_id = n.node_id LEFT JOIN o ON o.node_id = n.node_id")
def _(s, d):
    return stats.counts(fx.geo(s, d))


_SAMPLE = ", sampled AS (SELECT node_id, object_id, row_number() OVER (PARTITION BY node_id ORDER BY rand, object_id) AS r FROM assignments JOIN objects USING (object_id))"


@query_of("a03_sample", VEC + _SAMPLE + " SELECT node_id, object_id, r FROM sampled WHERE r <= 20")
def _(s, d):
    return stats.sample_objects(fx.vectors(s, d), 20).select("node_id", "object_id", F.col("r").cast("long").alias("r"))


@query_of("a04_own_type_objects", VEC + CENTROIDS + _SAMPLE + ", far AS (SELECT s.node_id, s.object_id, round(max(list_distance(o.vector, c.vector)), 6) AS key FROM sampled s JOIN objects o USING (object_id) JOIN nodes k ON k.parent_id = s.node_id JOIN centroids c ON c.node_id = k.node_id WHERE r <= 1000 GROUP BY 1, 2) SELECT node_id, object_id, key FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY key DESC, object_id) AS r FROM far) WHERE r <= 9")
def _(s, d):
    return stats.own_type_objects(fx.vectors(s, d)).select("node_id", "object_id", F.round("key", 6).alias("key"))


@query_of("a05_type_objects", VEC + _SAMPLE + """, leaf AS (SELECT node_id, r - 1 AS pos, object_id FROM sampled WHERE r <= 9 AND node_id >= 10),
g AS (SELECT * FROM (SELECT n.parent_id AS node_id, l.object_id, row_number() OVER (PARTITION BY n.parent_id ORDER BY l.pos, (n.node_id * 2654435761) % 4294967296, n.node_id) - 1 AS pos FROM leaf l JOIN nodes n USING (node_id)) WHERE pos < 9),
t AS (SELECT * FROM (SELECT n.parent_id AS node_id, l.object_id, row_number() OVER (PARTITION BY n.parent_id ORDER BY l.pos, (n.node_id * 2654435761) % 4294967296, n.node_id) - 1 AS pos FROM g l JOIN nodes n USING (node_id)) WHERE pos < 9)
SELECT node_id, pos, object_id FROM leaf UNION ALL SELECT node_id, pos, object_id FROM g UNION ALL SELECT node_id, pos, object_id FROM t""")
def _(s, d):
    return stats.type_objects(fx.vectors(s, d)).select("node_id", F.col("pos").cast("long").alias("pos"), "object_id")


@query_of("a06_centroids", VEC + CENTROIDS + " SELECT node_id, pos, round(x, 6) + 0.0 AS x FROM dims")
def _(s, d):
    return _exploded(stats.centroids(fx.vectors(s, d)), "node_id")


@query_of("a07_prototypes", VEC + CENTROIDS + " SELECT node_id, pos, round(x, 5) + 0.0 AS x FROM dims")
def _(s, d):
    return _exploded(_mean_of(stats.prototypes(fx.vectors(s, d)), "node_id"), "node_id", digits=5)


@query_of("a05_deep_type_objects")
def _(s, d):
    # SQL would fold level by level; the tests hold this against a plain walk.
    return stats.type_objects(fx.deep_with_vectors(s, d))


@query_of("a07_deep_prototypes", "WITH RECURSIVE nodes AS (" + _duck(fx.DEEP_NODES) + "), assignments AS (" + _duck(fx.DEEP_ASSIGNMENTS) + "), objects AS (SELECT CAST(o_orderkey AS VARCHAR) AS object_id, [CAST(o_orderkey % 97 AS DOUBLE), CAST(o_orderkey % 31 AS DOUBLE)] AS vector FROM orders)" + CENTROIDS + " SELECT node_id, pos, round(x, 5) + 0.0 AS x FROM dims")
def _(s, d):
    return _exploded(_mean_of(stats.prototypes(fx.deep_with_vectors(s, d)), "node_id"), "node_id", digits=5)


_REFRESHED = "CASE WHEN n.node_id IN (SELECT node_id FROM cl WHERE ancestor_id = 1) AND n.node_id % 2 = 0 THEN {} END"


@query_of("a08_consolidate", VEC + DEEP + MEANS + ", k AS (SELECT parent_id, count(*) AS k FROM nodes GROUP BY 1), o AS (SELECT node_id, count(*) AS o FROM assignments GROUP BY 1), first AS (SELECT ancestor_id AS node_id, avg(x) AS x FROM cl JOIN flat USING (node_id) WHERE pos = 1 GROUP BY 1) SELECT n.node_id, " + _REFRESHED.format("coalesce(k, 0)") + " AS n_children, " + _REFRESHED.format("coalesce(o, 0)") + " AS n_objects, " + _REFRESHED.format("n_objects_deep") + " AS n, round(" + _REFRESHED.format("x") + ", 6) AS first, n.node_id % 2 = 1 OR n.node_id IN (SELECT node_id FROM cl WHERE ancestor_id = 1) AS cache_valid FROM nodes n JOIN deep ON deep.node_id = n.node_id LEFT JOIN k ON k.parent_id = n.node_id LEFT JOIN o ON o.node_id = n.node_id LEFT JOIN first ON first.node_id = n.node_id")
def _(s, d):
    t = fx.vectors(s, d)
    t = t.with_(nodes=t.nodes.withColumn("cache_valid", F.col("node_id") % 2 == 1))
    return stats.consolidate(t, 1, "full").select("node_id", F.col("_n_children").alias("n_children"), F.col("_n_objects").alias("n_objects"), F.col("_n_objects_deep").alias("n"), F.round(F.col("_centroid")[0], 6).alias("first"), "cache_valid")


_STALE = "n.node_id IN (0, 1, 11, 14)"


@query_of("a08_stale_only", VEC + CLOSURE + MEANS + ", lent AS (SELECT node_id, 1000 + node_id AS n, 5.0 AS x FROM nodes n WHERE NOT (" + _STALE + ")), shown AS (SELECT ancestor_id AS node_id, a.node_id AS src FROM cl a JOIN nodes n ON n.node_id = ancestor_id WHERE " + _STALE + " AND a.node_id IN (0, 1, 11, 14) AND NOT EXISTS (SELECT 1 FROM cl b JOIN lent l ON l.node_id = b.ancestor_id JOIN cl c ON c.node_id = b.ancestor_id AND c.ancestor_id = a.ancestor_id WHERE b.node_id = a.node_id AND c.distance > 0)), parts AS (SELECT s.node_id, count(*) AS n, sum(f.x) AS x FROM shown s JOIN flat f ON f.node_id = s.src WHERE pos = 1 GROUP BY 1 UNION ALL SELECT s.node_id, l.n, l.n * l.x FROM shown s JOIN nodes k ON k.parent_id = s.src JOIN lent l ON l.node_id = k.node_id), total AS (SELECT node_id, sum(n) AS n, sum(x) AS x FROM parts GROUP BY 1) SELECT n.node_id, CAST(coalesce(t.n, l.n, 0) AS BIGINT) AS n, round(coalesce(t.x / t.n, l.x), 6) AS first, true AS cache_valid FROM nodes n LEFT JOIN total t USING (node_id) LEFT JOIN lent l USING (node_id)")
def _(s, d):
    # Valid nodes hold false numbers: they are handed up as they are, and nothing below them counts.
    t = fx.vectors(s, d)
    stale, wide = F.col("node_id").isin(0, 1, 11, 14), F.array_repeat(F.lit(5.0), 64)
    number = lambda c: F.when(~stale, c).cast("long")
    nodes = t.nodes.withColumns({"cache_valid": ~stale, "_n_objects": number(F.lit(1)), "_n_children": number(F.lit(1)), "_n_objects_deep": number(1000 + F.col("node_id")), "_centroid": F.when(~stale, wide), "_n_vectors": number(1000 + F.col("node_id")).cast("double")})
    return stats.consolidate(t.with_(nodes=nodes), 0, "full").select("node_id", F.col("_n_objects_deep").alias("n"), F.round(F.col("_centroid")[0], 6).alias("first"), "cache_valid")


@query_of("a09_returned_children", VEC + DEEP + " SELECT n.node_id, n_objects_deep AS n FROM nodes n JOIN deep USING (node_id) WHERE parent_id = 1")
def _(s, d):
    return stats.consolidate(fx.vectors(s, d), 1, "children", return_="children").select("node_id", F.col("_n_objects_deep").alias("n"))


@query_of("a11_combine_covariances", "SELECT count(*) AS n, round(avg(l_quantity), 4) AS x, round(avg(l_discount), 4) AS y, round(covar_pop(l_quantity, l_discount), 4) AS cov FROM lineitem")
def _(s, d):
    rows = fx.load(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), "l_linenumber")
    part = lambda c: rows.filter(c).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.covar_pop("x", "y").alias("cov"))
    return vector.combine_covariances(part("l_linenumber <= 2"), part("l_linenumber > 2"), "x", "y").select("n", *(F.round(c, 4).alias(c) for c in ("x", "y", "cov")))  # a mean of hundredths can tie at the sixth place


# --- vectors ---------------------------------------------------------------------------------------------------------


@query_of("v01_distance", "SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(s, d):
    e = fx.load(s, d, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("w"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(euclidean(F.col("embedding"), F.col("w")), 6).alias("d"))


@query_of("v02_prototype_distance", VEC + " SELECT o.object_id, round(min(list_distance(o.vector, p.vector)), 6) AS distance FROM objects o, objects p WHERE p.object_id IN ('3', '5', '8') GROUP BY 1")
def _(s, d):
    o = fx.vectors(s, d).objects
    return vector.prototype_distance(o, o.filter("object_id in ('3', '5', '8')")).select("object_id", F.round("distance", 6).alias("distance"))


_OWN = ", own AS (SELECT node_id, pos, avg(x) AS x, count(*) AS n FROM flat GROUP BY 1, 2)"


def _assigned(s, d) -> DataFrame:
    t = fx.vectors(s, d)
    return t.assignments.join(t.objects, "object_id").select("node_id", "object_id", "vector", "rand")


@query_of("v03_fit_prototypes", VEC + MEANS + _OWN + " SELECT node_id, pos, round(x, 6) + 0.0 AS x, CAST(n AS DOUBLE) AS support FROM own")
def _(s, d):
    fitted = vector.fit_prototypes(_assigned(s, d), "node_id", 1).select("node_id", F.col("prototypes")[0].alias("p"))
    return _exploded(fitted.select("node_id", "p.vector"), "node_id").join(fitted.select("node_id", "p.support"), "node_id")


@query_of("v03_fit_four_prototypes", VEC + MEANS + _OWN + " SELECT node_id, pos, round(x, 5) + 0.0 AS x FROM own")
def _(s, d):
    # Centres and supports of k-means keep the mean of all points.
    return _exploded(_mean_of(vector.fit_prototypes(_assigned(s, d), "node_id", 4), "node_id"), "node_id", digits=5)


@query_of("v04_merge_prototypes", VEC + MEANS + ", up AS (SELECT parent_id AS node_id, pos, avg(x) AS x FROM flat JOIN nodes USING (node_id) WHERE node_id >= 10 GROUP BY 1, 2) SELECT node_id, pos, round(x, 5) + 0.0 AS x FROM up")
def _(s, d):
    t = fx.vectors(s, d)
    fitted = vector.fit_prototypes(_assigned(s, d).filter("node_id >= 10"), "node_id", 8).join(t.nodes.select("node_id", "parent_id"), "node_id").select(F.col("parent_id").alias("node_id"), "prototypes")
    return _exploded(_mean_of(vector.merge_prototypes(fitted, "node_id", 16), "node_id"), "node_id", digits=5)


@query_of("v06_prototype_classifier", VEC + MEANS + ", lab AS (SELECT CAST(vec_id AS VARCHAR) AS object_id, label FROM embeddings), f AS (SELECT object_id, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM objects) SELECT label, pos, round(avg(x), 5) + 0.0 AS x FROM f JOIN lab USING (object_id) GROUP BY 1, 2")
def _(s, d):
    rows = fx.load(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("object_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return _exploded(_mean_of(vector.fit_prototypes(rows, "label", 3), "label"), "label", digits=5)


@query_of("v05_prototype_set_distance", VEC + ", side AS (SELECT object_id, vector, coalesce(approved, false) AS a FROM objects JOIN assignments USING (object_id) JOIN nodes USING (node_id)), p AS (SELECT a.object_id AS i, b.object_id AS j, list_distance(a.vector, b.vector) AS d FROM side a, side b WHERE a.a AND NOT b.a) SELECT round(greatest((SELECT avg(d) FROM (SELECT min(d) AS d FROM p GROUP BY i)), (SELECT avg(d) FROM (SELECT min(d) AS d FROM p GROUP BY j))), 6) AS distance")
def _(s, d):
    # All vectors: those of approved nodes against the others.
    t = fx.vectors(s, d)
    side = t.objects.join(t.assignments, "object_id").join(t.nodes.select("node_id", "approved"), "node_id").select(F.col("object_id").alias("id"), "vector", "approved")
    return vector.prototype_set_distance(side.filter("approved"), side.filter("not approved")).select(F.round("distance", 6).alias("distance"))


_CLASSES = ", cls AS (SELECT object_id, CAST(object_id AS BIGINT) % 4 AS label, vector FROM objects WHERE CAST(object_id AS BIGINT) % 25 = 1 AND CAST(object_id AS BIGINT) % 4 < 3), sc AS (SELECT o.object_id, CAST(l.label AS INT) AS label, -min(list_distance(o.vector, c.vector)) AS score FROM objects o CROSS JOIN (SELECT range AS label FROM range(3)) l JOIN cls c ON c.label = l.label GROUP BY 1, 2)"


def _scores(s, d, softmax=False):
    o = fx.vectors(s, d).objects
    n = F.col("object_id").cast("long")
    cls = o.filter((n % 25 == 1) & (n % 4 < 3)).select((n % 4).cast("int").alias("label"), "vector")
    return vector.predict_scores(o, cls, 3, softmax=softmax)


@query_of("v07_scores", VEC + _CLASSES + " SELECT object_id, label, round(exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY object_id) AS m FROM sc) WINDOW w AS (PARTITION BY object_id)")
def _(s, d):
    return _scores(s, d, True).select("object_id", "label", F.round("score", 6).alias("score"))


@query_of("v08_predict", VEC + _CLASSES + " SELECT object_id, label FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1")
def _(s, d):
    return vector.predict(_scores(s, d))


def _types(s, d):
    t = fx.vectors(s, d)
    return t, stats.centroids(t).join(t.nodes.filter("starred").select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("type_id"), "vector")


@query_of("v09_type_radius", VEC + CENTROIDS + TYPES + " SELECT a.type_id, round(min(list_distance(a.vector, b.vector)), 6) AS radius FROM types a JOIN types b ON a.type_id <> b.type_id GROUP BY 1")
def _(s, d):
    return vector.type_radius(_types(s, d)[1]).select("type_id", F.round("radius", 6).alias("radius"))


@query_of("v10_distances", VEC + CENTROIDS + TYPES + " SELECT object_id, type_id, round(list_distance(o.vector, t.vector), 6) AS distance FROM objects o, types t")
def _(s, d):
    t, types = _types(s, d)
    return vector.distances(types, t.objects).select("object_id", "type_id", F.round("distance", 6).alias("distance"))


_NEAREST = ", rad AS (SELECT a.type_id, min(list_distance(a.vector, b.vector)) AS radius FROM types a JOIN types b ON a.type_id <> b.type_id GROUP BY 1), near AS (SELECT object_id, arg_min(t.type_id, list_distance(o.vector, t.vector)) AS type_id, min(list_distance(o.vector, t.vector)) AS distance FROM objects o, types t GROUP BY 1)"


@query_of("v11_classify", VEC + CENTROIDS + TYPES + _NEAREST + " SELECT object_id, CASE WHEN distance < radius THEN type_id ELSE -1 END AS type_id, round(distance, 6) AS distance FROM near JOIN rad USING (type_id)")
def _(s, d):
    t, types = _types(s, d)
    return vector.classify(types, t.objects).select("object_id", "type_id", F.round("distance", 6).alias("distance"))


@query_of("v12_classify_members", VEC + CENTROIDS + ", ty AS (SELECT c.node_id AS type_id, vector FROM centroids c JOIN nodes n USING (node_id) WHERE starred AND parent_id = 1), near AS (SELECT object_id, arg_min(ty.type_id, list_distance(o.vector, ty.vector)) AS t FROM assignments JOIN objects o USING (object_id), ty WHERE node_id = 1 GROUP BY 1) SELECT a.object_id, coalesce(near.t, a.node_id) AS node_id FROM assignments a LEFT JOIN near USING (object_id)")
def _(s, d):
    t = fx.vectors(s, d)
    return edit.classify_members(t, 1, stats.centroids(t), classify_nodes=False, classify_objects=True, safe=False)[0].assignments.select("object_id", "node_id")


@query_of("v13_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3)) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 9 * x * x))), 6) AS total FROM embeddings")
def _(s, d):
    e = fx.load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return e.select("vec_id", F.round(F.aggregate(l2_normalize(F.col("v")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query_of("v14_pca", VEC + ", f AS (SELECT object_id, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM objects), m AS (SELECT pos, avg(x) AS m FROM f GROUP BY 1) SELECT object_id, round(sum((x - m) * (x - m)), 5) AS length FROM f JOIN m USING (pos) GROUP BY 1")
def _(s, d):
    # All components together keep the distance to the mean.
    found = vector.pca(fx.vectors(s, d).objects.select("object_id", "vector"), 64)[0]
    return found.select("object_id", F.round(F.aggregate("projected", F.lit(0.0), lambda a, x: a + x * x), 5).alias("length"))


def _covariances(found: DataFrame, k: int) -> DataFrame:
    """(i, j, cov): covariances of the first k components, rounded; of two different ones they are zero."""
    at = lambda n: F.col("projected")[n]
    pairs = found.agg(*(F.covar_pop(at(i), at(j)).alias(f"c_{i}_{j}") for i in range(k) for j in range(i + 1, k)))
    return pairs.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), (F.round(F.col(f"c_{i}_{j}"), 6) + 0.0).alias("cov")) for i in range(k) for j in range(i + 1, k)))).alias("e")).select("e.*")


@query_of("v14_pca_8", "SELECT i, j, CAST(0 AS DOUBLE) AS cov FROM range(8) a(i), range(8) b(j) WHERE i < j")
def _(s, d):
    return _covariances(vector.pca(fx.vectors(s, d).objects.select("object_id", "vector"), 8)[0], 8)


# No direction has more variance than the first component; the plane of the first two has at least that of any two dimensions.
@query_of("v14_pca_2", VEC + ", f AS (SELECT unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM objects), v AS (SELECT pos, var_pop(x) AS v FROM f GROUP BY pos) SELECT true AS first_is_largest, true AS plane_is_largest, true AS in_order, round(sum(v), 6) AS total FROM v")
def _(s, d):
    o = fx.vectors(s, d).objects.select("object_id", "vector")
    found, share = vector.pca(o, 2)
    variances = o.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("v"))
    most = variances.agg(F.sum("v").alias("total"), F.slice(F.sort_array(F.collect_list("v"), asc=False), 1, 2).alias("top"))  # one entry a dimension
    both = found.agg(*(F.var_pop(F.col("projected")[k]).alias(f"p{k}") for k in range(2))).crossJoin(most)  # one row each
    explained = F.abs((F.col("p0") + F.col("p1")) / F.col("total") - share) < 1e-9
    return both.select((F.col("p0") >= F.col("top")[0]).alias("first_is_largest"), ((F.col("p0") + F.col("p1") >= F.col("top")[0] + F.col("top")[1]) & explained).alias("plane_is_largest"), (F.col("p0") >= F.col("p1")).alias("in_order"), F.round("total", 6).alias("total"))


@query_of("v16_nearest_centroids", VEC + MEANS + ", m AS (SELECT node_id AS type_id, pos, avg(x) AS x FROM flat JOIN nodes USING (node_id) WHERE approved GROUP BY 1, 2) SELECT type_id, pos, round(x, 6) + 0.0 AS x FROM m")
def _(s, d):
    t = fx.vectors(s, d)
    train = t.assignments.join(t.nodes.filter("approved").select("node_id"), "node_id", "left_semi").join(t.objects, "object_id").select(F.col("node_id").alias("type_id"), "vector")
    return _exploded(vector.nearest_centroids(train), "type_id")


@query_of("v17_nearest_distance", VEC + CENTROIDS + TYPES + _NEAREST + " SELECT object_id, type_id, round(distance, 6) AS distance FROM near")
def _(s, d):
    t, types = _types(s, d)
    return vector.nearest_distance(t.objects, types).select("object_id", "type_id", F.round("distance", 6).alias("distance"))


_UP = ", up AS (SELECT ancestor_id AS node_id, distance FROM cl WHERE node_id = 12 AND distance > 0), cand AS (SELECT a.object_id, up.distance FROM assignments a JOIN up USING (node_id) WHERE a.object_id NOT IN (SELECT object_id FROM rejected WHERE node_id = 12)), n AS (SELECT distance, count(*) AS n FROM cand GROUP BY 1), used AS (SELECT distance FROM (SELECT distance, coalesce(sum(n) OVER (ORDER BY distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) WHERE b < 60)"


@query_of("v18_recommend_objects", VEC + CLOSURE + _UP + " SELECT round(d, 6) AS distance, object_id FROM (SELECT c.object_id, min(list_distance(o.vector, p.vector)) AS d FROM cand c JOIN used USING (distance) JOIN objects o ON o.object_id = c.object_id, objects p WHERE p.object_id IN ('3', '5') GROUP BY 1) ORDER BY d, object_id LIMIT 60")
def _(s, d):
    t = fx.vectors(s, d)
    return rank.recommend_objects(t, 12, t.objects.filter("object_id in ('3', '5')"), 60).select(F.round("distance", 6).alias("distance"), "object_id")


@query_of("v19_recommend_children", VEC + CENTROIDS + " SELECT n.node_id, round(list_distance(c.vector, own.vector), 6) AS distance FROM nodes n JOIN centroids c USING (node_id), centroids own WHERE own.node_id = 12 AND n.parent_id IN (SELECT ancestor_id FROM cl WHERE node_id = 12 AND distance > 0) AND n.node_id NOT IN (SELECT ancestor_id FROM cl WHERE node_id = 12)")
def _(s, d):
    t = fx.vectors(s, d)
    return rank.recommend_children(t, 12, stats.centroids(t), 64).select("node_id", F.round("distance", 6).alias("distance"))


_MANY = """, parents AS (SELECT DISTINCT parent_id AS node_id FROM nodes WHERE parent_id IS NOT NULL), leaves AS (SELECT node_id AS target_id FROM nodes WHERE node_id NOT IN (FROM parents)),
ways AS (SELECT target_id, ancestor_id AS node_id, distance FROM leaves JOIN cl ON cl.node_id = target_id WHERE distance > 0)"""
_MANY_OBJECTS = """, cand AS (SELECT target_id, object_id, distance FROM assignments JOIN ways USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE r.node_id = target_id AND r.object_id = assignments.object_id)),
n AS (SELECT target_id, distance, count(*) AS n FROM cand GROUP BY 1, 2), used AS (SELECT target_id, distance FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY target_id ORDER BY distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) WHERE b < 60),
protos AS (SELECT a.node_id AS target_id, o.vector FROM assignments a JOIN objects o USING (object_id) WHERE CAST(object_id AS BIGINT) < 100),
near AS (SELECT c.target_id, c.object_id, min(list_distance(o.vector, p.vector)) AS d FROM cand c JOIN used USING (target_id, distance) JOIN objects o USING (object_id) JOIN protos p ON p.target_id = c.target_id GROUP BY 1, 2)"""


@query_of("v18_many", VEC + CLOSURE + _MANY + _MANY_OBJECTS + " SELECT target_id, object_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, object_id) AS r FROM near) WHERE r <= 60")
def _(s, d):
    t = fx.vectors(s, d)
    inner = t.nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    leaves = t.nodes.join(inner, "node_id", "left_anti").select("node_id")
    protos = t.assignments.filter("cast(object_id as bigint) < 100").join(t.objects, "object_id").select("node_id", "vector")
    return rank.recommend_objects_many(t, leaves, protos, 60).select("target_id", "object_id", F.round("distance", 6).alias("distance"))


@query_of("v19_many", VEC + CENTROIDS + _MANY + ", cand AS (SELECT w.target_id, n.node_id, w.distance FROM nodes n JOIN ways w ON n.parent_id = w.node_id WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.node_id = w.target_id AND cl.ancestor_id = n.node_id)), n AS (SELECT target_id, distance, count(*) AS n FROM cand GROUP BY 1, 2), used AS (SELECT target_id, distance FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY target_id ORDER BY distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) WHERE b <= 2) SELECT target_id, node_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, node_id) AS r FROM (SELECT c.target_id, c.node_id, list_distance(a.vector, b.vector) AS d FROM cand c JOIN used USING (target_id, distance) JOIN centroids a ON a.node_id = c.node_id JOIN centroids b ON b.node_id = c.target_id)) WHERE r <= 2")
def _(s, d):
    t = fx.vectors(s, d)
    inner = t.nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    leaves = t.nodes.join(inner, "node_id", "left_anti").select("node_id")
    return rank.recommend_children_many(t, leaves, stats.centroids(t), 64, 2).select("target_id", "node_id", F.round("distance", 6).alias("distance"))


@query_of("v20_rf_rank", VEC + ", known AS (SELECT object_id FROM assignments JOIN nodes USING (node_id) WHERE approved), refused AS (SELECT DISTINCT object_id FROM rejected WHERE object_id NOT IN (FROM known)) SELECT count(*) AS n, true AS in_range, true AS apart FROM objects")
def _(s, d):
    # All objects are ranked: what approved nodes hold against what any node rejected. The known ones stand well above the rejected ones.
    t = fx.vectors(s, d)
    known = t.assignments.join(t.nodes.filter("approved").select("node_id"), "node_id", "left_semi").select("object_id")
    refused = t.rejected.select("object_id").distinct().join(known, "object_id", "left_anti")
    o = t.objects.select("object_id", "vector")
    found = vector.rf_rank(o, o.join(known, "object_id", "left_semi"), o.join(refused, "object_id", "left_semi"), seed=1, numTrees=10)
    marked = found.join(known.withColumn("known", F.lit(True)), "object_id", "left").join(refused.withColumn("refused", F.lit(True)), "object_id", "left")
    apart = F.avg(F.when(F.col("known"), F.col("score"))) > F.avg(F.when(F.col("refused"), F.col("score"))) + 0.3
    return marked.agg(F.count("score").alias("n"), F.min(F.col("score").between(0, 1)).alias("in_range"), F.coalesce(apart, F.lit(False)).alias("apart"))


# --- order -----------------------------------------------------------------------------------------------------------


@query_of("o03_by_similarity")
def _(s, d):
    return rank.by_similarity(fx.vectors(s, d).objects.select(F.col("object_id").alias("member_id"), "vector"))


@query_of("o04_leaves", GEO + CLOSURE + " SELECT n.node_id, count(l.node_id) AS n_leaves FROM nodes n LEFT JOIN cl ON cl.ancestor_id = n.node_id LEFT JOIN (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)) l ON l.node_id = cl.node_id GROUP BY 1")
def _(s, d):
    return rank.n_leaves(fx.geo(s, d).nodes)


@query_of("o05_anchor_distance", VEC + CENTROIDS + TYPES + " SELECT object_id AS member_id, round(max(list_distance(o.vector, t.vector)), 6) AS key FROM objects o, types t GROUP BY 1")
def _(s, d):
    t, types = _types(s, d)
    return rank.by_anchor_distance(t.objects.select(F.col("object_id").alias("member_id"), "vector"), types).select("member_id", F.round("key", 6).alias("key"))


_RANKED = "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, (SELECT count(*) FROM orders) AS n FROM orders)"


@query_of("o06_interleave", _RANKED + " SELECT o_orderkey, CASE WHEN rank < (n + 1) // 2 THEN 2 * rank ELSE 2 * (n - 1 - rank) + 1 END AS place FROM r")
def _(s, d):
    ranked = rank.numbered(fx.load(s, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"))
    return rank.interleave(ranked, ranked.count()).select("o_orderkey", "place")


@query_of("o07_random_order", "SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS key FROM orders")
def _(s, d):
    return fx.load(s, d, "orders").select("o_orderkey", rank.hashed(F.col("o_orderkey")).alias("key"))


_KIDS = ", kids AS (SELECT node_id, starred FROM nodes WHERE parent_id = 1), own AS (SELECT object_id FROM assignments WHERE node_id = 1)"
_STARRED_FIRST = " UNION ALL SELECT row_number() OVER (ORDER BY node_id) - 1 AS rank, 'node' AS kind, CAST(node_id AS VARCHAR) AS member_id FROM kids WHERE starred"


@query_of("o10_members_by_id", VEC + _KIDS + ", m AS (SELECT 'node' AS kind, CAST(node_id AS VARCHAR) AS member_id, node_id AS n FROM kids WHERE NOT starred UNION ALL SELECT 'object', object_id, NULL FROM own) SELECT row_number() OVER (ORDER BY kind, n, member_id) - 1 + (SELECT count(*) FROM kids WHERE starred) AS rank, kind, member_id FROM m" + _STARRED_FIRST)
def _(s, d):
    return rank.node_members(fx.vectors(s, d), 1)


@query_of("o10_members_by_starred", VEC + CENTROIDS + _KIDS + ", a AS (SELECT vector FROM centroids JOIN kids USING (node_id) WHERE starred), m AS (SELECT 'node' AS kind, CAST(node_id AS VARCHAR) AS member_id, node_id AS n, vector FROM kids JOIN centroids USING (node_id) WHERE NOT starred UNION ALL SELECT 'object', object_id, NULL, vector FROM own JOIN objects USING (object_id)), k AS (SELECT kind, member_id, n, max(list_distance(m.vector, a.vector)) AS key FROM m, a GROUP BY 1, 2, 3) SELECT row_number() OVER (ORDER BY key, kind DESC, n DESC, member_id DESC) - 1 + (SELECT count(*) FROM kids WHERE starred) AS rank, kind, member_id FROM k" + _STARRED_FIRST)
def _(s, d):
    t = fx.vectors(s, d)
    return rank.node_members(t, 1, arrange_by="starred_sim", descending=True, centroids=stats.centroids(t), dim=64)


@query_of("o10_members_by_leaves", GEO + CLOSURE + ", l AS (SELECT ancestor_id AS node_id, count(*) AS n FROM cl WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) GROUP BY 1) SELECT row_number() OVER (ORDER BY l.n DESC, node_id) - 1 AS rank, 'node' AS kind, CAST(node_id AS VARCHAR) AS member_id FROM nodes JOIN l USING (node_id) WHERE parent_id = 3")
def _(s, d):
    return rank.node_members(fx.geo(s, d), 3, objects=False, arrange_by="nleaves", starred_first=False)


@query_of("p07_member_projection", VEC + DEEP + _KIDS + " SELECT 'node' AS kind, node_id, n.name, n_objects_deep, CAST(NULL AS VARCHAR) AS object_id FROM nodes n JOIN deep USING (node_id) WHERE parent_id = 1 UNION ALL SELECT 'object', NULL, NULL, NULL, object_id FROM own")
def _(s, d):
    t = fx.vectors(s, d)
    return rank.project_members(t, rank.node_members(t, 1)).select("kind", "node_id", "name", "n_objects_deep", "object_id")


@query_of("f11_member_keys", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'node' ELSE 'object' END AS kind, CAST(c_custkey AS VARCHAR) AS member_id FROM customer")
def _(s, d):
    c = fx.load(s, d, "customer")
    key = F.concat(F.when(F.col("c_custkey") % 2 == 0, "n").otherwise("o"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", rank.member_keys(key).alias("m")).select("c_custkey", "m.kind", "m.member_id")


@query_of("o11_paginate", _RANKED + " SELECT o_orderkey, rank, CAST(rank // 100 AS INT) AS page FROM r")
def _(s, d):
    return rank.paginate(fx.load(s, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"), page_size=100).select("o_orderkey", "rank", "page")


@query_of("g08_quantiles", "WITH v AS (SELECT list_sort(list(CAST(o_totalprice AS DOUBLE))) AS v, count(*) - 1 AS n FROM orders), h AS (SELECT q, v, n * q AS h FROM v, (SELECT unnest([0, 0.1, 0.25, 0.333, 0.5, 0.875, 1]::DOUBLE[]) AS q)), e AS (SELECT q, v[CAST(floor(h) AS BIGINT) + 1] AS lo, v[CAST(ceil(h) AS BIGINT) + 1] AS hi, h - floor(h) AS t FROM h) SELECT q, CASE WHEN t < 0.5 THEN lo + (hi - lo) * t ELSE hi - (hi - lo) * (1 - t) END AS x FROM e")
def _(s, d):
    shares = [0.0, 0.1, 0.25, 0.333, 0.5, 0.875, 1.0]
    found = rank.quantiles(fx.load(s, d, "orders"), "o_totalprice", shares)
    return s.createDataFrame(list(zip(shares, found)), "q double, x double")


@query_of("o12_round_robin", "SELECT CAST(pos AS INT) AS pos, list_no, item FROM (SELECT o_custkey AS list_no, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) ORDER BY pos, list_no LIMIT 500")
def _(s, d):
    lists = fx.load(s, d, "orders").groupBy(F.col("o_custkey").alias("list_no")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))
    return rank.round_robin(lists, 500)


# --- edits -----------------------------------------------------------------------------------------------------------


@query_of("m01_create_project", "SELECT CAST(1 + r_regionkey AS INT) AS project_id, r_name AS name, r_regionkey % 2 = 0 AS visible FROM region UNION ALL SELECT CAST(max(r_regionkey) + 2 AS INT), 'new', true FROM region")
def _(s, d):
    return edit.create_project(fx.many_projects(s, d), "new").projects.select("project_id", "name", "visible")


@query_of("m02_create_node", GEO + " SELECT node_id, parent_id, name, starred, approved, 1 AS project_id FROM nodes UNION ALL SELECT max(node_id) + 1, 2, 'new', true, false, 1 FROM nodes")
def _(s, d):
    return edit.create_node(fx.geo(s, d), 2, name="new", starred=True)[0].nodes.select("node_id", "parent_id", "name", "starred", "approved", "project_id")


@query_of("m03_relocate_nodes", GEO + " SELECT node_id, CASE WHEN node_id IN (100, 105, 110) THEN 3 ELSE parent_id END AS parent_id FROM nodes")
def _(s, d):
    return edit.relocate_nodes(fx.geo(s, d), [100, 105, 110], 3).nodes.select("node_id", "parent_id")


@query_of("m04_relocate_objects", GEO + " SELECT object_id, CASE WHEN node_id = 0 AND CAST(object_id AS BIGINT) % 2 = 0 THEN 101 ELSE node_id END AS node_id FROM assignments")
def _(s, d):
    t = fx.geo(s, d)
    return edit.relocate_objects(t, t.objects.filter("cast(object_id as bigint) % 2 = 0"), 101, src_node_id=0).assignments.select("object_id", "node_id")


@query_of("m03_relocate_unapprove", GEO + CLOSURE + ", ends AS (SELECT CAST(101 AS BIGINT) AS e UNION SELECT parent_id FROM nodes WHERE parent_id = 102 AND node_id % 2 = 0), through AS (SELECT ancestor_id AS node_id, count(*) AS n FROM cl JOIN ends ON e = cl.node_id GROUP BY 1), stale AS (SELECT node_id FROM through WHERE node_id NOT IN (SELECT parent_id FROM nodes JOIN through USING (node_id) WHERE n = (SELECT count(*) FROM ends) AND parent_id IS NOT NULL)) SELECT node_id, CASE WHEN parent_id = 102 AND node_id % 2 = 0 THEN 101 ELSE parent_id END AS parent_id, node_id NOT IN (FROM stale) AS approved, node_id NOT IN (FROM stale) AS cache_valid FROM nodes")
def _(s, d):
    # Nations 101 and 102 have a region in common, so nothing above it changes.
    t = fx.geo(s, d)
    t = t.with_(nodes=t.nodes.withColumns({"approved": F.lit(True), "cache_valid": F.lit(True)}))
    return edit.relocate_nodes(t, t.nodes.filter("parent_id = 102 and node_id % 2 = 0").select("node_id"), 101, unapprove=True).nodes.select("node_id", "parent_id", "approved", "cache_valid")


_SHARED = """WITH pn AS (SELECT 1 + r_regionkey AS node_id, 1 + r_regionkey AS project_id FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey FROM nation),
pa AS (SELECT CAST(c_custkey AS VARCHAR) AS object_id, 100 + c_nationkey AS node_id FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1 + (n_regionkey + 1) % 5 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0),
home AS (SELECT node_id FROM pn WHERE project_id = (SELECT project_id FROM pn WHERE node_id = 101))"""


def _both(t: Tables, flag: str = "approved") -> DataFrame:
    """(kind, id, at): nodes with a flag, and where objects are."""
    return t.nodes.select(F.lit("n").alias("kind"), F.col("node_id").cast("string").alias("id"), F.col(flag).cast("long").alias("at")).unionByName(t.assignments.select(F.lit("o").alias("kind"), F.col("object_id").alias("id"), F.col("node_id").alias("at")))


@query_of("m04_shared_objects", _SHARED + ", moved AS (SELECT * FROM pa WHERE CAST(object_id AS BIGINT) % 2 = 0 AND node_id IN (FROM home)), touched AS (SELECT node_id FROM moved UNION SELECT 101 UNION SELECT project_id FROM pn WHERE node_id = 101) SELECT 'n' AS kind, CAST(node_id AS VARCHAR) AS id, CAST(node_id NOT IN (FROM touched) AS BIGINT) AS at FROM pn UNION ALL SELECT 'o', object_id, CASE WHEN CAST(object_id AS BIGINT) % 2 = 0 AND node_id IN (FROM home) THEN 101 ELSE node_id END FROM pa")
def _(s, d):
    t = fx.shared_projects(s, d)
    return _both(edit.relocate_objects(t, t.assignments.filter("cast(object_id as bigint) % 2 = 0").select("object_id"), 101, unapprove=True))


_AT_ROOT = ", r AS (SELECT object_id, row_number() OVER (ORDER BY CAST(object_id AS BIGINT)) - 1 AS rank FROM pa WHERE node_id = (SELECT project_id FROM pn WHERE node_id = 101)), yes AS (SELECT object_id FROM r WHERE rank < 20 AND rank % 3 <> 0)"


@query_of("m12_shared_objects", _SHARED + _AT_ROOT + " SELECT object_id, CASE WHEN object_id IN (FROM yes) AND node_id IN (FROM home) THEN 101 ELSE node_id END AS node_id, CAST(0 AS BIGINT) AS rejected_by FROM pa UNION ALL SELECT object_id, 0, 101 FROM r WHERE rank < 20 AND rank % 3 = 0")
def _(s, d):
    t = fx.shared_projects(s, d)
    root = t.nodes.filter("node_id = 101").select(F.col("project_id").cast("long").alias("node_id"))  # a project's root has its number
    paged = rank.paginate(t.assignments.join(root, "node_id", "left_semi").select("object_id", F.col("object_id").cast("long").alias("n")), "n", page_size=10)
    out = edit.accept_recommended(t, 101, paged, 1, paged.filter("rank % 3 = 0").select("object_id"))[0]
    return out.assignments.select("object_id", "node_id", F.lit(0).cast("long").alias("rejected_by")).unionByName(out.rejected.select("object_id", F.lit(0).cast("long").alias("node_id"), F.col("node_id").alias("rejected_by")))


@query_of("m13_shared_objects", _SHARED + ", n2 AS (SELECT n_nationkey + 100 AS k FROM nation WHERE n_regionkey = 1 AND n_nationkey > 1) SELECT 'n' AS kind, CAST(node_id AS VARCHAR) AS id, CASE WHEN node_id IN (FROM n2) THEN 101 WHEN node_id >= 100 THEN project_id END AS at FROM pn UNION ALL SELECT 'o', object_id, CASE WHEN CAST(object_id AS BIGINT) % 5 = 0 AND node_id IN (FROM home) THEN 101 ELSE node_id END FROM pa")
def _(s, d):
    t = fx.shared_projects(s, d)
    out = edit.adopt(t, 101, t.nodes.filter("project_id = 2 and node_id > 101").select("node_id"), t.assignments.filter("cast(object_id as bigint) % 5 = 0").select("object_id"))
    return _both(out, "parent_id")


@query_of("m05_reject_objects", GEO + " SELECT node_id, object_id FROM rejected UNION ALL SELECT 7, object_id FROM assignments WHERE node_id = 0")
def _(s, d):
    t = fx.geo(s, d)
    return edit.reject_objects(t, 7, t.assignments.filter("node_id = 0").select("object_id")).rejected.select("node_id", "object_id")


@query_of("m06_merge_node", GEO + " SELECT CAST('n' AS VARCHAR) AS kind, CAST(node_id AS VARCHAR) AS id, CASE WHEN parent_id = 104 THEN 103 ELSE parent_id END AS at FROM nodes WHERE node_id <> 104 UNION ALL SELECT 'o', object_id, CASE WHEN node_id = 104 THEN 103 ELSE node_id END FROM assignments")
def _(s, d):
    t = edit.merge_node_into(fx.geo(s, d), 104, 103)
    return t.nodes.select(F.lit("n").alias("kind"), F.col("node_id").cast("string").alias("id"), F.col("parent_id").alias("at")).unionByName(t.assignments.select(F.lit("o").alias("kind"), F.col("object_id").alias("id"), F.col("node_id").alias("at")))


@query_of("m07_update_node", GEO + " SELECT node_id, CASE WHEN node_id = 102 THEN 'renamed' ELSE name END AS name, CASE WHEN node_id = 102 THEN true ELSE approved END AS approved FROM nodes")
def _(s, d):
    return edit.update_node(fx.geo(s, d), 102, name="renamed", approved=True).nodes.select("node_id", "name", "approved")


@query_of("m08_reset_grown", GEO + " SELECT node_id, false AS filled FROM nodes")
def _(s, d):
    return edit.reset_grown(fx.geo(s, d), 1).nodes.select("node_id", "filled")


@query_of("m09_invalidate_path", GEO + CLOSURE + " SELECT node_id, node_id NOT IN (SELECT ancestor_id FROM cl WHERE node_id IN (1001, 1002)) AS cache_valid FROM nodes")
def _(s, d):
    return edit.invalidate_path(fx.geo(s, d).nodes, [1001, 1002]).select("node_id", "cache_valid")


@query_of("m10_invalidate", GEO + " SELECT node_id, node_id NOT IN (100, 101) AS cache_valid, approved AND node_id NOT IN (100, 101) AS approved FROM nodes")
def _(s, d):
    return edit.invalidate(fx.geo(s, d).nodes, [100, 101], True).select("node_id", "cache_valid", "approved")


@query_of("m11_clear_cache", GEO + " SELECT node_id, false AS cache_valid, true AS emptied FROM nodes")
def _(s, d):
    t = fx.geo(s, d)
    nodes = edit.clear_cache(stats.consolidate(t.with_(objects=t.objects.withColumn("vector", F.lit(None).cast("array<double>"))), 0).drop("superparent_id"))
    return nodes.select("node_id", "cache_valid", (F.col("_n_objects").isNull() & F.col("_centroid").isNull()).alias("emptied"))


@query_of("m12_accept_recommended", GEO + ", r AS (SELECT object_id, row_number() OVER (ORDER BY CAST(object_id AS BIGINT)) - 1 AS rank FROM assignments WHERE node_id = 0) SELECT a.object_id, CASE WHEN rank < 20 AND rank % 3 <> 0 THEN 102 ELSE node_id END AS node_id FROM assignments a LEFT JOIN r USING (object_id)")
def _(s, d):
    t = fx.geo(s, d)
    paged = rank.paginate(t.assignments.filter("node_id = 0").select("object_id", F.col("object_id").cast("long").alias("n")), "n", page_size=10)
    return edit.accept_recommended(t, 102, paged, 1, paged.filter("rank % 3 = 0").select("object_id"))[0].assignments.select("object_id", "node_id")


@query_of("s19_accept_reject_stats", GEO + ", r AS (SELECT object_id, row_number() OVER (ORDER BY CAST(object_id AS BIGINT)) - 1 AS rank FROM assignments WHERE node_id = 0) SELECT object_id, rank, rank % 3 = 0 AS rejected FROM r WHERE rank < 20")
def _(s, d):
    t = fx.geo(s, d)
    paged = rank.paginate(t.assignments.filter("node_id = 0").select("object_id", F.col("object_id").cast("long").alias("n")), "n", page_size=10)
    return edit.accept_reject_stats(paged.filter("page <= 1"), paged.filter("rank % 3 = 0").select("object_id"))


@query_of("g11_accept_reject_counts", GEO + ", r AS (SELECT object_id, row_number() OVER (ORDER BY CAST(object_id AS BIGINT)) - 1 AS rank FROM assignments WHERE node_id = 0) SELECT count(CASE WHEN rank % 3 <> 0 THEN 1 END) AS n_accepted, count(CASE WHEN rank % 3 = 0 THEN 1 END) AS n_rejected FROM r WHERE rank < 20")
def _(s, d):
    t = fx.geo(s, d)
    paged = rank.paginate(t.assignments.filter("node_id = 0").select("object_id", F.col("object_id").cast("long").alias("n")), "n", page_size=10)
    return edit.accept_recommended(t, 102, paged, 1, paged.filter("rank % 3 = 0").select("object_id"))[1].agg(F.count(F.when(~F.col("rejected"), 1)).alias("n_accepted"), F.count(F.when(F.col("rejected"), 1)).alias("n_rejected"))


@query_of("m13_adopt", GEO + " SELECT CAST('n' AS VARCHAR) AS kind, CAST(node_id AS VARCHAR) AS id, CASE WHEN node_id = 107 THEN 5 ELSE parent_id END AS at FROM nodes UNION ALL SELECT 'o', object_id, CASE WHEN node_id = 0 THEN 5 ELSE node_id END FROM assignments")
def _(s, d):
    t = fx.geo(s, d)
    t = edit.adopt(t, 5, [107], t.assignments.filter("node_id = 0").select("object_id"))
    return t.nodes.select(F.lit("n").alias("kind"), F.col("node_id").cast("string").alias("id"), F.col("parent_id").alias("at")).unionByName(t.assignments.select(F.lit("o").alias("kind"), F.col("object_id").alias("id"), F.col("node_id").alias("at")))


_TREE2 = ", lab AS (SELECT CAST(vec_id AS VARCHAR) AS object_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 2 = 0), top AS (SELECT max(label) + 1 AS t FROM lab), off AS (SELECT (SELECT max(node_id) FROM nodes) + 1 - least(min(label), 99) AS o FROM lab WHERE label >= 0)"


@query_of("m14_merge_trees", VEC + _TREE2 + " SELECT object_id, node_id FROM assignments WHERE object_id NOT IN (SELECT object_id FROM lab) UNION ALL SELECT object_id, CASE WHEN label = -1 THEN 0 ELSE label + o END FROM lab, off")
def _(s, d):
    t = fx.vector_tree(s, d)
    return io.merge_trees(Tree(t.nodes.select("node_id", "parent_id", "name"), t.objects), io.tree_from_labels(fx.labels(s, d, True))).objects.select("object_id", "node_id")


@query_of("m15_offset", GEO + " SELECT node_id + 500 AS node_id, parent_id + 500 AS parent_id FROM nodes")
def _(s, d):
    return io.offset_ids(fx.geo_tree(s, d), 500).nodes.select("node_id", "parent_id")


@query_of("m16_append_log", "SELECT event_id AS log_id, event_type AS action FROM events UNION ALL SELECT max(event_id) + 1, 'approve' FROM events")
def _(s, d):
    return edit.append_log(fx.vectors(s, d), "approve", 12, '{"a": 1}').log.select("log_id", "action")


@query_of("m17_drop_project", "SELECT event_id AS log_id, CASE WHEN event_id % 12 >= 10 THEN 10 + event_id % 12 END AS node_id FROM events")
def _(s, d):
    return edit.drop_project(fx.vectors(s, d), 1).log.select("log_id", "node_id")


@query_of("f09_log_data", "SELECT event_id AS log_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT max(event_id) + 1, 7 FROM events")
def _(s, d):
    log = edit.append_log(fx.vectors(s, d), "approve", 12, {"k": 7}).log
    return edit.log_data(log, "k long").select("log_id", F.col("data.k").alias("k"))


# --- sources ---------------------------------------------------------------------------------------------------------


@query_of("s01_duplicate_ids", "SELECT CAST(o_custkey AS VARCHAR) AS object_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return io.duplicates(fx.load(s, d, "orders").select(F.col("o_custkey").cast("string").alias("object_id")))


@query_of("s02_upsert_objects", "SELECT CAST(c_custkey AS VARCHAR) AS object_id, CASE WHEN c_custkey % 2 = 0 THEN 'new/' || c_name ELSE c_name END AS path FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def _(s, d):
    c = fx.load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), F.col("c_name").alias("path"), "c_custkey")
    return io.upsert_objects(c.filter("c_custkey % 3 = 0").select("object_id", "path"), c.filter("c_custkey % 2 = 0").select("object_id", F.concat(F.lit("new/"), "path").alias("path")))


@query_of("s03_set_features", "SELECT CAST(vec_id AS VARCHAR) AS object_id, CASE WHEN vec_id % 17 <> 0 THEN round(embedding[3], 6) END AS third FROM embeddings")
def _(s, d):
    objects = fx.vectors(s, d).objects.withColumn("vector", F.lit(None).cast("array<double>"))
    return io.set_features(objects, fx.features(s, d), truncate=3, max_dim=100).select("object_id", F.round(F.col("vector")[2], 6).alias("third"))


def _folder(s, label: str) -> str:
    return f"{shared_root(s)}/{label}-{uuid.uuid4().hex}"


def _members(tree: Tree) -> DataFrame:
    """(kind, id, at): all members of a tree, and its metadata but for where it was read from."""
    meta = {k: v for k, v in tree.meta.items() if k != "base"}
    rows = [
        tree.nodes.select(F.lit("node").alias("kind"), F.concat_ws(" ", F.col("node_id").cast("string"), F.coalesce("name", F.lit("-"))).alias("id"), F.col("parent_id").alias("at")),
        tree.objects.select(F.lit("object").alias("kind"), F.col("object_id").alias("id"), F.col("node_id").alias("at")),
        tree.nodes.limit(1).select(F.lit("meta").alias("kind"), F.lit(json.dumps(meta, sort_keys=True)).alias("id"), F.lit(None).cast("long").alias("at")),
    ]
    if tree.rejected is not None:
        rows.append(tree.rejected.select(F.lit("rejected").alias("kind"), F.col("object_id").alias("id"), F.col("node_id").alias("at")))
    return reduce(DataFrame.unionByName, rows)


_MEMBERS = " SELECT 'node' AS kind, node_id || ' ' || coalesce(name, '-') AS id, parent_id AS at FROM nodes UNION ALL SELECT 'object', object_id, node_id FROM assignments UNION ALL SELECT 'rejected', object_id, node_id FROM rejected UNION ALL SELECT 'meta', '{\"made\": \"here\"}', NULL"


@query_of("s05_saved_tree", VEC + _MEMBERS)
def _(s, d):
    path = _folder(s, "tree")
    io.write_tree(fx.vector_tree(s, d), path, {"made": "here"})
    return _members(io.read_tree(s, path))


@query_of("s04_feature_dataset", "SELECT CASE WHEN vec_id % 17 = 0 THEN 'x' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS object_id, round(embedding[2], 6) AS second FROM embeddings UNION ALL SELECT 'again' || vec_id, round(embedding[2], 6) FROM embeddings")
def _(s, d):
    paths = [_folder(s, "features") for _ in range(2)]
    fx.features(s, d).write.parquet(paths[0])
    fx.load(s, d, "embeddings").select(F.concat(F.lit("again"), F.col("vec_id").cast("string")).alias("object_id"), F.col("embedding").alias("features")).write.parquet(paths[1])
    return io.read_features(s, paths).select("object_id", F.round(F.col("features")[1], 6).alias("second"))


@query_of("s03_last_features", "SELECT CAST(vec_id AS VARCHAR) AS object_id, CASE WHEN vec_id % 3 = 0 THEN round(2 * embedding[1], 5) ELSE round(embedding[1], 5) END AS first FROM embeddings")
def _(s, d):
    # Every third object is in both datasets; the later one stands.
    o = fx.vectors(s, d).objects
    early = o.select("object_id", F.col("vector").alias("features"))
    late = o.filter("cast(object_id as bigint) % 3 = 0").select("object_id", F.transform("vector", lambda x: 2 * x).alias("features"))
    return io.set_features(o, early, late).select("object_id", F.round(F.col("vector")[0], 5).alias("first"))


@query_of("s03_pca_features", VEC + ", f AS (SELECT object_id, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM objects), m AS (SELECT pos, avg(x) AS m FROM f GROUP BY 1) SELECT object_id, round(sum((x - m) * (x - m)), 5) AS length FROM f JOIN m USING (pos) GROUP BY 1")
def _(s, d):
    o = fx.vectors(s, d).objects
    found = io.set_features(o, o.select("object_id", F.col("vector").alias("features")), pca=64)
    return found.select("object_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 5).alias("length"))


@query_of("s11_export_index", "SELECT 'o' || s_suppkey AS object_id, 'export/' || s_name || '.png' AS path FROM supplier")
def _(s, d):
    path = _folder(s, "export")
    rows = fx.load(s, d, "supplier").select(F.concat(F.lit("o"), F.col("s_suppkey").cast("string")).alias("object_id"), F.concat("s_name", F.lit(".png")).alias("img_file_name"))
    types = s.range(1).select(F.lit("[t]").alias("object_id"), F.lit("[t]").alias("img_file_name"))
    types.unionByName(rows).coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return io.fix_export_index(s, f"{path}/*.csv").select("object_id", F.concat(F.lit("export/"), F.regexp_extract("path", "[^/]*$", 0)).alias("path"))


@query_of("s14_id_offset", GEO + " SELECT max(node_id) + 1 - (SELECT min(label) FROM embeddings WHERE vec_id % 7 <> 0) AS n FROM nodes")
def _(s, d):
    return s.range(1).select(F.lit(io.id_offset(fx.geo(s, d).nodes, io.tree_from_labels(fx.labels(s, d)), 1)).cast("long").alias("n"))


@query_of("s16_export_labels", GEO + _LABELS.format(step=_CLEAN) + " SELECT object_id, label FROM assignments JOIN lab USING (node_id) WHERE label IS NOT NULL")
def _(s, d):
    path = _folder(s, "labels")
    io.export_labels(fx.geo_tree(s, d), path)
    return s.read.option("header", True).csv(path)


@query_of("s17_export_objects", GEO + " SELECT object_id FROM assignments WHERE node_id = 101")
def _(s, d):
    path = _folder(s, "objects")
    io.export_direct_objects(fx.geo(s, d), 101, path)
    return s.read.text(path).select(F.col("value").alias("object_id"))


@query_of("s20_checked_tree", VEC + " SELECT object_id, node_id FROM assignments")
def _(s, d):
    return check_tree(fx.vector_tree(s, d)).objects.select("object_id", "node_id")


@query_of("f10_stored_random", "SELECT CAST(vec_id AS VARCHAR) AS object_id, true AS inside FROM embeddings")
def _(s, d):
    found = io.with_rand(fx.vectors(s, d).objects.drop("rand"), 3)
    return found.select("object_id", ((F.col("rand") >= 0) & (F.col("rand") < 1)).alias("inside"))


@query_of("s07_tree_from_collection", "WITH l AS (SELECT DISTINCT c_mktsegment FROM customer), n AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS node_id FROM l) SELECT CAST(c_custkey AS VARCHAR) AS object_id, node_id FROM customer JOIN n USING (c_mktsegment) UNION ALL SELECT 's' || s_suppkey, (SELECT count(*) FROM l) FROM supplier")
def _(s, d):
    c = fx.load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), F.col("c_mktsegment").alias("label"))
    return io.tree_from_collection(c, fx.load(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("object_id"))).objects


@query_of("s08_tree_from_labels", "SELECT CAST(vec_id AS VARCHAR) AS object_id, CASE WHEN vec_id % 7 = 0 THEN (SELECT max(label) + 1 FROM embeddings) ELSE label END AS node_id FROM embeddings")
def _(s, d):
    return io.tree_from_labels(fx.labels(s, d)).objects


@query_of("s09_tree_from_cluster_labels", "SELECT CAST(vec_id AS VARCHAR) AS object_id, CASE WHEN vec_id % 2 = 1 THEN (SELECT max(label) + 1 FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 7 <> 0) WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS node_id FROM embeddings")
def _(s, d):
    return io.tree_from_cluster_labels(fx.labels(s, d, True), fx.vectors(s, d).objects).objects


@query_of("s10_tree_from_condensed", GEO + " SELECT object_id, node_id FROM assignments")
def _(s, d):
    t = fx.geo(s, d)
    edges = t.nodes.filter("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("node_id").alias("child"), F.lit(2).alias("child_size"))
    edges = edges.unionByName(t.assignments.select(F.col("node_id").alias("parent"), F.col("object_id").cast("long").alias("child"), F.lit(1).alias("child_size")))
    return io.tree_from_condensed(edges, t.assignments.select(F.col("object_id").cast("long").alias("position"), "object_id")).objects


@query_of("s12_load_project", GEO + DEEP + " SELECT node_id AS orig_id, n_objects_deep FROM deep")
def _(s, d):
    t = fx.geo(s, d)
    empty = Tables(t.nodes.filter("false"), t.assignments.filter("false"))
    loaded = io.load_project(empty, fx.geo_tree(s, d), 4, 50_000)
    return query.n_objects_deep(loaded.nodes, loaded.assignments).join(loaded.nodes.select("node_id", "orig_id"), "node_id").select("orig_id", "n_objects_deep")


@query_of("s13_update_project", VEC + ", lab AS (SELECT CAST(vec_id AS VARCHAR) AS object_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings) SELECT a.object_id, CASE WHEN a.node_id = 0 AND label >= 0 THEN label ELSE a.node_id END AS at FROM assignments a JOIN lab USING (object_id)")
def _(s, d):
    t = fx.vectors(s, d)
    out = io.update_project(t, 1, io.tree_from_labels(fx.labels(s, d)))
    old = t.nodes.agg(F.max("node_id").alias("most"))
    return out.assignments.join(out.nodes.select("node_id", "orig_id"), "node_id").crossJoin(F.broadcast(old)).select("object_id", F.when(F.col("node_id") > F.col("most"), F.col("orig_id")).otherwise(F.col("node_id")).alias("at"))


@query_of("s15_dump_tree", GEO + DEEP + " SELECT node_id, CASE WHEN node_id <> 2 THEN parent_id END AS parent_id, n_objects_deep FROM cl JOIN nodes USING (node_id) JOIN deep USING (node_id) WHERE ancestor_id = 2")
def _(s, d):
    return io.dump_tree(fx.geo(s, d), 2).nodes.select("node_id", "parent_id", F.col("_n_objects_deep").alias("n_objects_deep"))


@query_of("s21_edges", GEO + " SELECT parent_id, node_id FROM nodes")
def _(s, d):
    return io.edges(fx.geo(s, d).nodes)


# --- re-clustering ---------------------------------------------------------------------------------------------------

_FEATURES = ", f AS (SELECT CASE WHEN vec_id % 17 = 0 THEN 'x' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS object_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), appr AS (SELECT object_id FROM assignments JOIN nodes USING (node_id) WHERE approved)"


@query_of("r01_unapproved", VEC + _FEATURES + " SELECT object_id FROM f WHERE object_id NOT IN (SELECT object_id FROM appr)")
def _(s, d):
    return recluster.unapproved(fx.features(s, d), [fx.vector_tree(s, d)]).select("object_id")


@query_of("g10_availability", VEC + _FEATURES + " SELECT count(CASE WHEN f.object_id IS NOT NULL AND a.object_id IS NULL THEN 1 END) AS n_dataset_only, count(CASE WHEN f.object_id IS NOT NULL AND a.object_id IS NOT NULL THEN 1 END) AS n_both, count(CASE WHEN f.object_id IS NULL THEN 1 END) AS n_tree_only, count(CASE WHEN f.object_id IN (SELECT object_id FROM appr) THEN 1 END) AS n_approved, count(CASE WHEN f.object_id NOT IN (SELECT object_id FROM appr) THEN 1 END) AS n_unapproved, round(count(CASE WHEN f.object_id IN (SELECT object_id FROM appr) THEN 1 END) / count(f.object_id), 6) AS approved_share FROM f FULL JOIN assignments a ON a.object_id = f.object_id")
def _(s, d):
    return recluster.availability(fx.features(s, d), [fx.vector_tree(s, d)]).withColumn("approved_share", F.round("approved_share", 6))


@query_of("r02_keep_unexplored", VEC + MEANS + _FEATURES + ", m AS (SELECT node_id, pos, avg(x) AS x FROM (SELECT node_id, unnest(f.vector) AS x, unnest(range(1, 65)) AS pos FROM f JOIN assignments USING (object_id) JOIN nodes USING (node_id) WHERE approved) GROUP BY 1, 2), c AS (SELECT node_id, list(x ORDER BY pos) AS vector FROM m GROUP BY 1), near AS (SELECT object_id, min(list_distance(f.vector, c.vector)) AS d FROM f, c WHERE object_id NOT IN (SELECT object_id FROM appr) GROUP BY 1) SELECT object_id FROM near WHERE d >= (SELECT quantile_cont(d, 0.7) FROM near)")
def _(s, d):
    f, t = fx.features(s, d), fx.vector_tree(s, d)
    return recluster.keep_unexplored(f, [t], recluster.unapproved(f, [t]), 0.3).select("object_id")


@query_of("r03_subsample", VEC + _FEATURES + " SELECT count(*) AS n, count(*) AS n_distinct FROM (SELECT object_id FROM f LIMIT 100)")
def _(s, d):
    f = fx.features(s, d)
    return recluster.subsample(f, 100).select("object_id").join(f.select("object_id"), "object_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object_id").alias("n_distinct"))


@query_of("r04_neighbours", VEC + " SELECT object_id, round(d, 6) AS d, rank FROM (SELECT a.object_id, list_distance(a.vector, b.vector) AS d, row_number() OVER (PARTITION BY a.object_id ORDER BY list_distance(a.vector, b.vector), b.object_id) AS rank FROM objects a JOIN objects b ON a.object_id <> b.object_id) WHERE rank <= 3")
def _(s, d):
    return recluster.neighbours(fx.vectors(s, d).objects, 3).select("object_id", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


@query_of("r04_density_cluster")
def _(s, d):
    return recluster.density_cluster(fx.features(s, d), 8)


@query_of("r05_cluster_tree", VEC + _FEATURES + " SELECT object_id FROM f WHERE object_id NOT IN (SELECT object_id FROM appr)")
def _(s, d):
    return recluster.cluster(fx.features(s, d), [fx.vector_tree(s, d)], n_pca=8, min_cluster_size=8).objects.select("object_id")


@query_of("r09_saved_merge", VEC + _FEATURES + " SELECT object_id, node_id FROM assignments WHERE object_id NOT IN (SELECT object_id FROM f) UNION ALL SELECT object_id, CAST(0 AS BIGINT) FROM f")
def _(s, d):
    path = _folder(s, "merged")
    t = fx.vector_tree(s, d)
    recluster.save_merged([Tree(t.nodes.select("node_id", "parent_id", "name", "approved"), t.objects), recluster.init_tree(fx.features(s, d))], path, [{"start": 0}])
    return io.read_tree(s, path).objects.select("object_id", "node_id")


@query_of("r10_recluster_project", VEC + _FEATURES + " SELECT 'vectors-8' AS project, object_id FROM (SELECT object_id FROM assignments UNION SELECT object_id FROM f WHERE object_id NOT IN (SELECT object_id FROM appr))")
def _(s, d):
    t = fx.vectors(s, d).with_(projects=s.range(1).select(F.lit(1).alias("project_id"), F.lit("vectors").alias("name"), F.lit(True).alias("visible")))
    out, new = recluster.recluster_project(t, 1, fx.features(s, d), 8, sample_size=None)
    own = out.nodes.filter(F.col("project_id") == new).filter("cache_valid").select("node_id", "project_id")
    return out.assignments.join(own, "node_id").join(out.projects, "project_id").select(F.col("name").alias("project"), "object_id")


@query_of("r06_init_tree", VEC + _FEATURES + " SELECT object_id, CAST(0 AS BIGINT) AS node_id FROM f")
def _(s, d):
    return recluster.init_tree(fx.features(s, d)).objects


@query_of("r11_merge_all", VEC + _FEATURES + " SELECT object_id, CASE WHEN object_id IN (SELECT object_id FROM assignments WHERE node_id <> 0) THEN (SELECT node_id + 1 FROM assignments a WHERE a.object_id = o.object_id) ELSE 0 END AS node_id FROM (SELECT object_id FROM f UNION SELECT object_id FROM assignments) o")
def _(s, d):
    t = fx.vector_tree(s, d)
    return recluster.merge_all(fx.features(s, d), [Tree(t.nodes.select("node_id", "parent_id", "name", "approved"), t.objects)]).objects.select("object_id", "node_id")


@query_of("g09_weighted_mean", "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY 1")
def _(s, d):
    rows = fx.load(s, d, "lineitem").select("l_suppkey", F.array("l_discount").alias("vector"), "l_quantity")
    return mean_vectors(rows, "l_suppkey", weight=F.col("l_quantity")).select("l_suppkey", F.round(F.col("vector")[0], 6).alias("m"))
