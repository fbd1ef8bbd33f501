"""Trees made of the benchmark tables, as SELECTs that Spark runs over the Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.shared import shuffled
from .schema import Tables, Tree


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


GEO_NODES = """
SELECT CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS STRING) AS name, false AS starred, false AS approved, false AS filled, false AS preferred
UNION ALL SELECT 1 + r_regionkey, 0, r_name, false, false, false, false FROM region
UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_name END, n_nationkey % 5 = 0, n_nationkey % 7 = 0, n_nationkey % 2 = 0, n_nationkey % 11 = 0 FROM nation
UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(c_mktsegment, '/', c_name) END, c_mktsegment = 'BUILDING', c_acctbal > 5000, c_custkey % 3 = 0, c_custkey % 11 = 0 FROM customer
"""
GEO_ASSIGNMENTS = """
SELECT CAST(o_orderkey AS STRING) AS object_id, CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 10 = 0 THEN 100 + c_nationkey ELSE 1000 + o_custkey END AS node_id
FROM orders JOIN customer ON o_custkey = c_custkey
"""
GEO_REJECTED = "SELECT 100 + c_nationkey AS node_id, CAST(o_orderkey AS STRING) AS object_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%'"
VEC_NODES = """
SELECT CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS STRING) AS name, false AS starred, false AS approved, false AS filled, false AS preferred
UNION ALL SELECT 1 + g, 0, concat('group', CAST(g AS STRING)), false, false, false, false FROM (SELECT DISTINCT label % 3 AS g FROM embeddings)
UNION ALL SELECT 10 + label, 1 + label % 3, concat('leaf', CAST(label AS STRING)), label % 2 = 0, label < 4, false, false FROM (SELECT DISTINCT label FROM embeddings)
"""
VEC_ASSIGNMENTS = "SELECT CAST(vec_id AS STRING) AS object_id, CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 5 = 1 THEN 1 + label % 3 ELSE 10 + label END AS node_id FROM embeddings"
VEC_REJECTED = "SELECT 10 + (label + 1) % 10 AS node_id, CAST(vec_id AS STRING) AS object_id FROM embeddings WHERE vec_id % 13 = 0"


def _select(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...], joined: str = "") -> DataFrame:
    """What sql selects; `joined` is a table that grows and that its joins must not broadcast."""
    views = {n: shuffled(load(spark, sf_dir, n)) if n == joined else load(spark, sf_dir, n) for n in names}
    text = sql
    for n in names:
        text = text.replace(f" {n} ", f" {{{n}}} ").replace(f" {n}\n", f" {{{n}}}\n").replace(f" {n})", f" {{{n}}})")
    return spark.sql(text + " ", **views)


def geo(spark: SparkSession, sf_dir: str) -> Tables:
    """Regions, nations and customers as nodes, orders as objects."""
    nodes = _select(spark, sf_dir, GEO_NODES, ("region", "nation", "customer")).withColumn("project_id", F.lit(1)).withColumn("orig_id", F.col("node_id"))
    at = lambda sql: _select(spark, sf_dir, sql + " ", ("orders", "customer"), "customer").withColumn("node_id", F.col("node_id").cast("long"))
    return Tables(nodes, at(GEO_ASSIGNMENTS), at(GEO_ASSIGNMENTS).select("object_id"), at(GEO_REJECTED))


def vectors(spark: SparkSession, sf_dir: str) -> Tables:
    """Labels as leaves of three groups, embeddings as objects with vectors."""
    nodes = _select(spark, sf_dir, VEC_NODES, ("embeddings",)).withColumn("project_id", F.lit(1)).withColumn("orig_id", F.col("node_id"))
    at = lambda sql: _select(spark, sf_dir, sql + " ", ("embeddings",)).withColumn("node_id", F.col("node_id").cast("long"))
    objects = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("object_id"), F.concat(F.lit("p/"), F.col("vec_id").cast("string")).alias("path"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        (F.pmod(F.col("vec_id") * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296).cast("double")).alias("rand"),
    )
    return Tables(nodes, at(VEC_ASSIGNMENTS), objects, at(VEC_REJECTED), None, log(spark, sf_dir))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of actions."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"), (10 + F.col("event_id") % 12).alias("node_id"), F.col("user_id").cast("string").alias("username"), F.col("event_type").alias("action"), F.lit(None).cast("string").alias("reverse_action"), F.col("props").alias("data")
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, some under ids that no tree has."""
    known = F.col("vec_id").cast("string")
    return load(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 17 == 0, F.concat(F.lit("x"), known)).otherwise(known).alias("object_id"), F.col("embedding").alias("features"))


def labels(spark: SparkSession, sf_dir: str, even_only: bool = False) -> DataFrame:
    """(object_id, label), -1 for every seventh vector."""
    rows = load(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0" if even_only else "true")
    return rows.select(F.col("vec_id").cast("string").alias("object_id"), F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).alias("label"))


def geo_tree(spark: SparkSession, sf_dir: str) -> Tree:
    t = geo(spark, sf_dir)
    return Tree(t.nodes, t.assignments)


def vector_tree(spark: SparkSession, sf_dir: str) -> Tree:
    t = vectors(spark, sf_dir)
    return Tree(t.nodes, t.assignments, t.rejected)


#: Chains of 25 customers, the first of each hanging on the first of the chain before: n / 25 + 24 levels.
DEEP_NODES = """
SELECT c_custkey AS node_id, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 25 = 0 THEN c_custkey - 25 ELSE c_custkey - 1 END AS parent_id,
CASE WHEN c_custkey % 25 = 20 THEN NULL ELSE concat(c_mktsegment, '/', CAST(c_custkey % 10 AS STRING)) END AS name, c_custkey % 7 = 0 AS starred, c_custkey % 11 = 0 AS approved, c_custkey % 3 = 0 AS filled, false AS preferred FROM customer
"""
DEEP_ASSIGNMENTS = "SELECT CAST(o_orderkey AS STRING) AS object_id, o_custkey AS node_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"


def deep(spark: SparkSession, sf_dir: str) -> Tables:
    """A deep tree of customers, with orders as objects."""
    nodes = _select(spark, sf_dir, DEEP_NODES, ("customer",)).withColumns({"node_id": F.col("node_id").cast("long"), "parent_id": F.col("parent_id").cast("long"), "project_id": F.lit(1)})
    # The rows of DEEP_ASSIGNMENTS, with a join that doesn't broadcast the customers.
    known = shuffled(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")))
    rows = load(spark, sf_dir, "orders").join(known, "o_custkey", "left_semi")
    return Tables(nodes, rows.select(F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_custkey").cast("long").alias("node_id")))


def deep_with_vectors(spark: SparkSession, sf_dir: str) -> Tables:
    """The deep tree, with vectors of two numbers made of the orders' keys."""
    t = deep(spark, sf_dir)
    key = F.col("o_orderkey")
    rand = F.pmod(key * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296).cast("double")
    vector = F.array((key % 97).cast("double"), (key % 31).cast("double"))
    return t.with_(objects=load(spark, sf_dir, "orders").select(key.cast("string").alias("object_id"), vector.alias("vector"), rand.alias("rand")))


def many_projects(spark: SparkSession, sf_dir: str) -> Tables:
    """Each region a project with nations below it and customers as objects."""
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    flags = lambda key: [(key % 5 == 0).alias("starred"), (key % 7 == 0).alias("approved"), (key % 2 == 0).alias("filled"), F.lit(False).alias("preferred")]
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    tops = region.select((1 + r).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), (1 + r).cast("int").alias("project_id"), F.lit(None).cast("string").alias("name"), *flags(F.lit(1)))
    rest = nation.select((100 + n).cast("long").alias("node_id"), (1 + F.col("n_regionkey")).cast("long").alias("parent_id"), (1 + F.col("n_regionkey")).cast("int").alias("project_id"), F.when(n % 4 != 3, F.col("n_name")).alias("name"), *flags(n))
    objects = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), (100 + F.col("c_nationkey")).cast("long").alias("node_id"))
    projects = region.select((1 + r).cast("int").alias("project_id"), F.col("r_name").alias("name"), (r % 2 == 0).alias("visible"))
    return Tables(tops.unionByName(rest), objects, projects=projects)


def shared_projects(spark: SparkSession, sf_dir: str) -> Tables:
    """many_projects, and every third customer in the root of the next region's project as well; all nodes are approved and have valid caches."""
    t = many_projects(spark, sf_dir)
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    twice = load(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").join(nation, "c_nationkey").select(F.col("c_custkey").cast("string").alias("object_id"), (1 + (F.col("n_regionkey") + 1) % 5).cast("long").alias("node_id"))
    rejected = t.assignments.filter("false").select("node_id", "object_id")
    return t.with_(nodes=t.nodes.withColumns({"approved": F.lit(True), "cache_valid": F.lit(True)}), assignments=t.assignments.unionByName(twice), rejected=rejected)
