"""Recommendation, ordering and paging."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import euclidean, zero_fill
from ..plans.blocks import block_pairs
from ..plans.closure import ancestors, subtree_sums, ways_up
from ..plans.shared import is_small, small, written
from ..schema import Tables
from .vector import _far_pairs, prototype_distance

PAGE_SIZES = {"members": 100, "children": 20, "objects": 50}


def recommend_objects(tables: Tables, node_id: int, prototypes: DataFrame, max_n: int = 1000) -> DataFrame:
    """(object_id, distance): objects directly under the node's ancestors, nearest ancestors first until max_n are found, without those that the node rejected; the max_n nearest to the node's prototypes (vector)."""
    if prototypes.isEmpty():
        raise LookupError(f"node {node_id} has no prototypes")
    up = ancestors(tables.nodes, node_id).filter("level < 0").select("node_id", (-F.col("level")).alias("distance_up"))
    refused = tables.rejected.filter(F.col("node_id") == node_id).select("object_id")
    found = tables.assignments.join(small(up), "node_id").join(refused, "object_id", "left_anti")
    counts = found.groupBy("distance_up").agg(F.count(F.lit(1)).alias("n"))
    # One row per ancestor; an ancestor is used if those before it gave fewer than max_n.
    before = F.coalesce(F.sum("n").over(Window.orderBy("distance_up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("before", before).filter(F.col("before") < max_n).select("distance_up")
    points = found.join(F.broadcast(used), "distance_up").select("object_id").distinct().join(tables.objects.select("object_id", "vector"), "object_id")
    return prototype_distance(points, prototypes).orderBy("distance", "object_id").limit(max_n)


def recommend_children(tables: Tables, node_id: int, centroids: DataFrame, dim: int, max_n: int = 1000) -> DataFrame:
    """(node_id, distance): children of the node's ancestors that aren't on its own path, nearest ancestors first until more than max_n are found, by distance of centroids (node_id, vector); none counts as zero."""
    path = ancestors(tables.nodes, node_id)
    up = path.filter("level < 0").select(F.col("node_id").alias("parent_id"), (-F.col("level")).alias("distance_up"))
    found = tables.nodes.join(small(up), "parent_id").join(path.select("node_id"), "node_id", "left_anti").select("node_id", "distance_up")
    counts = found.groupBy("distance_up").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("distance_up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("before", before).filter(F.col("before") <= max_n).select("distance_up")
    own = centroids.filter(F.col("node_id") == node_id).agg(F.first("vector").alias("v")).select(zero_fill(F.col("v"), dim).alias("v"))
    near = found.join(F.broadcast(used), "distance_up").join(centroids.select("node_id", "vector"), "node_id", "left").crossJoin(F.broadcast(own))  # one row
    return near.select("node_id", euclidean(zero_fill(F.col("vector"), dim), F.col("v")).alias("distance")).orderBy("distance", "node_id").limit(max_n)


#: What a target is compared with: rows of a block, and targets of one.
MEMBER_ROWS, TARGET_ROWS = 4096, 512


def _used(ways: DataFrame, counts: DataFrame, max_n: int, more_than: bool) -> DataFrame:
    """Rows of ways (target_id, node_id, distance, n) that are used: those before whose nearer ones gave fewer than max_n, or with more_than at most that many."""
    nearer = Window.partitionBy("target_id").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    before = ways.join(counts, ["target_id", "node_id"], "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(nearer), F.lit(0)))
    return before.filter(F.col("before") <= max_n if more_than else F.col("before") < max_n).select("target_id", "node_id", "distance")


def _nearest_members(members: DataFrame, asked: DataFrame, max_n: int, kind: str) -> DataFrame:
    """(target_id, member, distance): of members (node_id, member, vector) under the node_ids of asked (target_id, node_id, vectors, spare), the max_n + spare nearest of each block to one of the target's vectors, ties by member. A member without a vector is infinitely far."""

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        given = x["vector"].notna().to_numpy()
        points = np.stack(x["vector"][given].to_numpy()) if given.any() else np.empty((0, 0))
        ids, rows, distances = x["member"].to_numpy(object), [], []
        for target, vectors, spare in zip(y["target_id"].tolist(), y["vectors"], y["spare"].tolist()):
            d = np.full(len(x), np.inf)
            if len(points):
                d[given] = np.sqrt(np.min([((points - v) ** 2).sum(axis=1) for v in vectors], axis=0))
            k = min(max_n + int(spare), len(d))
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k else np.empty(0, int)
            near = near[np.lexsort((ids[near], d[near]))][:k]
            rows += [(target, member) for member in ids[near].tolist()]
            distances.append(d[near])
        found = pd.DataFrame(rows, columns=["target_id", "member"], dtype=object)
        return found.assign(distance=np.concatenate(distances) if distances else np.empty(0))

    return block_pairs(members, asked, ["node_id"], "member", "target_id", pair, f"target_id long, member {kind}, distance double", MEMBER_ROWS, TARGET_ROWS)


def _top(found: DataFrame, refused: DataFrame, max_n: int, member: str) -> DataFrame:
    """(target_id, member, distance, rank): the max_n nearest of each target, without refused (target_id, member)."""
    left = found.join(refused, ["target_id", "member"], "left_anti").groupBy("target_id", "member").agg(F.min("distance").alias("distance"))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy("distance", "member")))
    return ranked.filter(F.col("rank") <= max_n).select("target_id", F.col("member").alias(member), "distance", "rank")


def recommend_objects_many(tables: Tables, targets: DataFrame, prototypes: DataFrame, max_n: int = 1000) -> DataFrame:
    """V18 for many nodes: (target_id, object_id, distance, rank), as recommend_objects gives for each of targets (one column) with its prototypes (node_id, vector). Targets without prototypes have no rows.

    Which ancestors are used follows from counts of objects and of refused ones, without any pair of target and object. An ancestor's objects are then held against the
    prototypes of all targets that use it, block by block, and a block hands on a target's nearest only: as many as asked for, and as many more as the target refused there."""
    ways = written(ways_up(tables.nodes, targets).filter("distance > 0"), "ways")
    at = tables.assignments.select("object_id", "node_id")
    asked = targets.select(F.col(targets.columns[0]).cast("long").alias("target_id")).distinct()
    refused = tables.rejected.select(F.col("node_id").alias("target_id"), "object_id").distinct().join(asked, "target_id", "left_semi")
    refused_at = refused.join(at, "object_id").join(ways.select("target_id", "node_id"), ["target_id", "node_id"], "left_semi").groupBy("target_id", "node_id").agg(F.count(F.lit(1)).alias("spare"))
    direct = at.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    counts = ways.select("target_id", "node_id").join(direct, "node_id").join(refused_at, ["target_id", "node_id"], "left").select("target_id", "node_id", (F.col("n") - F.coalesce("spare", F.lit(0))).alias("n"), F.coalesce("spare", F.lit(0)).alias("spare"))
    counts = written(counts, "counts")
    used = _used(ways, counts, max_n, False).join(counts.select("target_id", "node_id", "spare"), ["target_id", "node_id"])
    vectors = prototypes.filter("vector is not null").groupBy(F.col("node_id").alias("target_id")).agg(F.collect_list(F.transform("vector", lambda x: x.cast("double"))).alias("vectors"))
    members = at.join(tables.objects.select("object_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")), "object_id").select("node_id", F.col("object_id").alias("member"), "vector")
    found = _nearest_members(members, used.join(vectors, "target_id").select("target_id", "node_id", "vectors", "spare"), max_n, "string")
    return _top(found, refused.withColumnRenamed("object_id", "member"), max_n, "object_id")


def recommend_children_many(tables: Tables, targets: DataFrame, centroids: DataFrame, dim: int, max_n: int = 1000) -> DataFrame:
    """V19 for many nodes: (target_id, node_id, distance, rank), as recommend_children gives for each of targets (one column): one plan for all, as recommend_objects_many."""
    all_ways = written(ways_up(tables.nodes, targets), "ways")
    ways = all_ways.filter("distance > 0")
    children_of = tables.nodes.filter("parent_id is not null").select(F.col("node_id").alias("member"), F.col("parent_id").alias("node_id"))
    n_children = children_of.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    # One child of each ancestor is on the target's own path.
    counts = ways.select("target_id", "node_id").join(n_children, "node_id").select("target_id", "node_id", (F.col("n") - 1).alias("n"))
    given = centroids.select("node_id", zero_fill(F.transform("vector", lambda x: x.cast("double")), dim).alias("vector"))
    zero = F.array_repeat(F.lit(0.0), dim)
    members = children_of.join(given.withColumnRenamed("node_id", "member"), "member", "left").select("node_id", "member", F.coalesce("vector", zero).alias("vector"))
    used = _used(ways, counts, max_n, True).join(given.withColumnRenamed("node_id", "target_id"), "target_id", "left")
    asked = used.select("target_id", "node_id", F.array(F.coalesce("vector", zero)).alias("vectors"), F.lit(1).cast("long").alias("spare"))
    found = _nearest_members(members, asked, max_n, "long")
    return _top(found, all_ways.select("target_id", F.col("node_id").alias("member")), max_n, "node_id")


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its global rank, from 0: rows are sorted into ranges, numbered in each, and moved by the counts of the ranges before. No window over all rows."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "ranks")
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    starts = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return held.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def paginate(df: DataFrame, *order: Column | str, page_size: int = 100) -> DataFrame:
    """Df with rank and page."""
    return numbered(df, *order).withColumn("page", F.floor(F.col("rank") / page_size).cast("int"))


def page_info(paged: DataFrame, page: int, page_size: int = 100) -> DataFrame:
    """One row (page, last_page, previous_page, next_page)."""
    last = F.greatest(F.ceil(F.count(F.lit(1)) / page_size) - 1, F.lit(0)).cast("int")
    one = paged.agg(last.alias("last_page"))
    return one.select(F.lit(page).alias("page"), "last_page", F.when(F.lit(page) > 0, F.lit(page - 1)).alias("previous_page"), F.when(F.lit(page) < F.col("last_page"), F.lit(page + 1)).alias("next_page"))


def by_anchor_distance(members: DataFrame, anchors: DataFrame) -> DataFrame:
    """Members (member_id, vector) with `key`: their largest distance to the anchors (vector). Few anchors are sent as one list; else blocks of both are compared."""
    known = anchors.filter("vector is not null").select("vector")
    if is_small(known):
        one = F.broadcast(known.agg(F.collect_list("vector").alias("all")))
        return members.crossJoin(one).select("member_id", F.array_max(F.transform("all", lambda a: euclidean(F.col("vector"), a))).alias("key"))  # one row
    far = _far_pairs(members.select(F.col("member_id").alias("object_id"), "vector"), known.select(F.xxhash64("vector").alias("other"), "vector"), "euclidean", "most")
    return far.groupBy(F.col("object_id").alias("member_id")).agg(F.max("d").alias("key"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbours; None without values.

    Equal values are counted first; the distinct ones are dealt into ranges, whose counts say in which range, and where in it, a rank lies. No task holds all values,
    and at most two of them a share are collected."""
    counted = df.select(F.col(column).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    dealt = written(counted.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x").withColumn("part", F.spark_partition_id()), "values")
    parts = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    starts, total = {}, 0
    for part in sorted(parts):
        starts[part], total = total, total + parts[part]
    if not total:
        return [None for _ in shares]
    places = [(total - 1) * q for q in shares]
    ranks = sorted({r for h in places for r in (math.floor(h), math.ceil(h))})
    wanted = {part for part in parts for r in ranks if starts[part] <= r < starts[part] + parts[part]}
    first = F.create_map(*(F.lit(x) for part in wanted for x in (part, starts[part])))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    rows = dealt.filter(F.col("part").isin(*wanted)).withColumn("end", within + first[F.col("part")]).filter(reduce(Column.__or__, ((F.lit(r) < F.col("end")) & (F.lit(r) >= F.col("end") - F.col("n")) for r in ranks))).collect()
    at = lambda r: next(row.x for row in rows if row.end - row.n <= r < row.end)

    def between(h: float) -> float:
        low, high, t = at(math.floor(h)), at(math.ceil(h)), h - math.floor(h)
        # From the nearer end, so that rounding is the same from both.
        return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)

    return [between(h) for h in places]


def interleave(ranked: DataFrame, n: int) -> DataFrame:
    """The first half of n ranked rows at even places, the others backwards at odd places."""
    half = (n + 1) // 2
    place = F.when(F.col("rank") < half, 2 * F.col("rank")).otherwise(2 * (n - 1 - F.col("rank")) + 1)
    return ranked.withColumn("place", place.cast("long"))


def hashed(column: Column) -> Column:
    """A fixed pseudo-random order of an integer column, the same in any engine."""
    return F.pmod(column.cast("long") * F.lit(2654435761), F.lit(4294967296))


def n_leaves(nodes: DataFrame) -> DataFrame:
    """(node_id, n_leaves): leaves in each node's subtree; a leaf has itself."""
    leaves = nodes.join(nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id")
    found = subtree_sums(nodes, leaves.select("node_id", F.lit(1).cast("long").alias("n_leaves")))
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"))


def member_keys(keys: Column) -> Column:
    """(kind, member_id) of member keys such as n12 and o-abc: 'node' or 'object' by the first letter, and the rest."""
    kind = F.when(keys.startswith("n"), "node").when(keys.startswith("o"), "object")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), F.substring(keys, 2, 2**31 - 1)).alias("member_id"))


ARRANGEMENTS = ("", "sim", "nleaves", "starred_sim", "interleaved", "random")


def node_members(
    tables: Tables, node_id: int, nodes: bool = True, objects: bool = True, arrange_by: str = "", starred_first: bool = True, descending: bool = False, centroids: DataFrame | None = None, dim: int | None = None, seed: int = 0
) -> DataFrame:
    """(rank, kind, member_id) of a node's children and direct objects.

    Without an arrangement, nodes come before objects, by id. 'sim' goes by by_similarity, 'interleaved' folds that order, 'nleaves' by the leaves below
    (objects have none), 'starred_sim' by the largest distance to the starred children, or to all children if none is starred, or as 'sim' if there
    are none; 'random' by a hash. Ties go by kind and id. `descending` turns an arrangement round. With starred_first the starred children stand
    before all, by id, and only the others are arranged. centroids (node_id, vector) and dim are needed for vectors; none counts as zero."""
    if arrange_by not in ARRANGEMENTS:
        raise ValueError(f"arrange_by is one of {ARRANGEMENTS}")
    kids = tables.nodes.filter(F.col("parent_id") == node_id).select("node_id", F.coalesce("starred", F.lit(False)).alias("starred"))
    shown = [kids.filter("not starred") if starred_first else kids] if nodes else []
    rows = [k.select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("member_id")) for k in shown]
    if objects:
        rows.append(tables.assignments.filter(F.col("node_id") == node_id).select(F.lit("object").alias("kind"), F.col("object_id").alias("member_id")))
    if not rows and not starred_first:
        raise ValueError("neither nodes nor objects are asked for")
    found = rows[0] if rows else kids.filter("false").select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("member_id"))
    for r in rows[1:]:
        found = found.unionByName(r)
    by_id = [F.col("kind"), F.when(F.col("kind") == "node", F.col("member_id").cast("long")), F.col("member_id")]
    arranged = found.withColumn("key", F.lit(0.0))
    if arrange_by in ("sim", "interleaved", "starred_sim"):
        if centroids is None or dim is None:
            raise ValueError("vectors are needed")
        at = centroids.select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("member_id"), "vector").unionByName(tables.objects.select(F.lit("object").alias("kind"), F.col("object_id").alias("member_id"), "vector"))
        held = found.join(at, ["kind", "member_id"], "left").select(F.struct("kind", "member_id").alias("m"), zero_fill(F.col("vector"), dim).alias("vector"))
        named = held.select(F.to_json("m").alias("member_id"), "m", "vector")
        anchors = kids.filter("starred") if not kids.filter("starred").isEmpty() else kids
        anchors = centroids.join(anchors.select("node_id"), "node_id", "left_semi").filter("vector is not null").select("vector")
        if arrange_by == "starred_sim" and not anchors.isEmpty():
            keyed = by_anchor_distance(named, anchors).select("member_id", (-F.col("key")).alias("key"))
        else:
            keyed = by_similarity(named.select("member_id", "vector"), seed=seed)
        arranged = named.join(keyed, "member_id").select("m.*", "key")
    elif arrange_by == "nleaves":
        leaves = n_leaves(tables.nodes).select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("member_id"), (-F.col("n_leaves")).cast("double").alias("key"))
        arranged = found.join(leaves, ["kind", "member_id"], "left").select("kind", "member_id", F.coalesce("key", F.lit(0.0)).alias("key"))
    elif arrange_by == "random":
        arranged = found.withColumn("key", F.xxhash64("kind", "member_id", F.lit(seed)).cast("double"))
    ranked = numbered(arranged, "key", *by_id)
    total = F.lit(ranked.count())
    if arrange_by == "interleaved":
        ranked = interleave(ranked, ranked.count()).drop("rank").withColumnRenamed("place", "rank")
    if descending and arrange_by:
        ranked = ranked.withColumn("rank", total - 1 - F.col("rank"))
    ranked = ranked.select(F.col("rank").cast("long").alias("rank"), "kind", "member_id")
    if starred_first:
        first = numbered(kids.filter("starred"), "node_id").select(F.col("rank").cast("long").alias("rank"), F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("member_id"))
        n_first = first.count()
        ranked = first.unionByName(ranked.withColumn("rank", F.col("rank") + n_first))
    return ranked


def project_members(tables: Tables, members: DataFrame) -> DataFrame:
    """Members (rank, kind, member_id) as a service shows them: objects by object_id, nodes by what node_view says of them."""
    from .query import node_view

    view = node_view(tables).withColumn("member_id", F.col("node_id").cast("string"))
    shown = members.filter("kind = 'node'").join(view, "member_id").drop("member_id")
    return shown.unionByName(members.filter("kind = 'object'").select("rank", "kind", F.col("member_id").alias("object_id")), allowMissingColumns=True)


def round_robin(lists: DataFrame, k: int) -> DataFrame:
    """(item): lists (list_no, items) merged one item at a time; the first k."""
    return lists.select("list_no", F.posexplode("items").alias("pos", "item")).orderBy("pos", "list_no").limit(k).select("pos", "list_no", "item")


def by_similarity(members: DataFrame, n_landmarks: int = 1000, n_neighbors: int = 5, seed: int = 0) -> DataFrame:
    """O3: members (member_id, vector) with `key`: their place on a one-dimensional Isomap of at most n_landmarks members.

    The fit is bounded by its definition. Up to five members keep the order of their ids. All other members are projected in tasks."""
    import numpy as np
    import pandas as pd

    spark = members.sparkSession
    chosen = members.orderBy(F.xxhash64("member_id", F.lit(seed)), "member_id").limit(n_landmarks).collect()
    if len(chosen) <= n_neighbors:
        return members.select("member_id", F.row_number().over(Window.orderBy("member_id")).cast("double").alias("key"))  # five rows at most
    x = np.array([r.vector for r in chosen], float)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1), 0))
    n, near = len(x), [dict() for _ in x]
    for i in range(n):
        for j in np.argsort(d[i], kind="stable")[1 : n_neighbors + 1].tolist():
            near[i][j] = near[j][i] = float(d[i, j])
    while True:  # parts that no neighbour joins are joined where they are nearest
        part, todo = np.full(n, -1), [0]
        part[0] = 0
        while todo:
            i = todo.pop()
            for j in near[i]:
                if part[j] < 0:
                    part[j] = 0
                    todo.append(j)
        if (part == 0).all():
            break
        inside, outside = np.flatnonzero(part == 0), np.flatnonzero(part < 0)
        a, b = np.unravel_index(d[np.ix_(inside, outside)].argmin(), (len(inside), len(outside)))
        near[inside[a]][int(outside[b])] = near[outside[b]][int(inside[a])] = float(d[inside[a], outside[b]])
    geo = np.full((n, n), np.inf)
    for i, row in enumerate(near):
        geo[i, i] = 0.0
        geo[i, list(row)] = list(row.values())
    for k in range(n):  # shortest ways over the first k landmarks
        np.minimum(geo, geo[:, k, None] + geo[k], out=geo)
    sq = geo**2
    b = -0.5 * (sq - sq.mean(0) - sq.mean(1)[:, None] + sq.mean())
    values, vectors = np.linalg.eigh(b)
    axis = vectors[:, -1] * (1 if vectors[np.abs(vectors[:, -1]).argmax(), -1] > 0 else -1)
    scale = np.sqrt(max(values[-1], 1e-12))
    held = spark.sparkContext.broadcast((x, geo, axis, scale, sq.mean(0), sq.mean()))  # n_landmarks squared numbers

    def run(frames):
        x, geo, axis, scale, column, whole = held.value
        for f in frames:
            if not len(f):
                continue
            y = np.array(f["vector"].tolist(), float)
            d = np.sqrt(np.maximum((y**2).sum(1)[:, None] - 2 * y @ x.T + (x**2).sum(1), 0))
            nn = np.argsort(d, axis=1, kind="stable")[:, :n_neighbors]
            g = np.stack([(d[k, nn[k], None] + geo[nn[k]]).min(0) for k in range(len(y))]) ** 2
            yield pd.DataFrame({"member_id": f["member_id"], "key": (-0.5 * (g - g.mean(1)[:, None] - column + whole)) @ axis / scale})

    return members.select("member_id", "vector").mapInPandas(run, f"member_id {members.schema['member_id'].dataType.simpleString()}, key double")
