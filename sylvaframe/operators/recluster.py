"""Re-clustering what isn't approved: selection, density clustering, and the whole pipeline."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import passing, shuffled, small, small_batches, written
from ..schema import Tables, Tree
from ..sources.io import dump_tree, load_project, merge_trees, tree_from_labels, write_tree
from .edit import create_project
from .hierarchy import clusters_of
from .query import root_id
from .rank import quantiles
from .stats import consolidate
from .vector import nearest_centroids, nearest_distance, pca

#: Points of a block of the all-pairs search.
BLOCK = 2048


def approved_objects(trees: list[Tree]) -> DataFrame:
    """(object_id) of objects directly in an approved node of any tree."""
    found = [t.objects.join(t.nodes.filter("approved").select("node_id"), "node_id", "left_semi").select("object_id") for t in trees]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def unapproved(features: DataFrame, trees: list[Tree]) -> DataFrame:
    """Features of objects that no tree has approved."""
    return features if not trees else features.join(approved_objects(trees), "object_id", "left_anti")


def availability(features: DataFrame, trees: list[Tree]) -> DataFrame:
    """One row of counts: objects in the dataset only, in both, in the trees only, approved and unapproved ones of the dataset, and the share that is approved."""
    known = trees[0].objects.select("object_id")
    for t in trees[1:]:
        known = known.unionByName(t.objects.select("object_id"))
    sides = features.select("object_id", F.lit(1).alias("d")).distinct().join(known.distinct().withColumn("t", F.lit(1)), "object_id", "full").join(approved_objects(trees).withColumn("a", F.lit(1)), "object_id", "left")
    one = lambda c: F.count(F.when(F.expr(c), 1))
    return sides.agg(one("d = 1 and t is null").alias("n_dataset_only"), one("d = 1 and t = 1").alias("n_both"), one("d is null").alias("n_tree_only"), one("d = 1 and a = 1").alias("n_approved"), one("d = 1 and a is null").alias("n_unapproved"), (one("d = 1 and a = 1") / F.greatest(one("d = 1"), F.lit(1))).alias("approved_share"))


def keep_unexplored(features: DataFrame, trees: list[Tree], candidates: DataFrame, keep_frac: float) -> DataFrame:
    """Candidates (object_id, features) that lie farthest from the centroids of approved nodes: at or beyond the (1 - keep_frac) quantile of the distance. Without trees, all of them."""
    if not trees:
        return candidates
    merged = trees[0]
    for t in trees[1:]:
        merged = merge_trees(merged, t)
    points = features.select("object_id", F.transform("features", lambda x: x.cast("double")).alias("vector"))
    train = points.join(merged.objects, "object_id").join(merged.nodes.filter("approved").select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("type_id"), "vector")
    near = nearest_distance(candidates.select("object_id", F.transform("features", lambda x: x.cast("double")).alias("vector")), nearest_centroids(train))
    near = written(near, "near")
    limit = quantiles(near, "distance", [1 - keep_frac])[0]
    kept = near.filter(F.lit(limit).isNull() | (F.col("distance") >= F.lit(limit))).select("object_id")
    return candidates.join(kept, "object_id", "left_semi")


def subsample(df: DataFrame, n: int, seed: int = 0, key: str = "object_id") -> DataFrame:
    """Exactly n rows, chosen by a hash of their key; all if there are fewer."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


#: Pivots of the metric index at most, points that a pivot has on average at least, and points that pivots are drawn from.
PIVOTS, PER_PIVOT, PIVOT_SAMPLE = 1024, 1024, 16_384
#: Points that a task holds against each of its own blocks, about; pairs whose distance is measured again at once.
OTHERS, AGAIN = 65_536, 65_536
#: Neighbours that the spanning tree's links are looked for among first; links of components that are joined on the driver, at most.
NEAR, JOINED_HERE = 16, 65_536


@dataclass(frozen=True)
class MetricIndex:
    """Points dealt to the nearest of some pivots: blocks (object_id, cell, block) of at most about BLOCK points of one cell, the pivots, and each cell's radius."""

    blocks: DataFrame
    pivots: np.ndarray
    radius: np.ndarray


def metric_index(points: DataFrame, n_pivots: int | None = None, seed: int = 0) -> MetricIndex:
    """An index of points (object_id, vector). Pivots are fitted on a sample of at most PIVOT_SAMPLE points, chosen by a hash, the next one farthest from those before; every point is indexed. It only decides which blocks need not be compared, so results stay exact."""
    sample = points.orderBy(F.xxhash64("object_id", F.lit(seed)), "object_id").limit(PIVOT_SAMPLE)
    n, rows = points.count(), [r.vector for r in sample.select("vector").collect()]
    if not rows:
        return MetricIndex(points.select("object_id", F.lit(0).alias("cell"), F.lit(0).alias("block")), np.empty((0, 0)), np.empty(0))
    x = np.array(rows, float)
    k = min(n_pivots or max(1, min(PIVOTS, n // PER_PIVOT, int(4 * n**0.5))), len(x))
    chosen, gap = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    pivots = x[chosen]
    sent = points.sparkSession.sparkContext.broadcast(pivots)

    def deal(frames):
        for f in frames:
            if len(f):
                d = _distances(np.stack(f["vector"].to_numpy()), sent.value)
                yield pd.DataFrame({"object_id": _names(f["object_id"].tolist()), "cell": d.argmin(1), "d": d.min(1)})

    dealt = written(points.select("object_id", "vector").mapInPandas(deal, "object_id string, cell int, d double"), "dealt")
    facts = {r.cell: (r.n, r.d) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()}  # one row a pivot
    parts = [-(-facts.get(c, (0, 0.0))[0] // BLOCK) for c in range(len(pivots))]
    first, many = (F.array(*(F.lit(v) for v in x)) for x in (np.cumsum([0, *parts[:-1]]).tolist(), [max(1, p) for p in parts]))
    block = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("object_id"), F.get(many, F.col("cell")))
    return MetricIndex(dealt.select("object_id", "cell", block.cast("int").alias("block")), pivots, np.array([facts.get(c, (0, -1.0))[1] for c in range(len(pivots))]))


def _names(ids: list) -> pd.Series:
    return pd.Series(ids, dtype=object)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))


def _packed(index: MetricIndex, rows: DataFrame) -> DataFrame:
    """(block, cell, object_id, vector, ...): rows (object_id, vector, ...) by block, in the order of ids: a list a column, the vectors one after the other; one row of about BLOCK points each."""
    kept = [c for c in rows.columns if c != "object_id"]
    context = rows.sparkSession.sparkContext
    # Dealt to as many tasks as can run, which Spark would join by their bytes.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * context.defaultParallelism)
    held = index.blocks.join(shuffled(rows), "object_id").repartition(tasks, "block").groupBy("block", "cell").agg(F.sort_array(F.collect_list(F.struct("object_id", *kept))).alias("rows"))
    return held.select("block", "cell", *((F.flatten(F.col(f"rows.{c}")) if c == "vector" else F.col(f"rows.{c}")).alias(c) for c in ["object_id", *kept]))


def _points(frame: pd.DataFrame, end: str = "") -> Iterator[dict[str, np.ndarray]]:
    """The blocks of a frame, as arrays by the names of their columns, which end in `end`."""
    names = [c for c in ("object_id", "vector", "core", "root", "within") if c + end in frame]
    for values in zip(*(frame[c + end] for c in names)):
        held = dict(zip(names, values))
        yield held | {"vector": np.asarray(held["vector"], float).reshape(len(held["object_id"]), -1)}


def _needed_pairs(index: MetricIndex, packed: DataFrame, within: str, report: dict | None, every: DataFrame | None = None) -> DataFrame:
    """Pairs of different blocks that can hold points as near as a point's `within`, the second one's columns with a 2 at their end: by the triangle inequality, no point of a cell is nearer than the pivot's distance less the cell's radius.

    The second ones are blocks of `every`, if that is given, and then also the same. Tasks read both blocks where they lie and hand on pair after pair, all of
    one block's after each other: no pair is shuffled or written, as each block meets many others."""
    sent = packed.sparkSession.sparkContext.broadcast((index.pivots, index.radius))

    def need(frames):
        pivots, radius = sent.value
        for f in frames:
            for block, rows in zip(f["block"].tolist(), _points(f)):
                gap = _distances(rows["vector"], pivots) - rows[within][:, None]
                # A little room for rounding.
                yield pd.DataFrame({"block": [block], "cells": [np.flatnonzero(gap.min(0) <= radius + 1e-6 * (1.0 + radius))]})

    # A row a block, and at most PIVOTS cells in it.
    wanted = written(packed.select("block", "vector", "object_id", within).mapInPandas(need, "block int, cells array<int>"), "wanted")
    if report is not None:
        n, cells = packed.count(), wanted.select("block", F.explode("cells").alias("cell"))
        report |= {"compared": cells.join(packed.select("cell", F.col("block").alias("other")), "cell").filter("block <> other").count(), "all": n * (n - 1)}
    own = packed.join(small(wanted), "block").drop("cell")
    n = -(-index.blocks.count() // OTHERS)
    others = (packed if every is None else every).select(*(F.col(c).alias(f"{c}2") for c in (packed if every is None else every).columns)).coalesce(max(1, n))
    meets = F.array_contains("cells", F.col("cell2"))
    return own.hint("shuffle_replicate_nl").join(others, meets if every is not None else meets & (F.col("block") != F.col("block2"))).drop("cells", "cell2", "block2")


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """(squares of the distances, what they can be wrong by)."""
    p, q = (a**2).sum(1), (b**2).sum(1)
    d = a @ b.T
    d *= -2
    d += p[:, None]
    d += q
    return d, 1e-12 * (p.max(initial=0.0) + q.max(initial=0.0)) + 1e-300


def _exactly(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of a's rows i and b's rows j, the same from both sides."""
    found = [np.sqrt(((a[i[k : k + AGAIN]] - b[j[k : k + AGAIN]]) ** 2).sum(1)) for k in range(0, len(i), AGAIN)]
    return np.concatenate(found) if found else np.empty(0)


def _first_of_each(k: int, i: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Where the first k of each i are, by the order and by i."""
    at = np.lexsort((*order[::-1], i))
    own = i[at]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(at) else at
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    return at[place < k]


def _by_own_block(frames, start, meet, end):
    """What end gives of each own block of pairs, after start and meet(state, rows, others) of all others that it meets here."""
    held = None
    for f in frames:
        for block, rows, others in zip(f["block"].tolist(), _points(f), _points(f, "2")):
            if held is None or held[0] != block:
                if held is not None:
                    yield end(held[1])
                held = (block, start(rows))
            meet(held[1], others)
    if held is not None:
        yield end(held[1])


def _nearest_in(rows: dict, others: dict, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows' numbers, others' numbers, distances) of the k nearest others of each row, by rows, distances and names; with `same` a point isn't its own."""
    d, room = _squares(rows["vector"], others["vector"])
    if same:
        np.fill_diagonal(d, np.inf)
    most = min(k, d.shape[1] - same)
    if most < 1:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    limit = rows["within"] ** 2 * (1 + 1e-9) if "within" in rows else np.full(len(d), np.inf)
    if np.isinf(limit).any():
        limit = np.minimum(limit, np.partition(d, most - 1, axis=1)[:, most - 1])
    # A product's distance has errors; what is as near as them is measured again.
    i, j = np.nonzero(d <= (limit + room)[:, None])
    d = _exactly(rows["vector"], others["vector"], i, j)
    at = _first_of_each(k, i, d, j)  # a block's points lie in the order of their names
    return i[at], j[at], d[at]


def neighbours(points: DataFrame, k: int, index: MetricIndex | None = None, report: dict | None = None) -> DataFrame:
    """(object_id, other_id, d, rank): the k nearest others of each point (object_id, vector), exactly.

    A point's own block gives k others, so none farther than the last of them can be among its nearest; only the blocks of cells that can be as near are
    held against it. report gets the numbers of pairs of blocks that were compared and that there are."""
    spark = points.sparkSession
    with passing(spark), small_batches(spark):
        index = index or metric_index(points)
        packed = written(_packed(index, points.select("object_id", "vector")), "blocks")

        def inside(frames):
            for f in frames:
                for rows in _points(f):
                    i, j, d = _nearest_in(rows, rows, k, True)
                    first = np.searchsorted(i, np.arange(len(rows["object_id"])))
                    n = np.minimum(np.diff([*first, len(i)]), k)
                    found = [(rows["object_id"][j[a : a + m]], d[a : a + m]) for a, m in zip(first.tolist(), n.tolist())]
                    yield pd.DataFrame({"object_id": _names(list(rows["object_id"])), "others": [x for x, _ in found], "d": [x for _, x in found], "within": [x[-1] if len(x) == k else np.inf for _, x in found]})

        own = written(packed.mapInPandas(inside, "object_id string, others array<string>, d array<double>, within double"), "own")
        bounded = written(_packed(index, points.select("object_id", "vector").join(shuffled(own.select("object_id", "within")), "object_id")), "bounded")

        def start(rows):
            return rows | {"within": np.array(rows["within"], float), "i": np.empty(0, int), "name": np.empty(0, str), "d": np.empty(0)}

        def meet(rows, others):
            i, j, d = _nearest_in(rows, others, k, False)
            if len(i):
                i, name, d = np.concatenate((rows["i"], i)), np.concatenate((rows["name"], others["object_id"][j].astype(str))), np.concatenate((rows["d"], d))
                at = _first_of_each(k, i, d, name)
                rows |= {"i": i[at], "name": name[at], "d": d[at]}
                full = np.flatnonzero(np.bincount(rows["i"], minlength=len(rows["within"])) == k)
                farthest = np.zeros(len(rows["within"]))
                np.maximum.at(farthest, rows["i"], rows["d"])
                rows["within"][full] = np.minimum(rows["within"][full], farthest[full])

        def end(rows):
            return pd.DataFrame({"object_id": _names(rows["object_id"][rows["i"]].tolist()), "other_id": _names(rows["name"].tolist()), "d": rows["d"]})

        def between(frames):
            return _by_own_block(frames, start, meet, end)

        pairs = _needed_pairs(index, bounded, "within", report).mapInPandas(between, "object_id string, other_id string, d double")
        flat = own.select("object_id", F.explode(F.arrays_zip("others", "d")).alias("e")).select("object_id", F.col("e.others").alias("other_id"), "e.d")
        ranked = flat.unionByName(pairs).withColumn("rank", F.row_number().over(Window.partitionBy("object_id").orderBy("d", "other_id")))
        return written(ranked.filter(F.col("rank") <= k), "neighbours", stays=True)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): a minimum spanning forest of edges (a, b, w), by Boruvka rounds: each component takes its least edge out, and components merge. O(log n) rounds, each written."""
    left = written(edges.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "w"), "edges")
    forest = None
    own = None
    while True:
        if own is not None:
            ra, rb = own.select(F.col("node").alias("a"), F.col("root").alias("ca")), own.select(F.col("node").alias("b"), F.col("root").alias("cb"))
            named = left.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", "x", "y", "w", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        else:
            named = left.select("*", F.col("a").alias("ca"), F.col("b").alias("cb"))
        open_ = named.filter("ca <> cb")
        order = F.struct("w", "x", "y")
        ends = open_.select(F.col("ca").alias("c"), order.alias("e")).unionByName(open_.select(F.col("cb").alias("c"), order.alias("e")))
        chosen = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
        if chosen.isEmpty():
            return forest if forest is not None else chosen.select(F.col("x").alias("a"), F.col("y").alias("b"), "w")
        found = chosen.select(F.col("x").alias("a"), F.col("y").alias("b"), "w")
        forest = written(found if forest is None else forest.unionByName(found), "forest")
        own = components(forest)


def _least_link_of_each(rows: dict, others: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows' numbers, w, x, y): the least link of each row to a point of others in another component that is at most as long as its `within`, by mutual reachability: the largest of the distance and both cores; of equal ones the first by the names of both ends, the smaller one first."""
    a, b = rows["vector"], others["vector"]
    w, room = _squares(a, b)
    np.maximum(w, rows["core"][:, None] ** 2, out=w)
    np.maximum(w, others["core"] ** 2, out=w)
    _, kinds = np.unique(np.concatenate((rows["root"], others["root"])).astype(str), return_inverse=True)
    w[kinds[: len(a), None] == kinds[len(a) :]] = np.inf
    least = w.min(1)
    own = np.flatnonzero((least <= rows["within"] ** 2 * (1 + 1e-9) + room) & np.isfinite(least))
    i, j = np.nonzero(w[own] <= (least[own] + 2 * room)[:, None])
    i = own[i]
    w = np.maximum(_exactly(a, b, i, j), np.maximum(rows["core"][i], others["core"][j]))
    names, more = rows["object_id"][i].astype(str), others["object_id"][j].astype(str)
    lower = names < more
    x, y = np.where(lower, names, more), np.where(lower, more, names)
    at = _first_of_each(1, i, w, x, y)
    return i[at], w[at], x[at], y[at]


def links_out(asked: DataFrame, points: DataFrame, index: MetricIndex, report: dict | None = None) -> DataFrame:
    """(object_id, w, x, y): for each of asked (object_id, vector, core, root, within) its least link, as long as `within` at most, to one of points (object_id, vector, core, root) with another root. Only blocks of cells that can hold one are compared."""
    spark = points.sparkSession
    with passing(spark), small_batches(spark):
        own, every = (written(_packed(index, df), "blocks") for df in (asked, points))

        def start(rows):
            n = len(rows["object_id"])
            return rows | {"within": np.array(rows["within"], float), "w": np.full(n, np.inf), "x": np.full(n, None, object), "y": np.full(n, None, object)}

        def meet(rows, others):
            i, w, x, y = _least_link_of_each(rows, others)
            better = w < rows["w"][i]
            for k in np.flatnonzero(w == rows["w"][i]).tolist():
                better[k] = (x[k], y[k]) < (rows["x"][i[k]], rows["y"][i[k]])
            i = i[better]
            rows["w"][i], rows["x"][i], rows["y"][i] = w[better], x[better], y[better]
            rows["within"] = np.minimum(rows["within"], rows["w"])

        def end(rows):
            at = np.flatnonzero(np.isfinite(rows["w"]))
            return pd.DataFrame({"object_id": _names(rows["object_id"][at].tolist()), "w": rows["w"][at], "x": _names([str(v) for v in rows["x"][at]]), "y": _names([str(v) for v in rows["y"][at]])})

        found = _needed_pairs(index, own, "within", report, every).mapInPandas(lambda frames: _by_own_block(frames, start, meet, end), "object_id string, w double, x string, y string")
        return written(found.groupBy("object_id").agg(F.min(F.struct("w", "x", "y")).alias("e")).select("object_id", "e.*"), "links-out", stays=True)


def _joined(links: DataFrame) -> DataFrame:
    """components() of links (a, b), on the driver if they are few."""
    if links.count() > JOINED_HERE:
        return components(links)
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links.collect():  # JOINED_HERE at most
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return links.sparkSession.createDataFrame([(x, top(x)) for x in list(up)], "node string, root string")


def density_forest(points: DataFrame, min_samples: int = 1, report: dict | None = None) -> DataFrame:
    """(a, b, w): the spanning tree of mutual reachability of points (object_id, vector), by Boruvka rounds.

    Links are looked for among each point's NEAR nearest first: all others of a point are at least as long as the farthest of these, its bound. A component whose
    least known link is at most as long as the bounds of all its points has its least one, and is joined by it. Only when no component has, all but the
    largest look for a shorter link than the least they know, from those of their points whose bounds allow one; what each finds, or doesn't, is its new bound.
    All choose by one order of the known links, so they make no cycle. report gets the number of such searches."""
    spark = points.sparkSession
    index = metric_index(points)
    k = max(min_samples, NEAR)
    searches = 0
    with passing(spark):
        near = neighbours(points, k, index)
        core = near.filter(F.col("rank") == min_samples).select("object_id", F.col("d").alias("core"))
        far = near.groupBy("object_id").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n"))
        held = points.join(shuffled(core), "object_id", "left").join(shuffled(far), "object_id", "left")
        bound = F.when(F.coalesce("n", F.lit(0)) < k, F.lit(float("inf"))).otherwise(F.greatest("far", "core"))
        held = written(held.select("object_id", "vector", F.coalesce("core", F.lit(0.0)).alias("core"), bound.alias("bound")), "cores")
        roots = held.select("object_id", F.col("object_id").alias("root"), "bound")
        cores = lambda c: held.select(F.col("object_id").alias(c), F.col("core").alias(f"core_{c}"))
        linked = near.select(F.least("object_id", "other_id").alias("x"), F.greatest("object_id", "other_id").alias("y"), "d").dropDuplicates(["x", "y"])
        linked = linked.join(shuffled(cores("x")), "x").join(shuffled(cores("y")), "y").select("x", "y", F.greatest("d", "core_x", "core_y").alias("w"))
        links = written(linked.select("x", "y", "w", F.col("x").alias("cx"), F.col("y").alias("cy")), "links")
        forest: list[DataFrame] = []
        while True:
            lows = roots.groupBy("root").agg(F.min("bound").alias("low"), F.count(F.lit(1)).alias("n"))
            e = F.struct("w", "x", "y")
            ends = links.select(F.col("cx").alias("root"), e.alias("e"), F.col("cy").alias("to")).unionByName(links.select(F.col("cy").alias("root"), e.alias("e"), F.col("cx").alias("to")))
            least = ends.groupBy("root").agg(F.min(F.struct("e", "to")).alias("f")).select("root", "f.e.*", "f.to")
            known = written(lows.join(shuffled(least), "root", "left"), "known")
            if known.count() < 2:
                break
            # The bound is exact up to rounding.
            chosen = known.filter("w <= low")
            if chosen.isEmpty():
                largest = known.orderBy(F.desc("n"), "root").first().root
                limits = known.filter(F.col("root") != largest).select("root", F.coalesce("w", F.lit(float("inf"))).alias("within"))
                open_ = roots.join(shuffled(limits), "root").filter("bound < within")
                every = written(held.select("object_id", "vector", "core").join(shuffled(roots.select("object_id", "root")), "object_id"), "rooted")
                asked = written(every.join(shuffled(open_.select("object_id", "within")), "object_id"), "asked")
                found = links_out(asked, every, index)
                searches += 1
                if found.isEmpty() and known.filter("w is null").count() > 1:
                    break
                raised = asked.select("object_id", "within").join(shuffled(found.select("object_id", "w")), "object_id", "left").select("object_id", F.least("within", "w").alias("new"))
                roots = written(roots.join(shuffled(raised), "object_id", "left").select("object_id", "root", F.greatest("bound", "new").alias("bound")), "roots")
                own = lambda c, name: roots.select(F.col("object_id").alias(c), F.col("root").alias(name))
                more = found.select("x", "y", "w").distinct().join(shuffled(own("x", "cx")), "x").join(shuffled(own("y", "cy")), "y")
                links = written(links.unionByName(more.select(links.columns)).dropDuplicates(["x", "y"]), "links")
                continue
            forest.append(written(chosen.select(F.col("x").alias("a"), F.col("y").alias("b"), "w").distinct(), "forest", stays=True))
            joined = _joined(chosen.select(F.col("root").alias("a"), F.col("to").alias("b")))
            joined = small(joined.select(F.col("node").alias("old"), F.col("root").alias("new")))
            moved = lambda df, c: df.join(joined.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: E731, B023
            links = written(moved(moved(links, "cx"), "cy").filter("cx <> cy").select(links.columns), "links")
            roots = written(moved(roots, "root").select("object_id", "root", "bound"), "roots")
    if report is not None:
        report["searches"] = searches
    if not forest:
        return spark.createDataFrame([], "a string, b string, w double")
    return reduce(DataFrame.unionByName, forest)


def density_cluster(features: DataFrame, min_cluster_size: int, min_samples: int = 1, method: str = "leaf") -> DataFrame:
    """(object_id, label) of rows (object_id, features): clusters of the density hierarchy of all points, -1 for noise and for rows without features.

    'leaf' takes the clusters in which no smaller ones begin, 'eom' those of most stability."""
    points = features.select("object_id", F.transform("features", lambda x: x.cast("double")).alias("vector")).filter("vector is not null")
    named = clusters_of(points, density_forest(points, min_samples), min_cluster_size, method)
    return features.select("object_id").join(named, "object_id", "left").select("object_id", F.coalesce("label", F.lit(-1)).alias("label"))


def init_tree(features: DataFrame) -> Tree:
    """All objects under one root that isn't approved."""
    tree = tree_from_labels(features.select("object_id", F.lit(-1).alias("label")))
    return Tree(tree.nodes.withColumn("approved", F.lit(False)), tree.objects, None, tree.meta)


def with_approved(tree: Tree) -> Tree:
    """A tree whose nodes have the column approved, false where it is missing."""
    approved = F.coalesce("approved", F.lit(False)) if "approved" in tree.nodes.columns else F.lit(False)
    return Tree(tree.nodes.withColumn("approved", approved), tree.objects, tree.rejected, tree.meta)


def merge_all(features: DataFrame | None, trees: list[Tree]) -> Tree:
    """All trees merged, from left to right, after the tree of all features."""
    held = ([init_tree(features)] if features is not None else []) + [with_approved(t) for t in trees]
    out = held[0]
    for t in held[1:]:
        out = merge_trees(out, t)
    return out


def cluster(features: DataFrame, trees: list[Tree], ignore_approved: bool = True, sample_size: int | None = None, n_pca: int | None = None, keep_frac: float | None = None, seed: int = 0, **density) -> Tree:
    """A tree of the clusters of what isn't approved: selection, sample, projection, density clusters; noise is the root's."""
    rows = unapproved(features, trees) if ignore_approved else features
    if keep_frac is not None:
        rows = keep_unexplored(features, trees, rows, keep_frac)
    if sample_size is not None:
        rows = subsample(rows, sample_size, seed)
    rows = written(rows, "rows")
    if n_pca:
        rows = pca(rows, n_pca, "features", "features")[0].select("object_id", "features")
    labels = density_cluster(rows, **density)
    offset = max([t.nodes.agg(F.max("node_id")).first()[0] + 1 for t in trees], default=0)
    shifted = labels.select("object_id", F.when(F.col("label") == -1, F.lit(-1)).otherwise(F.col("label") + offset).alias("label"))
    tree = tree_from_labels(shifted)
    return Tree(tree.nodes.withColumn("approved", F.lit(False)), tree.objects, None, {"density": {k: str(v) for k, v in density.items()}})


def save_merged(trees: list[Tree], path: str, log: list[dict] | None = None) -> Tree:
    """All trees merged and saved with the log of the run; the merged tree."""
    if not trees:
        raise ValueError("no trees")
    tree = merge_all(None, trees)
    write_tree(tree, path, {"log": log or []})
    return tree


def save_all(trees: list[Tree], prefix: str) -> list[str]:
    """Each tree saved on its own, as prefix-0, prefix-1, ...; the paths."""
    paths = [f"{prefix}-{k}" for k in range(len(trees))]
    for tree, path in zip(trees, paths):
        write_tree(tree, path)
    return paths


def recluster_tree(tables: Tables, project_id: int, features: DataFrame, min_cluster_size: int, sample_size: int | None = 1000, **density) -> Tree:
    """A project's tree merged with the clusters of what isn't approved in it."""
    tree = with_approved(dump_tree(tables, root_id(tables.nodes, project_id)))
    return merge_all(None, [tree, cluster(features, [tree], sample_size=sample_size, min_cluster_size=min_cluster_size, **density)])


def recluster_project(tables: Tables, project_id: int, features: DataFrame, min_cluster_size: int, sample_size: int | None = 1000, **density) -> tuple[Tables, int]:
    """recluster_tree as a new project named <name>-<min_cluster_size>, with its nodes' statistics; the tables and the project's id."""
    name = tables.projects.filter(F.col("project_id") == project_id).select("name").first()
    if name is None:
        raise LookupError(f"project {project_id} is unknown")
    tree = recluster_tree(tables, project_id, features, min_cluster_size, sample_size, **density)
    held = create_project(tables, f"{name[0]}-{min_cluster_size}")
    new = held.projects.agg(F.max("project_id")).first()[0]
    # The new nodes, in tables of their own so that only they are refreshed.
    fresh = load_project(held, tree, new)
    own = fresh.nodes.filter(F.col("project_id") == new)
    assigned = written(fresh.assignments.join(own.select("node_id"), "node_id", "left_semi"), "assigned")
    refreshed = consolidate(Tables(written(own, "nodes"), assigned, tables.objects), root_id(own, new))
    return held.with_(nodes=tables.nodes.unionByName(refreshed, allowMissingColumns=True), assignments=tables.assignments.unionByName(assigned, allowMissingColumns=True)), new
