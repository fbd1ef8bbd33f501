"""Prototypes, classification and distances."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, euclidean, mean_vectors
from ..plans.blocks import block_pairs
from ..plans.shared import is_small, new_path, shuffled, small, written

PROTOTYPES = "array<struct<vector: array<double>, support: double>>"


def _in_numpy(metric: str, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The distance of each row of x to v."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - x @ v / (np.sqrt((x * x).sum(1)) * np.sqrt(v @ v))
    gap = x - v
    return np.abs(gap).sum(1) if metric == "cityblock" else (gap * gap).sum(1) if metric == "sqeuclidean" else np.sqrt((gap * gap).sum(1))


def _doubles(vector: str = "vector"):
    return F.transform(vector, lambda x: x.cast("double"))


#: Rows that a list has at most that each point goes through by itself; more are compared block by block.
LIST_ROWS = 256
#: Rows of a block where only the least or the most of it is kept, and rows of it whose products are made at once.
NEAR_ROWS, PRODUCT_ROWS = 8192, 256
#: Distances that are measured again at once, of those that are as near as a product's errors.
AGAIN = 65_536


def _in_one_row(others: DataFrame, *columns: str, rows: int | None = None) -> DataFrame | None:
    """A broadcast row with the list `all` of others' rows, if these are few enough: at most `rows`, or what may be broadcast."""
    if not is_small(others.select(*columns), rows):
        return None
    return F.broadcast(others.agg(F.collect_list(F.struct(*columns)).alias("all")))


def _ends(a: np.ndarray, b: np.ndarray, metric: str, least: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the row of b that is nearest to each row of a, or the farthest, the first of equal ones; its distance)."""
    if metric not in ("euclidean", "sqeuclidean") or not (np.isfinite(a).all() and np.isfinite(b).all()):
        d = np.stack([_in_numpy(metric, a, v) for v in b], 1)
        at = d.argmin(1) if least else d.argmax(1)
        return at, d[np.arange(len(a)), at]
    first: dict[bytes, int] = {}
    for j, v in enumerate(b):
        first.setdefault(v.tobytes(), j)
    kinds = np.array(list(first.values()))
    b = b[kinds]
    size, at, best = (b * b).sum(1), np.empty(len(a), np.int64), np.empty(len(a))
    for lo in range(0, len(a), PRODUCT_ROWS):
        x = a[lo : lo + PRODUCT_ROWS]
        gap = size - 2 * (x @ b.T)
        gap = gap if least else -gap
        # A product's distance has errors; what is as near as them is measured again.
        room = 1e-12 * ((x * x).sum(1) + size.max()) + 1e-300
        i, j = np.nonzero(gap <= (gap.min(1) + room)[:, None])
        d = np.concatenate([_in_numpy("sqeuclidean", x[i[k : k + AGAIN]], b[j[k : k + AGAIN]]) for k in range(0, len(i), AGAIN)])
        order = np.lexsort((kinds[j], d if least else -d, i))
        _, begin = np.unique(i[order], return_index=True)
        at[lo : lo + len(x)], best[lo : lo + len(x)] = kinds[j[order[begin]]], d[order[begin]]
    return at, best if metric == "sqeuclidean" else np.sqrt(best)


def _far_pairs(points: DataFrame, others: DataFrame, metric: str, keep: str) -> DataFrame:
    """(object_id, other, d): distances of points (object_id, vector) and others (other, vector), block by block: 'least' and 'most' keep each point's nearest or farthest of a block, the smaller `other` of equal ones; 'all' keeps all. Null vectors have none."""
    kinds = {c: (points if c == "object_id" else others).schema[c].dataType.simpleString() for c in ("object_id", "other")}
    rows = lambda df, c: df.filter("vector is not null").select(F.lit(0).alias("key"), c, _doubles().alias("vector"))

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, ids, others_ = np.stack(x["vector"].to_numpy()), x["object_id"].tolist(), y.sort_values("other")
        names = others_["other"].tolist()
        if keep == "all":
            d = np.stack([_in_numpy(metric, a, v) for v in others_["vector"]], 1)
            at = (np.repeat(np.arange(len(ids)), len(names)), np.tile(np.arange(len(names)), len(ids)))
            d = d[at]
        else:
            found, d = _ends(a, np.stack(others_["vector"].to_numpy()), metric, keep == "least")
            at = (np.arange(len(ids)), found)
        return pd.DataFrame({"object_id": pd.Series([ids[k] for k in at[0].tolist()], dtype=object), "other": pd.Series([names[k] for k in at[1].tolist()], dtype=object), "d": d})

    # All pairs of a block become rows; of larger blocks only one row a point is kept.
    sizes = {} if keep == "all" else {"left_rows": NEAR_ROWS, "right_rows": NEAR_ROWS}
    return block_pairs(rows(points, "object_id"), rows(others, "other"), ["key"], "object_id", "other", pair, f"object_id {kinds['object_id']}, other {kinds['other']}, d double", **sizes)


def prototype_distance(points: DataFrame, prototypes: DataFrame, metric: str = "euclidean") -> DataFrame:
    """V2: points (object_id, vector) with `distance`: the least to prototypes (vector); infinite without any, and for a null vector.

    Few prototypes are sent as one list, and each row finds its least by itself; beyond the broadcast limit blocks of both are compared."""
    known = prototypes.filter("vector is not null")
    if one := _in_one_row(known, "vector", rows=LIST_ROWS):
        near = F.array_min(F.transform("all", lambda p: METRICS[metric](F.col("vector"), p["vector"])))
        return points.crossJoin(one).select("object_id", F.coalesce(near, F.lit(float("inf"))).alias("distance"))  # one row
    found = _far_pairs(points, known.select(F.xxhash64("vector").alias("other"), "vector"), metric, "least").groupBy("object_id").agg(F.min("d").alias("distance"))
    return points.select("object_id").join(shuffled(found), "object_id", "left").select("object_id", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def _k_means(x: np.ndarray, k: int, seed: int, n_init: int = 2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from k-means++ starts; the best of n_init."""
    best, least = None, np.inf
    for run in range(n_init):
        rng = np.random.default_rng(seed + run)
        centres = [x[rng.integers(len(x))]]
        gap = ((x - centres[0]) ** 2).sum(1)
        while len(centres) < k:
            total = gap.sum()
            centres.append(x[rng.choice(len(x), p=gap / total)] if total > 0 else x[rng.integers(len(x))])
            gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
        c = np.array(centres)
        for _ in range(rounds):
            d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
            own = d.argmin(1)
            n = np.bincount(own, minlength=k)
            new = np.where(n[:, None] > 0, np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None], c)
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[own]) ** 2).sum()
        if cost < least:
            best, least = (c[n > 0], n[n > 0].astype(float)), cost
    return best


def check_clusterer(clusterer) -> None:
    """TypeError for what lacks fit_predict or n_clusters."""
    if not all(hasattr(clusterer, name) for name in ("fit_predict", "n_clusters")):
        raise TypeError(f"{clusterer!r} has no fit_predict or no n_clusters")


def fit_prototypes_of(x: np.ndarray, k: int, seed: int = 0, n_init: int = 2, clusterer=None) -> tuple[np.ndarray, np.ndarray]:
    """V3: (vectors, support) of a group: the mean for k = 1, the points if there are k or fewer, else k-means; or the means of the clusters that a clusterer's fit_predict finds, where it has more points than n_clusters."""
    if not len(x):
        raise ValueError("prototypes need a point")
    if clusterer is not None:
        k = clusterer.n_clusters
        if 1 < k < len(x):
            labels, own = np.unique(np.asarray(clusterer.fit_predict(x)), return_inverse=True)
            return np.array([x[own == j].mean(0) for j in range(len(labels))]), np.bincount(own).astype(float)
    if k == 1:
        return x.mean(0, keepdims=True), np.array([float(len(x))])
    return (x, np.ones(len(x))) if len(x) <= k else _k_means(x, k, seed, n_init)


def _as_rows(vectors: np.ndarray, support: np.ndarray) -> list[dict]:
    return [{"vector": v.tolist(), "support": float(s)} for v, s in zip(vectors, support)]


#: Points of a group that one task fits; larger groups are fitted by rounds over blocks of so many points.
MOST_IN_TASK, FIT_BLOCK = 20_000, 4096
#: Rounds that gather candidates for centres, each of about twice k points, and Lloyd rounds at most.
SEED_ROUNDS, LLOYD_ROUNDS = 5, 50
#: Numbers of all centres up to which Lloyd rounds hold the centres on the driver; beyond that they are tables.
ON_DRIVER = 1 << 20


def _by_blocks(points: DataFrame, centres: DataFrame, group: str, kind: str, run) -> DataFrame:
    """Rows (group, run, at, pos, x): what run(points of a block, centres of its group and run) gives as a matrix, row by row. points: (group, block, h, vectors), the vectors one after the other; centres: (group, run, centres)."""

    def each(frames):
        for f in frames:
            for key, init, h, x, found in zip(f[group].tolist(), f["run"].tolist(), f["h"], f["vectors"], f["centres"]):
                got = run(x.reshape(len(h), -1), np.stack([np.array(c) for c in found]), h, init)
                yield pd.DataFrame({group: pd.Series([key] * got.size, dtype=object), "run": init, "at": np.repeat(np.arange(len(got)), got.shape[1]), "pos": np.tile(np.arange(got.shape[1]), len(got)), "x": got.ravel()})

    joined = points.join(small(centres), group).select(group, "run", "h", "vectors", "centres")
    return joined.mapInPandas(each, f"{group} {kind}, run int, at int, pos int, x double")


def _added_up(points: DataFrame, centres: dict[tuple, np.ndarray], group: str, kind: str, run) -> dict[tuple, np.ndarray]:
    """By (group, run), as centres: the sum of what run gives for all blocks of points, see _by_blocks. Tasks add up theirs first, so only numbers of the centres come to the driver."""
    sent = points.sparkSession.sparkContext.broadcast(centres)
    runs: dict = {}
    for key, init in centres:
        runs.setdefault(key, []).append(init)

    def each(frames):
        total: dict[tuple, np.ndarray] = {}
        for f in frames:
            for key, h, x in zip(f[group].tolist(), f["h"], f["vectors"]):
                for init in runs[key]:
                    got = run(x.reshape(len(h), -1), sent.value[key, init], h, init)
                    total[key, init] = total[key, init] + got if (key, init) in total else got
        for (key, init), got in total.items():
            yield pd.DataFrame({group: pd.Series([key] * got.size, dtype=object), "run": init, "at": np.repeat(np.arange(len(got)), got.shape[1]), "pos": np.tile(np.arange(got.shape[1]), len(got)), "x": got.ravel()})

    rows = points.select(group, "h", "vectors").mapInPandas(each, f"{group} {kind}, run int, at int, pos int, x double").groupBy(group, "run", "at", "pos").agg(F.sum("x").alias("x")).collect()  # ON_DRIVER, and two more for each centre
    sent.unpersist()
    found = {at: np.zeros((len(c), c.shape[1] + 2)) for at, c in centres.items()}
    for key, init, at, pos, x in rows:
        found[key, init][at, pos] = x
    return found


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def _fit_large(points: DataFrame, group: str, kind: str, k: int, seed: int, n_init: int) -> DataFrame:
    """(group, prototypes) of large groups of points (group, object_id, vector), all groups and starts at once: k-means|| candidates, weighted and cut to k, then Lloyd rounds of sums per group and centre. A group is never in one task."""
    sized = points.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / FIT_BLOCK).cast("int").alias("blocks"))
    row = F.struct(F.xxhash64("object_id", F.lit(seed)).alias("h"), _doubles().alias("vector"))
    dealt = points.join(small(sized), group).withColumn("block", F.pmod(F.xxhash64("object_id"), F.col("blocks"))).groupBy(group, "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # Lists of numbers, not of rows: every round sends them to Python.
    held = written(dealt.select(group, "block", F.col("rows.h").alias("h"), F.flatten("rows.vector").alias("vectors")), "fit-blocks")
    runs = F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))).alias("run")
    first = held.select(group, runs, F.col("h")[0].alias("h"), F.slice("vectors", F.lit(1), (F.size("vectors") / F.size("h")).cast("int")).alias("v")).groupBy(group, "run").agg(F.min_by("v", F.xxhash64("h", "run")).alias("v"))
    centres = written(first.select(group, "run", F.array("v").alias("centres")), "centres")
    as_lists = lambda rows: rows.groupBy(group, "run", "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))  # noqa: E731  # one entry a dimension

    for turn in range(SEED_ROUNDS):
        cost = _by_blocks(held, centres, group, kind, lambda x, c, h, init: _gaps(x, c).min(1).sum().reshape(1, 1)).groupBy(group, "run").agg(F.sum("x").alias("cost"))
        priced = written(centres.join(cost, [group, "run"]), "priced")

        def drawn(frames, turn=turn):
            for f in frames:
                for key, init, h, x, found, total in zip(f[group].tolist(), f["run"].tolist(), f["h"], f["vectors"], f["centres"], f["cost"].tolist()):
                    x = x.reshape(len(h), -1)
                    chance = 2.0 * k * _gaps(x, np.stack([np.array(c) for c in found])).min(1) / total if total > 0 else np.zeros(len(x))
                    mixed = np.array(h, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(init * 64 + turn)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    lucky = np.flatnonzero((mixed >> np.uint64(11)) * 2.0**-53 < chance)
                    yield pd.DataFrame({group: pd.Series([key] * len(lucky), dtype=object), "run": init, "v": pd.Series([x[j] for j in lucky.tolist()], dtype=object)})

        more = held.join(small(priced), group).select(group, "run", "h", "vectors", "centres", "cost").mapInPandas(drawn, f"{group} {kind}, run int, v array<double>")
        # About twice k vectors a group, run and round.
        gathered = more.groupBy(group, "run").agg(F.sort_array(F.collect_list("v")).alias("more"))
        centres = written(centres.join(gathered, [group, "run"], "left").select(group, "run", F.concat("centres", F.coalesce("more", F.array().cast("array<array<double>>"))).alias("centres")), "centres")

    def sums(x, c, h, init):
        own = _gaps(x, c).argmin(1)
        out = np.zeros((len(c), x.shape[1] + 2))
        out[:, :-2] = (own == np.arange(len(c))[:, None]).astype(float) @ x
        out[:, -2] = np.bincount(own, minlength=len(c))
        out[:, -1] = np.bincount(own, ((x - c[own]) ** 2).sum(1), len(c))
        return out

    def per_centre(found: DataFrame) -> DataFrame:
        """(group, run, at, v): per centre the sum of its points, their number and their cost."""
        return as_lists(_by_blocks(held, found, group, kind, sums).groupBy(group, "run", "at", "pos").agg(F.sum("x").alias("x")))

    weights = per_centre(centres).groupBy(group, "run").agg(F.sort_array(F.collect_list(F.struct("at", F.element_at("v", -2).alias("n")))).alias("weights"))

    def cut(key, frame: pd.DataFrame) -> pd.DataFrame:
        c, n = np.stack([np.array(v) for v in frame["centres"].iloc[0]]), np.array([w["n"] for w in frame["weights"].iloc[0]])
        rng = np.random.default_rng(seed + int(key[1]))
        chosen = [int(rng.choice(len(c), p=n / n.sum()))]
        gap = ((c - c[chosen[0]]) ** 2).sum(1)
        while len(chosen) < k and (gap * n).sum() > 0:
            chosen.append(int(rng.choice(len(c), p=gap * n / (gap * n).sum())))
            gap = np.minimum(gap, ((c - c[chosen[-1]]) ** 2).sum(1))
        found = c[chosen]
        for _ in range(LLOYD_ROUNDS):
            own = _gaps(c, found).argmin(1)
            total = np.bincount(own, n, len(found))
            found = np.where(total[:, None] > 0, np.stack([np.bincount(own, c[:, j] * n, len(found)) for j in range(c.shape[1])], 1) / np.maximum(total, 1e-300)[:, None], found)
        return pd.DataFrame({group: [key[0]], "run": [key[1]], "centres": [found.tolist()]})

    centres = written(centres.join(weights, [group, "run"]).groupBy(group, "run").applyInPandas(cut, f"{group} {kind}, run int, centres array<array<double>>"), "centres")
    if (centres.agg(F.sum(F.aggregate("centres", F.lit(0), lambda n, c: n + F.size(c)))).first()[0] or 0) <= ON_DRIVER:
        now = {(r[0], r.run): np.array(r.centres) for r in centres.collect()}
        for _ in range(LLOYD_ROUNDS):
            found = _added_up(held, now, group, kind, sums)
            # A centre without points stays where it is.
            new = {at: np.where(v[:, -2:-1] > 0, v[:, :-2] / np.maximum(v[:, -2:-1], 1e-300), now[at]) for at, v in found.items()}
            farthest, now = max((np.sqrt(((new[at] - now[at]) ** 2).sum(1)).max() for at in now), default=0.0), new
            if farthest < 1e-9:
                break
        best: dict = {}
        for (key, init), v in _added_up(held, now, group, kind, sums).items():
            best[key] = min(best.get(key, (np.inf, 0)), (float(v[:, -1].sum()), init))
            now[key, init] = (now[key, init], v[:, -2])
        rows = [(key, [(c.tolist(), float(n)) for c, n in zip(*now[key, init]) if n > 0]) for key, (_, init) in best.items()]
        return written(points.sparkSession.createDataFrame(rows, f"{group} {kind}, prototypes {PROTOTYPES}"), "fitted")
    listed = lambda v: F.sort_array(F.collect_list(F.struct("at", v.alias("v"))))  # noqa: E731  # k entries
    for _ in range(LLOYD_ROUNDS):
        found = written(per_centre(centres), "sums")
        d = F.size("v") - 2
        mean = F.transform(F.slice("v", F.lit(1), d), lambda x: x / F.greatest(F.element_at("v", -2), F.lit(1e-300)))
        new = found.groupBy(group, "run").agg(listed(F.when(F.element_at("v", -2) > 0, mean)).alias("new"))
        # A centre without points stays where it is.
        moved = written(centres.join(new, [group, "run"]).select(group, "run", F.zip_with("centres", "new", lambda c, m: F.coalesce(m["v"], c)).alias("centres"), F.col("centres").alias("before")), "centres")
        gap = F.array_max(F.transform(F.arrays_zip("centres", "before"), lambda z: euclidean(z["centres"], z["before"])))
        farthest, centres = moved.agg(F.max(gap)).first()[0], moved.select(group, "run", "centres")
        if not farthest or farthest < 1e-9:
            break
    found = written(per_centre(centres), "sums").groupBy(group, "run").agg(F.sum(F.element_at("v", -1)).alias("cost"), listed(F.element_at("v", -2)).alias("n"))
    best = centres.join(found, [group, "run"]).groupBy(group).agg(F.min_by(F.struct("centres", "n"), F.struct("cost", "run")).alias("b"))
    pairs = F.zip_with("b.centres", "b.n", lambda c, n: F.struct(c.alias("vector"), n["v"].alias("support")))
    return best.select(group, F.filter(pairs, lambda p: p["support"] > 0).cast(PROTOTYPES).alias("prototypes"))


def fit_prototypes(df: DataFrame, group: str, k: int = 16, seed: int = 0, n_init: int = 2, sample: int | None = None, clusterer=None) -> DataFrame:
    """(group, prototypes) of rows (group, object_id, vector, and rand if there is one).

    clusterer: an object with fit_predict and n_clusters, used instead of k-means with k; it is sent to the tasks, and each group is then fitted in one.

    All of a group's points are fitted. With `sample`, as in the definition of the node statistics, at most so many rows: those with the least rand.
    For k = 1 the mean is a plain aggregation. A group of at most MOST_IN_TASK points is fitted in one task; larger ones by rounds over blocks of their points."""
    kind = df.schema[group].dataType.simpleString()
    if clusterer is not None:
        check_clusterer(clusterer)
        k = clusterer.n_clusters
    points = df.filter("vector is not null")
    if k == 1 and sample is None:
        at = points.select(group, F.posexplode("vector").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
        found = at.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"), F.max("n").alias("n"))
        return found.select(group, F.array(F.struct(F.col("v").alias("vector"), F.col("n").alias("support"))).cast(PROTOTYPES).alias("prototypes"))
    order = ["rand", "object_id"] if "rand" in df.columns else [F.xxhash64("object_id", F.lit(seed)), "object_id"]
    large = None
    if sample is None and clusterer is None:
        counts = points.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_IN_TASK).select(group)
        if not counts.isEmpty():
            large = _fit_large(points.join(small(counts), group, "left_semi"), group, kind, k, seed, n_init)
            points = points.join(small(counts), group, "left_anti")
    ranked = points.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if sample is not None:
        ranked = ranked.filter(F.col("r") <= sample)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        return pd.DataFrame({group: [key[0]], "prototypes": [_as_rows(*fit_prototypes_of(np.array(frame["vector"].tolist(), float), k, seed, n_init, clusterer))]})

    if k > 1 and clusterer is None:
        # Groups of k points or fewer are their points: no Python.
        ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
        few = ranked.filter(F.col("n") <= k).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("r", _doubles().alias("vector")))).alias("p"))
        few = few.select(group, F.transform("p", lambda p: F.struct(p["vector"].alias("vector"), F.lit(1.0).alias("support"))).cast(PROTOTYPES).alias("prototypes"))
        ranked = ranked.filter(F.col("n") > k)
        large = few if large is None else few.unionByName(large)
    found = ranked.select(group, "r", "vector").groupBy(group).applyInPandas(run, f"{group} {kind}, prototypes {PROTOTYPES}")
    return found if large is None else found.unionByName(large)


def merge_prototypes_of(vectors: np.ndarray, support: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """V4: complete-linkage agglomeration down to k; a cluster becomes its support-weighted mean."""
    groups: list[list[int] | None] = [[i] for i in range(len(vectors))]
    d = np.sqrt(np.maximum((vectors**2).sum(1)[:, None] - 2 * vectors @ vectors.T + (vectors**2).sum(1), 0))
    np.fill_diagonal(d, np.inf)
    for _ in range(len(groups) - k):
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        groups[a] += groups[b]
        groups[b] = None
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[b] = d[:, b] = d[a, a] = np.inf
    groups = [g for g in groups if g is not None]
    return np.array([np.average(vectors[g], axis=0, weights=support[g]) for g in groups]), np.array([support[g].sum() for g in groups])


#: Entries of the distance matrices of groups that are merged at once; points of a group up to which it is merged as a whole, and of the pieces of larger ones.
MERGED_AT_ONCE, MERGED_WHOLE, PIECE = 1 << 20, 128, 64


def merge_many(vectors: np.ndarray, support: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merge_prototypes_of for many groups at once, whose points follow each other: (vectors, support, how many of them each group has)."""
    begin, most = np.cumsum(sizes) - sizes, int(sizes.max())
    n, rows, held = len(sizes), np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum()))
    at = held - begin[rows]
    x = np.zeros((n, most, vectors.shape[1]))
    x[rows, at] = vectors
    there = np.zeros((n, most), bool)
    there[rows, at] = True
    square = (x**2).sum(2)
    d = np.sqrt(np.maximum(square[:, :, None] - 2 * x @ x.transpose(0, 2, 1) + square[:, None, :], 0))
    d[~(there[:, :, None] & there[:, None, :])] = np.inf
    d[:, np.arange(most), np.arange(most)] = np.inf
    label = np.tile(np.arange(most), (n, 1))
    # The nearest of each point, the first of equal ones, and how far it is: a merge changes it only for those whose nearest was merged.
    near, gap = d.argmin(2), d.min(2)
    for turn in range(most - k):
        g = np.flatnonzero(sizes - k > turn)
        a = gap[g].argmin(1)
        b = near[g, a]
        label[g] = np.where(label[g] == b[:, None], a[:, None], label[g])
        far = np.maximum(d[g, a], d[g, b])
        d[g, a] = far
        d[g, :, a] = far
        d[g, b] = np.inf
        d[g, :, b] = np.inf
        d[g, a, a] = np.inf
        gap[g, b] = np.inf
        lost = (near[g] == a[:, None]) | (near[g] == b[:, None])
        lost[np.arange(len(g)), a] = True
        i, j = np.nonzero(lost & ((gap[g] < np.inf) | (np.arange(most) == a[:, None])))
        i = g[i]
        near[i, j] = d[i, j].argmin(1)
        gap[i, j] = d[i, j, near[i, j]]
    own, to = np.unique(rows * most + label[rows, at], return_inverse=True)
    total = np.bincount(to, support)
    means = np.stack([np.bincount(to, vectors[:, j] * support) for j in range(vectors.shape[1])], 1) / total[:, None]
    return means, total, np.bincount(own // most, minlength=n)


def merge_lists(groups: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """merge_prototypes_of for each of groups (vectors, support) of over k points, many at a time.

    Work for a group grows with the square of its points and more, so one of over MERGED_WHOLE is merged in pieces of neighbours along the first dimensions until it is small enough."""
    held, piece = list(groups), max(PIECE, 2 * k)
    while large := [g for g, (x, _) in enumerate(held) if len(x) > max(MERGED_WHOLE, 2 * piece)]:
        cut: list[tuple[np.ndarray, np.ndarray]] = []
        ends = [0]
        for g in large:
            x, n = held[g]
            order = np.lexsort((n, *x.T[::-1]))
            pieces = -(-len(x) // piece)
            cut += zip(np.array_split(x[order], pieces), np.array_split(n[order], pieces))
            ends.append(len(cut))
        cut = merge_lists(cut, k)
        for g, a, b in zip(large, ends, ends[1:]):
            held[g] = tuple(np.concatenate(c) for c in zip(*cut[a:b]))
    # Groups of like sizes are merged together.
    sizes, width = np.array([len(x) for x, _ in held], np.int64), np.array([x.shape[1] for x, _ in held], np.int64)
    order = np.lexsort((sizes, width)).tolist()
    while order:
        last = order[-1]
        taken = [g for g in order[-max(1, MERGED_AT_ONCE // int(sizes[last]) ** 2) :] if width[g] == width[last]]
        del order[len(order) - len(taken) :]
        found, total, many = merge_many(*(np.concatenate(c) for c in zip(*(held[g] for g in taken))), sizes[taken], k)
        for g, x, n in zip(taken, np.split(found, np.cumsum(many)[:-1]), np.split(total, np.cumsum(many)[:-1])):
            held[g] = (x, n)
    return held


def _merged(k: int):
    """Rows (group, prototypes as lists of numbers: the vectors, one after the other, and the supports), each of over k prototypes, merged down to k."""

    def run(batches):
        for batch in batches:
            values, support = batch.column(1), batch.column(2)
            v, s = (np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in (values, support))
            found = merge_lists([(x.reshape(len(n), -1), n) for x, n in zip(v, s)], k) if batch.num_rows else []
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([x.ravel() for x, _ in found]), lists([n for _, n in found])], batch.schema.names)

    return run


def merge_prototypes(df: DataFrame, group: str, k: int = 16, fold: int = 64) -> DataFrame:
    """V4: (group, prototypes) of rows (group, prototypes): all of a group's merged down to k. Groups of many rows are merged in folds of `fold` rows first, so no task holds more than that.

    Groups with k prototypes or fewer never go to Python, the others many at a time."""
    kind, tasks = df.schema[group].dataType.simpleString(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        every = rows.groupBy(*keys).agg(F.flatten(F.collect_list("prototypes")).alias("p")).select(group, F.col("p").cast(PROTOTYPES).alias("p"))
        lists = every.filter(F.size("p") > k).select(group, F.flatten("p.vector").alias("v"), F.col("p.support").alias("s"))
        # Few bytes, but much work: dealt to all tasks, which Spark would join by their bytes.
        found = lists.repartition(tasks, group).mapInArrow(_merged(k), f"{group} {kind}, v array<double>, s array<double>")
        width = (F.size("v") / F.size("s")).cast("int")
        fewer = F.transform("s", lambda s, i: F.struct(F.slice("v", i * width + 1, width).alias("vector"), s.alias("support"))).cast(PROTOTYPES)
        return every.filter(F.size("p") <= k).select(group, F.col("p").alias("prototypes")).unionByName(found.select(group, fewer.alias("prototypes")))

    rows = df.select(group, "prototypes").filter("size(prototypes) > 0")
    while rows.groupBy(group).count().filter(F.col("count") > fold).limit(1).count():
        number = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("prototypes")))
        rows = merged(rows.withColumn("part", F.floor((number - 1) / fold)), group, "part")
    return merged(rows, group)


def prototype_set_distance(a: DataFrame, b: DataFrame, metric: str = "euclidean") -> DataFrame:
    """V5: one row `distance`: the larger of the two mean least distances between prototypes (id, vector) of a and of b."""
    one = lambda x, y: prototype_distance(x.select(F.col("id").alias("object_id"), "vector"), y.select("vector"), metric).agg(F.avg("distance").alias("mean"))
    both = one(a, b).withColumnRenamed("mean", "mean_a").crossJoin(one(b, a).withColumnRenamed("mean", "mean_b"))  # one row each
    return both.select(F.greatest("mean_a", "mean_b").alias("distance"))


def predict_scores(points: DataFrame, classes: DataFrame, n_classes: int, metric: str = "euclidean", softmax: bool = False) -> DataFrame:
    """V7: (object_id, label, score) for labels 0..n_classes-1: minus the least distance to the label's prototypes (label, vector), minus infinity for a label without any; or its softmax over labels."""
    known, labels = classes.filter("vector is not null").select("label", "vector"), F.sequence(F.lit(0), F.lit(n_classes - 1))
    if one := _in_one_row(known, "label", "vector", rows=LIST_ROWS):
        of_label = lambda label: F.array_min(F.transform(F.filter("all", lambda p: p["label"] == label), lambda p: METRICS[metric](F.col("vector"), p["vector"])))
        scored = points.select("object_id", "vector").crossJoin(one).select("object_id", F.explode(F.transform(labels, lambda x: F.struct(x.cast("int").alias("label"), (-of_label(x)).alias("score")))).alias("e"))  # one row
        found = scored.select("object_id", "e.label", F.coalesce("e.score", F.lit(float("-inf"))).alias("score"))
    else:
        named = known.select(F.struct("label", F.xxhash64("vector").alias("h")).alias("at"), "vector")
        # A block keeps a point's least of all labels, so each label is compared on its own.
        parts = [_far_pairs(points, named.filter(F.col("at.label") == k).select(F.col("at.h").alias("other"), "vector"), metric, "least").select("object_id", F.lit(k).alias("label"), "d") for k in range(n_classes)]
        near = reduce(DataFrame.unionByName, parts).groupBy("object_id", "label").agg((-F.min("d")).alias("score"))
        every = points.select("object_id", F.explode(labels).alias("label"))
        found = every.join(shuffled(near), ["object_id", "label"], "left").select("object_id", "label", F.coalesce("score", F.lit(float("-inf"))).alias("score"))
    if softmax:
        w = Window.partitionBy("object_id")
        found = found.withColumn("e", F.exp(F.col("score") - F.max("score").over(w))).select("object_id", "label", (F.col("e") / F.sum("e").over(w)).alias("score"))
    return found


def predict(scores: DataFrame) -> DataFrame:
    """V8: (object_id, label): the label of the best score, the smallest of equal ones."""
    return scores.groupBy("object_id").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("label"))


def type_radius(types: DataFrame) -> DataFrame:
    """V9: (type_id, radius): each type's distance to the nearest other one; infinite for a single type."""
    if one := _in_one_row(types.filter("vector is not null"), "type_id", "vector"):
        others = F.filter("all", lambda t: t["type_id"] != F.col("type_id"))
        near = F.array_min(F.transform(others, lambda t: euclidean(F.col("vector"), t["vector"])))
        return types.crossJoin(one).select("type_id", F.coalesce(near, F.lit(float("inf"))).alias("radius"))  # one row
    pairs = _far_pairs(types.select(F.col("type_id").alias("object_id"), "vector"), types.select(F.col("type_id").alias("other"), "vector"), "euclidean", "all")
    near = pairs.filter("object_id <> other").groupBy(F.col("object_id").alias("type_id")).agg(F.min("d").alias("radius"))
    return types.select("type_id").join(near, "type_id", "left").select("type_id", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))


def distances(types: DataFrame, points: DataFrame) -> DataFrame:
    """(object_id, type_id, distance) of all points and types."""
    if one := _in_one_row(types, "type_id", "vector"):
        rows = points.select("object_id", "vector").crossJoin(one).select("object_id", F.explode(F.transform("all", lambda t: F.struct(t["type_id"].alias("type_id"), euclidean(F.col("vector"), t["vector"]).alias("distance")))).alias("e"))  # one row
        return rows.select("object_id", "e.*")
    return _far_pairs(points, types.select(F.col("type_id").alias("other"), "vector"), "euclidean", "all").select("object_id", F.col("other").alias("type_id"), F.col("d").alias("distance"))


def classify(types: DataFrame, points: DataFrame, safe: bool = True) -> DataFrame:
    """(object_id, type_id, distance): the nearest type, the smallest of equal ones; with `safe` -1 unless the distance is below the type's radius. Points or types without a vector are left out."""
    known = types.filter("vector is not null").select("type_id", "vector")
    if one := _in_one_row(known, "type_id", "vector", rows=LIST_ROWS):
        best = F.array_min(F.transform("all", lambda t: F.struct(euclidean(F.col("vector"), t["vector"]).alias("distance"), t["type_id"].alias("type_id"))))
        near = points.filter("vector is not null").crossJoin(one).select("object_id", best.alias("best")).filter("best is not null").select("object_id", "best.type_id", "best.distance")  # one row
    else:
        found = _far_pairs(points, known.select(F.col("type_id").alias("other"), "vector"), "euclidean", "least")
        near = found.groupBy("object_id").agg(F.min(F.struct("d", "other")).alias("best")).select("object_id", F.col("best.other").alias("type_id"), F.col("best.d").alias("distance"))
    if not safe:
        return near
    return near.join(small(type_radius(known)), "type_id").select("object_id", F.when(F.col("distance") < F.col("radius"), F.col("type_id")).otherwise(F.lit(-1)).alias("type_id"), "distance")


def nearest_centroids(train: DataFrame) -> DataFrame:
    """(type_id, vector): the mean of each class of rows (type_id, vector)."""
    return mean_vectors(train, "type_id").select("type_id", "vector")


def nearest_distance(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(object_id, type_id, distance): the nearest centroid."""
    return classify(centroids, points, safe=False)


#: Dimensions that a projection's covariance has at most; it is decomposed on the driver.
MOST_DIMENSIONS = 1024
#: Rows whose mean is taken off all vectors before their products are summed; any vector gives the same covariance, a near one the best digits.
SHIFT_ROWS = 1000


def covariance(vectors: DataFrame, vector: str = "vector") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sum of centred cross products) of the vectors that aren't null and have no null, in one pass: tasks sum up products of the vectors without a common shift, which add up."""
    held = vectors.select(F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    few = np.array([r.v for r in held.limit(SHIFT_ROWS).collect()])
    if not few.size:
        return 0, np.empty(0), np.empty((0, 0))
    shift, d = few.mean(axis=0), few.shape[1]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions; {MOST_DIMENSIONS} are allowed")
    sent = vectors.sparkSession.sparkContext.broadcast(shift)

    def products(frames):
        total, n = np.zeros((d + 1, d)), 0
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()) - sent.value
                total[:d] += x.T @ x
                total[d] += x.sum(axis=0)
                n += len(x)
        if n:
            yield pd.DataFrame({"i": np.repeat(np.arange(d + 1), d), "j": np.tile(np.arange(d), d + 1), "x": total.ravel(), "n": n})

    # (d + 1) * d rows, whatever the number of vectors.
    rows = held.mapInPandas(products, "i int, j int, x double, n long").groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    total = np.zeros((d + 1, d))
    for r in rows:
        total[r.i, r.j] = r.x
    n, first = rows[0].n, total[d]
    return n, shift + first / n, total[:d] - np.outer(first, first) / n


def principal_components(centred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k components as rows, variances of all) of a sum of centred cross products, largest variance first; the entry of largest size of a component is positive."""
    values, found = np.linalg.eigh((centred + centred.T) / 2)
    values, found = np.maximum(values[::-1], 0.0), found[:, ::-1][:, :k].T
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return found * np.where(signs == 0, 1.0, signs)[:, None], values


def pca(df: DataFrame, k: int, vector: str = "vector", out: str = "projected") -> tuple[DataFrame, float]:
    """Df with the projection of the centred vectors on k components, and the share of variance that these explain.

    A vector that is null or has a null isn't fitted and has a null projection. Without any vectors all projections are null and the share is 0. A
    component's sign is such that its largest entry is positive."""
    n, mean, centred = covariance(df, vector)
    if not n:
        return df.withColumn(out, F.lit(None).cast("array<double>")), 0.0
    if k > len(mean):
        raise ValueError(f"{k} components of {len(mean)} dimensions")
    axes, values = principal_components(centred, k)
    sent = df.sparkSession.sparkContext.broadcast((axes.T, mean @ axes.T))

    @F.pandas_udf("array<double>")
    def project(column: pd.Series) -> pd.Series:
        turn, middle = sent.value
        found, whole = [None] * len(column), [i for i, v in enumerate(column) if v is not None and not np.isnan(v).any()]
        if whole:
            for i, row in zip(whole, np.stack([column.iloc[i] for i in whole]) @ turn - middle):
                found[i] = row
        return pd.Series(found, dtype=object)

    given = F.transform(F.col(vector), lambda x: x.cast("double"))
    share = float(values[:k].sum() / values.sum()) if values.sum() > 0 else 0.0
    return df.withColumn(out, project(given)), share


def combine_covariances(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, mean_x, mean_y, cov) of the union of two groups, each given by its n, mean_x, mean_y and cov; equals covar_pop of all rows."""
    u, v = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)), b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    n = F.col("a_n") + F.col("b_n")
    mean = lambda c: (F.col("a_n") * F.col(f"a_{c}") + F.col("b_n") * F.col(f"b_{c}")) / n
    cross = F.col("a_n") * F.col("b_n") / (n * n) * (F.col(f"a_{x}") - F.col(f"b_{x}")) * (F.col(f"a_{y}") - F.col(f"b_{y}"))
    return u.crossJoin(v).select(n.alias("n"), mean(x).alias(x), mean(y).alias(y), ((F.col("a_n") * F.col("a_cov") + F.col("b_n") * F.col("b_cov")) / n + cross).alias("cov"))  # one row each


def forest_nodes(model) -> list[tuple[list[int], list[float], list[int], list[int], list[float]]]:
    """(feature, threshold, left, right, share of label 1) of the nodes of each tree of a fitted forest; a leaf has feature -1.

    The model is written to the shared folder and its nodes are read from there: a call to the driver's JVM for each of a grown tree's nodes would take minutes."""
    spark = SparkSession.active()
    path = new_path(spark, "forest")
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), n["impurityStats"].alias("counts"))
    out = [([], [], [], [], []) for _ in range(model.getNumTrees)]
    for tree, at, left, right, feature, threshold, counts in rows.orderBy("treeID", "id").toLocalIterator():  # the model's nodes
        if at != len(out[tree][0]):
            raise RuntimeError("the model's nodes are not numbered from 0")
        inner = left >= 0
        share = counts[1] / sum(counts) if len(counts) > 1 and sum(counts) else 0.0
        for held, x in zip(out[tree], (feature if inner else -1, threshold if inner else 0.0, max(left, 0), max(right, 0), share)):
            held.append(x)
    return out


def forest_scores(candidates: DataFrame, trees: list[tuple]) -> DataFrame:
    """Candidates (object_id, vector) with `score`: the mean share of label 1 in the leaves that a vector comes to; a null vector has none. The trees go to the tasks as arrays."""
    sent = candidates.sparkSession.sparkContext.broadcast([tuple(map(np.array, tree)) for tree in trees])

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        whole = column.notna().to_numpy()
        total = np.full(len(column), np.nan)
        if whole.any():
            x = np.stack(column[whole].to_numpy())
            votes = np.zeros(len(x))
            for feature, threshold, left, right, share in sent.value:
                at = np.zeros(len(x), np.int64)
                while (inner := feature[at] >= 0).any():
                    here = at[inner]
                    low = x[np.flatnonzero(inner), feature[here]] <= threshold[here]
                    at[inner] = np.where(low, left[here], right[here])
                votes += share[at]
            total[whole] = votes / len(sent.value)
        return pd.Series(total).where(whole, None)

    return candidates.select("object_id", score(_doubles()).alias("score"))


#: The largest depth of a tree that MLlib takes.
MOST_DEPTH = 30


def rf_rank(candidates: DataFrame, valid: DataFrame, rejected: DataFrame, seed: int = 0, **forest) -> DataFrame:
    """Candidates (object_id, vector) with `score`: a random forest's probability of being valid rather than rejected; a null vector has none.

    As in the reference, trees grow until their leaves are pure (to MLlib's largest depth, unless `forest` has a maxDepth): trees of a fixed depth tell the known
    objects apart the less, the more there are. The trees are read from the fitted model once, so the plan holds no model."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = valid.select("vector", F.lit(1.0).alias("label")).unionByName(rejected.select("vector", F.lit(0.0).alias("label"))).filter("vector is not null")
    rows = written(known.select("label", _doubles().alias("vector")), "known")
    model = RandomForestClassifier(featuresCol="f", labelCol="label", seed=seed, **({"maxDepth": MOST_DEPTH} | forest)).fit(rows.select("label", array_to_vector("vector").alias("f")))
    return forest_scores(candidates, forest_nodes(model))
