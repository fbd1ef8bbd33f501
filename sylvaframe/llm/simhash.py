"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is the bitwise majority over the XXH64 hashes of all word shingles
of a text. The trie of the distinct fingerprints is joined with itself: pairs of nodes
are walked together from the root, level by level, differing bits add up, and pairs
beyond the error budget are pruned, until both nodes are single fingerprints.

The top of the trie is walked on DataFrames: nodes with too many fingerprints are
split, again and again, and the pairs of top nodes within the budget are dealt out with
their fingerprints. So a task holds two bounded nodes, whatever the data; it walks on in
numpy.

A task emits a spanning forest of its links, not its pairs; the forests are
merged by alternating large-star and small-star rounds on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import as_bytes, id_and_text, partitions_for, written

WORDS_PER_SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints that a top node of the trie has at most, and the bits by which a larger one is split.
NODE_KEYS, SPLIT_BITS = 1 << 16, 4
#: Node pairs that a task expands at once, and fingerprints that it holds at once if they are of several pairs of top nodes.
FRONTIER, AT_ONCE = 1 << 18, 1 << 17
#: Fingerprints of a node that one row has, on average, where nodes are dealt out to all the pairs that they are in.
CHUNK = 128


def shingle_hashes(text: bytes, n: int = WORDS_PER_SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each n-word shingle of an A-Z lower-cased text, repeats included; fewer than n words: of the whole sequence; none: empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-n])).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the fingerprint as a signed long. Null texts count as empty, with fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(shingle_hashes(t, n)) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the links (a, b) into label, in which each index points to a smaller or equal one."""
    while len(a):
        a, b = label[a], label[b]
        while True:
            up_a, up_b = label[a], label[b]
            if (up_a == a).all() and (up_b == b).all():
                break
            a, b = up_a, up_b
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, hi, lo)
            a, b = lo, hi


def _flatten(label: np.ndarray) -> np.ndarray:
    while not (label[label] == label).all():
        label = label[label]
    return label


@dataclass(frozen=True)
class Budget:
    """At most `bits` differing bits, looked for in `turns` tries, each of which begins with another part of the bits.

    Of two keys that differ in `bits` bits or fewer, some rotation by whole parts has at most its share of the differing bits in every beginning
    made of whole parts: no more than bits * j / turns in the first j. So a trie that is walked under this tightening budget in each rotation finds
    every pair, and one rotation is the plain budget."""

    bits: int
    turns: int = 1
    #: Pairs of keys up to which a pair of nodes is not walked further, but its keys are compared.
    leaf: int = 1

    def upto(self) -> list[int]:
        """The bits that may differ among the first 0, 1, ..., 64."""
        return [self.bits * -(-d * self.turns // 64) // self.turns for d in range(65)]

    def turned(self) -> list[int]:
        """The bits by which each trie's keys are rotated left."""
        return [64 * t // self.turns for t in range(self.turns)]


#: Calls of the step that goes from node pairs to pairs of their children, for tests.
steps_taken = 0


def trie_forest(keys: np.ndarray, first: np.ndarray, depths: np.ndarray, budget: Budget) -> np.ndarray:
    """For each key, the index of the root of its tree, over links of at most budget.bits differing bits.

    first: pairs of trie nodes, as rows (a0, a1, b0, b1, bits that differ so far), each at its depth; a node is a range of sorted keys, and a
    node's pair with itself stands for the links within it. Pairs are expanded together, bit by bit, until both nodes are single keys (or have
    budget.leaf pairs of keys at most); a pair beyond the budget is dropped, and so is one whose keys are all in one tree already."""
    global steps_taken
    label, limit = np.arange(len(keys)), budget.upto()
    # Where two neighbours first differ: a node at depth d is split at its only neighbours that differ first at bit d.
    apart = keys[1:] ^ keys[:-1]
    high = 31 - np.floor(np.log2(np.maximum(apart >> np.uint64(32), 1).astype(np.float64))).astype(np.int64)
    low = 63 - np.floor(np.log2(np.maximum(apart & np.uint64(0xFFFFFFFF), 1).astype(np.float64))).astype(np.int64)
    differ = np.where(apart >> np.uint64(32) > 0, high, low)
    order = np.argsort(differ, kind="stable").astype(np.int32)
    ends = np.searchsorted(differ[order], np.arange(65))
    cuts = [np.append(order[ends[d] : ends[d + 1]] + np.int32(1), np.int32(len(keys) + 1)) for d in range(64)]

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        at = cuts[depth][np.minimum(np.searchsorted(cuts[depth], lo, "right"), len(cuts[depth]) - 1)]
        zero = (keys[lo] >> np.uint64(63 - depth)) & np.uint64(1) == 0
        return np.where(at < hi, at, np.where(zero, hi, lo))

    def compare(a0, a1, b0, b1) -> None:
        """Links the keys of the pairs, each with each."""
        size = (a1 - a0) * (b1 - b0)
        if (size == 1).all():
            i, j = a0, b0
        elif len(size) > FRONTIER // budget.leaf:  # a bounded number of key pairs at once
            for x in range(0, len(size), FRONTIER // budget.leaf):
                compare(*(c[x : x + FRONTIER // budget.leaf] for c in (a0, a1, b0, b1)))
            return
        else:
            k = np.repeat(np.arange(len(size), dtype=np.int32), size)
            at = np.arange(len(k), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
            wide = (b1 - b0)[k]
            i, j = a0[k] + at // wide, b0[k] + at % wide
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget.bits
        near &= i != j
        _merge(label, i[near], j[near])

    first = first.astype(np.int32)
    stack = [(int(d), tuple(np.ascontiguousarray(c) for c in first[depths == d].T)) for d in np.unique(depths)[::-1]]
    while stack:
        depth, pairs = stack.pop()
        n = len(pairs[0])
        if n > FRONTIER:
            nearest_last = np.argsort(-pairs[4].astype(np.int16), kind="stable")
            stack += [(depth, tuple(x[nearest_last[k : k + FRONTIER]] for x in pairs)) for k in range(0, n, FRONTIER)]
            continue
        steps_taken += 1
        a0, a1, b0, b1, err = pairs
        if n > 1024:
            label = _flatten(label)
            changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            apart = (label[a0] != label[b0]) | (changes[a1 - 1] != changes[a0]) | (changes[b1 - 1] != changes[b0])
            a0, a1, b0, b1, err = (x[apart] for x in pairs)
        done = (a1 - a0).astype(np.int64) * (b1 - b0) <= budget.leaf
        if done.any():
            compare(a0[done], a1[done], b0[done], b1[done])
            a0, a1, b0, b1, err = (x[~done] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        am, bm = split(a0, a1, depth), split(b0, b1, depth)
        zero_a, one_a, zero_b, one_b = a0 < am, am < a1, b0 < bm, bm < b1
        more = err < limit[depth + 1]
        even = err <= limit[depth + 1]
        # Of a node with itself, zeros with ones is the same as ones with zeros.
        chosen = [(np.flatnonzero(x), *y) for x, y in (
            (zero_a & one_b & more, (a0, am, bm, b1, 1)), (one_a & zero_b & more & (a0 != b0), (am, a1, b0, bm, 1)),
            (zero_a & zero_b & even, (a0, am, b0, bm, 0)), (one_a & one_b & even, (am, a1, bm, b1, 0)),
        )]
        out = tuple(np.concatenate([c[k + 1][c[0]] for c in chosen]) for k in range(4)) + (np.concatenate([err[c[0]] + np.int32(c[5]) for c in chosen]),)
        if len(out[0]):
            stack.append((depth + 1, out))
    return _flatten(label)


# --- the trie on Spark -----------------------------------------------------------------------------------------------

PAIR = ["turn", "da", "a", "db", "b"]


def _prefix(key: str, depth: int) -> Column:
    """The first `depth` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def trie_pairs(keys: DataFrame, budget: Budget) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs) for keys (turn, key).

    nodes: (turn, depth, node, n, key): each key with its top node, which has n, the nodes being split, SPLIT_BITS at a time, until they have at most NODE_KEYS keys.
    pairs: (turn, da, a, db, b, err): the pairs of top nodes whose first bits are within the budget, a node with itself included."""
    limit = budget.upto()
    kind = "turn int, da int, a long, a_open boolean, db int, b long, b_open boolean, err int"
    open_keys, depth, nodes, done, pairs = keys, 0, [], [], None
    while True:
        named = open_keys.withColumn("node", _prefix("key", depth))
        counted = named.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > NODE_KEYS).alias("open")).select("turn", "node", "n", F.when(F.lit(depth < 64), F.col("open")).otherwise(False).alias("open"))
        counted = written(counted, "trie-nodes")  # a row for every NODE_KEYS / 2^SPLIT_BITS keys or so
        nodes.append(named.join(counted.filter("not open"), ["turn", "node"]).select("turn", F.lit(depth).alias("depth"), "node", "n", "key"))
        if pairs is None:
            pairs = counted.select("turn", F.lit(0).alias("da"), F.col("node").alias("a"), F.col("open").alias("a_open"), F.lit(0).alias("db"), F.col("node").alias("b"), F.col("open").alias("b_open"), F.lit(0).alias("err"))
        else:
            children = counted.select("turn", F.shiftrightunsigned("node", SPLIT_BITS).alias("parent"), "node", "open")
            side = lambda c: children.select("turn", F.col("parent").alias(c), F.col("node").alias(f"{c}_node"), F.col("open").alias(f"{c}_now"))
            open_pairs = pairs.filter("a_open or b_open")
            pick = lambda p, c: p.filter(f"{c}_open").join(side(c), ["turn", c]).unionByName(p.filter(f"not {c}_open").withColumn(f"{c}_node", F.col(c)).withColumn(f"{c}_now", F.lit(False)))
            grown = pick(pick(open_pairs, "a"), "b").filter("da <> db or a <> b or a_node <= b_node")
            deeper = F.when(F.col("a_open") & F.col("b_open"), F.bit_count(F.col("a_node").bitwiseXOR(F.col("b_node")).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1)))).otherwise(0)
            grown = grown.select(
                "turn", F.when(F.col("a_open"), depth).otherwise(F.col("da")).alias("da"), F.col("a_node").alias("a"), F.col("a_now").alias("a_open"),
                F.when(F.col("b_open"), depth).otherwise(F.col("db")).alias("db"), F.col("b_node").alias("b"), F.col("b_now").alias("b_open"), (F.col("err") + deeper).cast("int").alias("err"),
            )
            done.append(pairs.filter("not a_open and not b_open"))
            pairs = written(grown.filter(F.col("err") <= limit[depth]), "trie-pairs")
        if counted.filter("open").isEmpty():
            closed = reduce(DataFrame.unionByName, [*done, pairs.filter("not a_open and not b_open")])
            return reduce(DataFrame.unionByName, nodes), closed.select(*PAIR, "err")
        open_keys = written(named.join(counted.filter("open"), ["turn", "node"]).select("turn", "key"), "open-keys")
        depth += SPLIT_BITS


def _walked(budget: Budget, grouped: bool):
    """Rows (turn, da, a, db, b, err, side, keys) in whole pairs, sorted by all but err and keys; emits what trie_links or trie_groups gives."""
    back = budget.turned()

    def walk(rows: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """rows: the numbers of each row; sizes: how many of keys are its own."""
        cut = np.concatenate(([0], np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(axis=1)) + 1))
        head = rows[cut]
        pair = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(rows))))
        order = np.lexsort((keys, np.repeat(2 * pair + rows[:, 6], sizes)))
        keys, pair = keys[order], np.repeat(pair, sizes)
        own = (head[:, 1] == head[:, 3]) & (head[:, 2] == head[:, 4])
        start, end = np.searchsorted(pair, np.arange(len(cut))), np.searchsorted(pair, np.arange(len(cut)), "right")
        mid = end - np.add.reduceat(sizes * rows[:, 6], cut)  # where side 1 begins
        first = np.stack((start, np.where(own, end, mid), np.where(own, start, mid), end, head[:, 5]), 1)
        ok = (first[:, 0] < first[:, 1]) & (first[:, 2] < first[:, 3]) & ((end - start) > 1)
        label = trie_forest(keys, first[ok], np.minimum(head[:, 1], head[:, 3])[ok], budget)
        by = np.array(back, np.uint64)[head[:, 0]][pair]
        whole = np.where(by > 0, (keys >> by) | (keys << ((np.uint64(64) - by) & np.uint64(63))), keys).view(np.int64)
        moved = np.flatnonzero(label != np.arange(len(label)))
        if not grouped:
            yield pa.RecordBatch.from_arrays([pa.array(whole[moved]), pa.array(whole[label[moved]])], ["a", "b"])
            return
        roots = np.unique(label[moved])
        members = np.concatenate((roots, moved))
        of = label[members]
        name = keys[of].copy()
        for k in range(5):
            name = (name ^ head[pair[of], k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            name ^= name >> np.uint64(29)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(whole[members])], ["key", "fp"])

    def joined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for whole in batches:
            for batch in (whole.slice(k, AT_ONCE // CHUNK + 1) for k in range(0, whole.num_rows, AT_ONCE // CHUNK + 1)):
                lists = batch.column(7)
                now = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(7)], 1), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
                if n + len(now[2]) >= AT_ONCE and held:
                    # All pairs but the last, which may go on, are whole.
                    rows, sizes, keys = joined([*held, now])
                    change = np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(axis=1))
                    at = change[-1] + 1 if len(change) else 0
                    m = int(sizes[:at].sum())
                    if at:
                        yield from walk(rows[:at], sizes[:at], keys[:m])
                    held, n = [(rows[at:], sizes[at:], keys[m:])], len(keys) - m
                else:
                    held.append(now)
                    n += len(now[2])
        if n:
            yield from walk(*joined(held))

    return run


def _joined(fps: DataFrame, budget: Budget, grouped: bool, schema: str) -> DataFrame:
    """The walk over all pairs of top nodes of fps (column fp, distinct)."""
    spark = fps.sparkSession
    turned = [F.struct(F.lit(t).alias("turn"), (F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")).alias("key")) for t, by in enumerate(budget.turned())]
    nodes, pairs = trie_pairs(written(fps.select(F.explode(F.array(*turned)).alias("r")).select("r.*"), "turned"), budget)
    ends = pairs.withColumn("ends", F.array(F.struct(F.lit(0).alias("side"), F.col("da").alias("depth"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("db").alias("depth"), F.col("b").alias("node"))))
    ends = ends.select(*PAIR, "err", F.explode("ends").alias("e")).select(*PAIR, "err", "e.*").filter("side = 0 or da <> db or a <> b")
    # A node goes to each pair that it is in, as lists of keys, as a row for each key has nine numbers, and a split node is in several pairs.
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / CHUNK))
    lists = nodes.groupBy("turn", "depth", "node", chunk.alias("chunk")).agg(F.collect_list("key").alias("keys"))
    dealt = lists.join(ends, ["turn", "depth", "node"]).select(*PAIR, "err", "side", "keys")
    dealt = dealt.repartition(partitions_for(spark), *PAIR).sortWithinPartitions(*PAIR, "side")
    return dealt.mapInArrow(_walked(budget, grouped), schema)


def trie_links(fps: DataFrame, budget: Budget = Budget(MAX_BITS)) -> DataFrame:
    """(a, b): links that join exactly the fingerprints (column fp, distinct) that differ in budget.bits bits or fewer, directly or by other links."""
    return _joined(fps, budget, False, "a long, b long").filter("a <> b").distinct()


def trie_groups(fps: DataFrame, budget: Budget) -> DataFrame:
    """(key, fp): groups of fingerprints (column fp, distinct), such that any two that differ in budget.bits bits or fewer share a group."""
    return _joined(fps, budget, True, "key long, fp long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, is_kept): one row per row of docs.

    fingerprint: 16 hex digits. component_id: the smallest id reachable over links of fingerprints that differ in at most MAX_BITS bits. is_kept:
    the id is that smallest one. Empty and null texts have fingerprint 0 and link like any other; rows with a null id take part and get their group's
    component_id (null if no row of the group has an id) and are not kept; repeated rows stay repeated; an empty table gives an empty result."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    kinds = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    comps = components(trie_links(kinds.select("fp")))
    rooted = kinds.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("is_kept")
    )
