"""Near copies: SimHash candidates, verified by the Jaccard similarity of word shingles.

A text has two fingerprints over its n-word shingles, of independent hashes. Two texts
are linked if one of their fingerprints differs in few bits and the sets of their
shingles are similar enough. The trie self-join gives groups in which all such pairs
meet. Groups with the same smallest member become one. All members of a group are held against
that one; in a group that this leaves in several components, all members are, in blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import small
from .common import as_bytes, memory_of, passing, small_batches, written
from .simhash import Budget, _merge, majority, trie_groups

WORDS_PER_SHINGLE = 5
SIMILAR = 0.8
#: Fingerprints of a text, the bits that one of them may differ in, and the tries that are walked for it. Of texts with a similarity of 0.8, a fingerprint
#: differs in 10 bits of 64 on average; with two of them, 0.94 of such pairs are found, and 0.99 with a similarity of 0.85.
SIGNATURES = 2
BUDGET = Budget(11, 8, leaf=32)
#: Members of a bucket that are held against each other at once.
BLOCK = 128
#: Shingles that are counted at once.
COLUMNS = 1 << 13


#: Words whose hashes a worker remembers before it forgets all and starts again.
REMEMBERED = 500_000


class _Hashes(dict):
    """The XXH64 of each word that was asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Distinct hashes of the n-word shingles of an A-Z lower-cased text, ascending; fewer than n words: of the whole sequence. A shingle's hash is made of its words' hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = memory_of("near").setdefault("words", _Hashes())
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = max(1, len(w) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(min(n, len(w))):
        h = (h ^ w[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes; 0 if one is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def similar_pairs(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """Whether each pair of the sets is similar enough, as a symmetric matrix."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    column = (np.cumsum(n > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    both = np.zeros((len(sets), len(sets)))
    for k in range(0, int((n > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (k, k + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - k] = 1
        both += has @ has.T
    return (both > 0) & (both >= similar * (sizes[:, None] + sizes - both) - 1e-9)


def fingerprints_of(hashes: np.ndarray) -> list[int]:
    """The fingerprints of a set of hashes, each of them mixed anew."""
    out = []
    for _ in range(SIGNATURES):
        out.append(majority(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(31)
    return out


_FPS = [f"fp{k}" for k in range(SIGNATURES)]
PRINTS = "node binary, " + ", ".join(f"{c} long" for c in _FPS)


def _prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *fingerprints_of(s)) for k, t in enumerate(as_bytes(batch.column(1))) if len(s := shingle_set(t, n))]
            at, *prints = zip(*found) if found else [()] * (1 + SIGNATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in prints)], ["node", *_FPS])

    return run


def _verified(n: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)))
            near = [jaccard(shingle_set(a, n), shingle_set(b, n)) >= similar - 1e-12 for a, b in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _block(n: int, similar: float, bits: int):
    def run(t: pa.Table) -> pa.Table:
        labels = t.column("label").to_pylist()
        node, links = t.column("node"), np.empty((0, 2), np.int64)
        if len(set(labels)) > 1:
            close = np.zeros((len(labels), len(labels)), bool)
            for c in _FPS:
                fp = t.column(c).to_numpy()
                close |= np.bitwise_count((fp[:, None] ^ fp).view(np.uint64)) <= bits
            i, j = np.nonzero(np.triu(similar_pairs([shingle_set(x, n) for x in as_bytes(t.column("text"))], similar) & close, 1))
            tree = np.arange(len(labels))
            _merge(tree, i, j)
            moved = np.flatnonzero(tree != np.arange(len(tree)))
            links = np.stack((moved, tree[moved]), 1)
        return pa.table({"a": node.take(pa.array(links[:, 0])), "b": node.take(pa.array(links[:, 1]))})

    return run


def _groups(prints: DataFrame, budget: Budget) -> DataFrame:
    """(key, node): groups such that two nodes with a fingerprint within the budget share one."""
    found = []
    for k, c in enumerate(_FPS):
        kinds = written(prints.groupBy(F.col(c).alias("fp")).agg(F.count(F.lit(1)).alias("n")), "print-kinds")
        equal = kinds.filter("n > 1").select(F.xxhash64("fp", F.lit("equal")).alias("key"), "fp")
        groups = trie_groups(kinds.select("fp"), budget).unionByName(equal)
        found.append(groups.join(prints.select("node", F.col(c).alias("fp")), "fp").select(F.xxhash64("key", F.lit(k)).alias("key"), "node"))
    return reduce(DataFrame.unionByName, found)


def near_links(rows: DataFrame, n: int = WORDS_PER_SHINGLE, similar: float = SIMILAR, budget: Budget = BUDGET) -> DataFrame:
    """(a, b): links that join the texts of rows (node, text; equal texts have equal nodes) that are near enough, directly or by other links. Texts without a word have none."""
    spark = rows.sparkSession
    with small_batches(spark):
        prints = written(rows.mapInArrow(_prints(n), PRINTS).distinct(), "prints")
    held = written(_groups(prints, budget), "groups")
    hubs = held.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").select("key", "hub")
    # Most nodes meet in several tries, in groups that hardly differ: what has one smallest node is one group from here on.
    members = written(held.join(hubs, "key").select("hub", "node").distinct(), "members")
    texts = written(rows.join(small(members.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"]), "texts")
    of = lambda df, c: df.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in df.columns if x != "node"))
    close = reduce(Column.__or__, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) <= budget.bits for c in _FPS))
    stars = members.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(of(prints, "a"), "a").join(of(prints, "b"), "b").filter(close).select("a", "b")
    with small_batches(spark):
        links = written(stars.join(of(texts, "a"), "a").join(of(texts, "b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(n, similar), "a binary, b binary"), "stars")
    # A group of three or more in several components may hold links beside its star.
    named = written(members.join(components(links), "node", "left").select("hub", "node", F.coalesce("root", "node").alias("label")), "labels")
    buckets = named.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), (F.min("label") != F.max("label")).alias("parted"))
    parted = buckets.filter("parted and n > 2").select("hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        named.join(parted, "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "label")
    )
    more = dealt.join(texts, "node").join(prints, "node").groupBy("hub", "lo", "hi").applyInArrow(_block(n, similar, budget.bits), "a binary, b binary")
    return links.unionByName(written(more.distinct(), "more-links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS_PER_SHINGLE, similar: float = SIMILAR, budget: Budget = BUDGET) -> DataFrame:
    """Rows of docs without those of a group of near copies that don't have its smallest id; all columns of docs.

    A group is connected by links of texts whose sets of n-word shingles have a Jaccard similarity of at least `similar` and one of whose fingerprints lies
    within the budget. Equal texts are one group. Null texts count as empty, and a row with a null id stays unless its group has an id, or another text of the
    group without ids is first by digest. The rows that go are sent to the texts by broadcast as long as they are few, so that texts don't move."""
    spark = docs.sparkSession
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    node, own_node, own_id = F.unhex(F.md5(text)), *(f"{x}_{uuid.uuid4().hex}" for x in ("node", "id"))
    with passing(spark):
        ids = written(docs.select(node.alias("node"), id_.alias("id")).distinct(), "ids")
        with passing(spark):
            links = written(near_links(docs.select(node.alias("node"), text.alias("text")), n, similar, budget), "near-links", stays=True)
        comps = components(links)
        rooted = written(ids.join(comps, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "rooted")
        first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
        kept = (F.col("node") == F.col("first.node")) & F.col("id").eqNullSafe(F.col("first.id"))
        gone = written(rooted.join(first, "root").filter(~kept).select(F.col("node").alias(own_node), F.col("id").alias(own_id)), "gone", stays=True)
    # Not an equality, so that only texts whose ids meet are hashed again.
    same = (node >= F.col(own_node)) & (node <= F.col(own_node))
    named = docs.filter(id_.isNotNull()).join(small(gone.filter(F.col(own_id).isNotNull())), (id_ == F.col(own_id)) & same, "left_anti")
    return named.unionByName(docs.filter(id_.isNull()).join(small(gone.filter(F.col(own_id).isNull())), node == F.col(own_node), "left_anti"))
