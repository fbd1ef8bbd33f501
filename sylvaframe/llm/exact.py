"""Exact duplicates against history: a minimal perfect hash over the distinct digests of a history.

The index has one row per shard of the digest space. A shard is a minimal perfect
hash (levels of bit arrays; what collides on one level goes to the next) with one
slot per digest that holds the full 32-byte digest, the id of its winner and the number
of its rows. A perfect hash gives a slot for non-members too, so each lookup compares
the whole digest, byte by byte. A member's group is its slot, which takes up the
member's rows; what doesn't match is a group of its own.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import small
from .common import SPACE, id_and_text, passing, written

#: Distinct digests that one shard of the index holds on average.
PER_SHARD = 200_000
#: Bits of a level per digest that is still to be placed.
GAMMA = 2.0


def _level_hash(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 32-byte digests (rows of four uint64) for one level: the words, mixed with the level's constant."""
    h = words[:, level % 4] ^ (words[:, (level + 1) % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 32-byte digests one to one to slots 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        counts = [int(x.sum()) for x in levels]
        self.base = np.concatenate(([0], np.cumsum(counts)))
        self.rank = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        words, levels = digests.view(np.uint64).reshape(-1, 4), []
        while len(words):
            size = max(8, math.ceil(GAMMA * len(words)))
            at = (_level_hash(words, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            words = words[~alone[at]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has a place for it."""
        words = digests.view(np.uint64).reshape(-1, 4)
        found = np.full(len(words), -1, np.int64)
        rest = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = (_level_hash(words[rest], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[rest[hit]] = self.base[k] + self.rank[k][at[hit]]
            rest = rest[~hit]
        return found

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes:
            width = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=int(size)).astype(bool))
            at += width
        return cls(levels)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each text with every run of ASCII white space replaced by one space; null counts as empty."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(_normalised(F.col("text")), 256)).alias("digest"))


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, slots, locators, counts) from rows (digest, winner, n) with distinct digests: per shard the perfect hash, and per slot 32 digest bytes, the winner's id and the number of rows."""

    def build(t: pa.Table) -> pa.Table:
        own = np.ascontiguousarray(_matrix(t.column("digest")))
        mph = PerfectHash.build(own)
        slot = mph.slots(own)
        kept, where, count = np.empty_like(own), np.empty(len(own), "<i8"), np.empty(len(own), "<i8")
        kept[slot], where[slot], count[slot] = own, t.column("winner").to_numpy(), t.column("n").to_numpy()
        blobs = {"hash": mph.dump(), "slots": kept.tobytes(), "locators": where.tobytes(), "counts": count.tobytes()}
        return pa.table({"shard": t.column("shard")[:1]} | {k: pa.array([x], pa.binary()) for k, x in blobs.items()})

    rows = history.select(_shard(shards), "digest", "winner", "n")
    return rows.groupBy("shard").applyInArrow(build, "shard int, hash binary, slots binary, locators binary, counts binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


FOUND = "digest binary, keep_id long, group_size long"


def look_up(rows: DataFrame, index: DataFrame, shards: int, with_history: bool) -> DataFrame:
    """FOUND: the group of each digest of rows (digest, least, n; distinct digests), and with_history, of each digest of the index.

    A digest that its slot holds joins the group of the slot's winner: the slot gets the smaller id and the sum of the rows. A digest that no slot
    holds is a group of its own."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.ascontiguousarray(_matrix(left.column("digest")))
        least, n = left.column("least").fill_null(NO_ID).to_numpy(), left.column("n").to_numpy()
        slot, member = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        kept, where, count = np.empty((0, 32), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(right):
            mph = PerfectHash.load(right.column("hash")[0].as_py())
            kept = np.frombuffer(right.column("slots")[0].as_py(), np.uint8).reshape(-1, 32)
            where, count = (np.frombuffer(right.column(c)[0].as_py(), "<i8").copy() for c in ("locators", "counts"))
            slot = mph.slots(own)
            member = (slot >= 0) & (kept[slot] == own).all(axis=1)
        hit = slot[member]  # digests are distinct, so are these slots
        where[hit] = np.minimum(where[hit], least[member])
        count[hit] += n[member]
        shown = np.arange(len(kept)) if with_history else hit
        keep_id = np.concatenate((where[shown], least[~member]))
        digest = pa.array(list(map(bytes, np.concatenate((kept[shown], own[~member])))), pa.binary())
        return pa.table({"digest": digest, "keep_id": pa.array(keep_id, pa.int64(), mask=keep_id == NO_ID), "group_size": pa.array(np.concatenate((count[shown], n[~member])), pa.int64())})

    rows = rows.select(_shard(shards), "digest", "least", "n")
    return rows.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, FOUND)


#: Winner of a digest whose rows all have a null id; any id is smaller.
NO_ID = 2**63 - 1
#: A group with more than this share of the rows, and more rows than HOT_ROWS, goes to its rows by broadcast: at most 1 / HOT_SHARE groups.
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def _to_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (doc_id, digest) with the columns of their digest's group. The commonest digests are few and are broadcast, so no task gets all rows of one."""
    most = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot, rest = groups.filter(F.col("group_size") > most), groups.filter(F.col("group_size") <= most)
    marked = rows.join(F.broadcast(hot), "digest", "left")
    return marked.filter("group_size is not null").unionByName(marked.filter("group_size is null").select("doc_id", "digest").join(rest, "digest"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs, dropped ones too.

    history: earlier rows with the same two columns, whose digests make the index; they are counted in group_size and can win, but aren't returned.
    Without it the older half of docs (ids up to the median) is the history of the newer half, and both are returned.
    keep_id is the smallest id of the rows with an equal normalised text. Null texts count as empty. Rows with a null id never win over a row
    with one; a group without any id has a null keep_id and kept false. Rows that repeat an id and its text are all kept. Empty tables give empty results."""
    all_rows = written(digests(docs, id_col, text_col), "digests")
    if history is None:
        pivot = all_rows.agg(F.percentile_approx("doc_id", 0.5, 100)).first()[0]
        is_old = F.col("doc_id") <= F.lit(pivot) if pivot is not None else F.lit(False)
        old, new = all_rows.filter(is_old), all_rows.filter(~F.coalesce(is_old, F.lit(False)))
    else:
        old, new = digests(history, id_col, text_col), all_rows
    grouped = lambda df: df.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    past, fresh = written(grouped(old), "past"), written(grouped(new), "fresh")
    shards = max(1, math.ceil(max(past.count(), fresh.count()) / per_shard))
    index = written(build_index(past.select("digest", F.coalesce("least", F.lit(NO_ID)).alias("winner"), "n"), shards), "index")
    groups = written(look_up(fresh, index, shards, history is None), "groups")
    return _to_rows(all_rows, groups).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that dedup keeps; all columns of docs.

    Rows without an id stay if no row with an id has their text, one for each text. Rows that repeat an id and its text are one document and stay.
    The rows that go are the fewer ones; they are sent to the texts by broadcast as long as they are few, so that texts don't move."""
    with passing(docs.sparkSession):
        found = written(dedup(docs, id_col, text_col), "decided", stays=True)
    id_, sha, own = F.col(f"`{id_col}`").cast("long"), *(f"{x}_{uuid.uuid4().hex}" for x in ("sha", "id"))
    gone = small(found.filter("doc_id is not null and not kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct())
    text = F.sha2(_normalised(F.col(f"`{text_col}`").cast("string")), 256)
    # Not an equality, so that only texts whose ids meet are hashed again.
    same = (text >= F.col(sha)) & (text <= F.col(sha))
    named = docs.filter(id_.isNotNull()).join(gone, (id_ == F.col(own)) & same, "left_anti")
    free = small(found.filter("doc_id is null and keep_id is null").select(F.col("text_sha256").alias(sha)).distinct())
    nameless = docs.filter(id_.isNull()).withColumn(own, text).join(free, F.col(own) == F.col(sha), "left_semi").dropDuplicates([own]).drop(own)
    return named.unionByName(nameless)
