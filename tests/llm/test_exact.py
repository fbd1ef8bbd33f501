import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sylvaframe.llm import exact

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def slow(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        norm = SPACE.sub(" ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i is not None and i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "\t\n", "a  b", "a b", "a\x0bb", "a\xa0b", "x" * 300_000] + [f"t {k % 40}" + " " * (k % 3) for k in range(200)]
    rows = [(rng.randrange(500), t) for t in texts] + [(None, "a b"), (None, "only here"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    for per_shard in (3, 200_000):
        assert sorted(map(tuple, exact.dedup(docs, per_shard=per_shard).collect()), key=str) == slow(rows)


def test_history(spark):
    history = spark.createDataFrame([(50, "a b"), (60, "c")], "doc_id long, text string")
    docs = spark.createDataFrame([(70, "a  b"), (71, "d"), (72, "d"), (10, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.dedup(docs, history=history).collect()}
    assert got == {70: (50, 2, False), 71: (71, 2, True), 72: (71, 2, False), 10: (10, 2, True)}


def test_empty(spark):
    assert exact.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 256, (5000, 32), np.uint8)
    mph = exact.PerfectHash.load(exact.PerfectHash.build(keys).dump())
    assert sorted(mph.slots(keys)) == list(range(5000))


def test_groups_come_from_the_slots(spark, monkeypatch):
    """Without the look-up, copies in the newer half would be groups of their own."""
    docs = spark.createDataFrame([(i, "same") for i in range(10)] + [(i, f"t{i}") for i in range(10, 20)], "doc_id long, text string")
    assert {r.group_size for r in exact.dedup(docs).filter("doc_id < 10").collect()} == {10}
    monkeypatch.setattr(exact.PerfectHash, "slots", lambda self, digests: np.full(len(digests), -1, np.int64))
    monkeypatch.setattr(exact, "build_index", lambda history, shards: spark.createDataFrame([], "shard int, hash binary, slots binary, locators binary, counts binary"))
    docs = docs.withColumn("doc_id", F.col("doc_id") * 7 % 20)
    assert {r.group_size for r in exact.dedup(docs).filter(f"text_sha256 = '{hashlib.sha256(b'same').hexdigest()}'").collect()} != {10}


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 3)
    rows = [(i, f"t{i % 7}" if i % 2 else "hot") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact.dedup(docs).collect()), key=str) == slow(rows)


def test_drop(spark, monkeypatch):
    rows = [(3, "b"), (7, "a"), (7, "b"), (None, "only"), (None, "only "), (None, "other"), (None, "other"), (None, "a"), (8, None), (9, ""), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, __kept int, digest string")
    for small in (exact.small, lambda df: df):
        monkeypatch.setattr(exact, "small", small)
        got = sorted([(r.doc_id, r.text) for r in exact.drop_duplicates(docs).collect()], key=str)
        assert got == sorted([(3, "b"), (7, "a"), (None, "only"), (None, "only "), (None, "other"), (8, None), (5, "x"), (5, "x")], key=str)
    assert exact.drop_duplicates(docs).columns == docs.columns
    assert exact.drop_duplicates(docs.filter("false")).count() == 0
