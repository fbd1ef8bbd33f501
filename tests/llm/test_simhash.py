import random
import re

import numpy as np
import pytest
import xxhash
from sylvaframe.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k in range(len(fps)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least[find(k)] for k in range(len(fps))]


def corpus():
    rng = random.Random(5)
    texts = ["", None, "  \t", "one", "one TWO", "a b c", "A B C", "é\x85È x\x1cy z", "word " * 9000]
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400))
    for _ in range(60):
        words = base.split()
        words[rng.randrange(400)] = "new"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice("klmnop") * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return [(7 * k % 1009, t) for k, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    want = slow_components([i for i, _ in rows], fps)
    assert got == {i: (f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, want)}


def test_pairs_are_walked():
    """Links come from the walk over node pairs: the root pair is expanded down to single keys."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    keys = np.unique(np.concatenate((keys, keys[:500] ^ np.uint64(5), keys[100:300] ^ np.uint64(1 << 63))))
    before = simhash.steps_taken
    n = len(keys)
    label = simhash.trie_forest(keys, np.array([[0, n, 0, n, 0]]), np.zeros(1, np.int64), simhash.Budget(2))
    assert simhash.steps_taken - before >= 11
    near = np.bitwise_count(keys[:, None] ^ keys) <= 2
    want = np.arange(n)
    simhash._merge(want, *np.nonzero(np.triu(near, 1)))
    assert (label == simhash._flatten(want)).all()


@pytest.mark.parametrize("bits,turns", [(3, 1), (7, 4), (11, 8), (6, 3)])
def test_budgets(bits, turns):
    """Each pair within the bits is in a group of one of the tries, and joined by the forests of all tries."""
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 2**64, 40, dtype=np.uint64)
    keys = [int(c) for c in centre]
    for c in centre.tolist():
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 15), replace=False).tolist()
            keys.append(c ^ sum(1 << f for f in flips))
    keys = np.unique(np.array(keys, np.uint64))
    budget = simhash.Budget(bits, turns)
    found = np.arange(len(keys))
    for by in budget.turned():
        turned = ((keys << np.uint64(by)) | (keys >> np.uint64(64 - by))) if by else keys
        order = np.argsort(turned)
        label = simhash.trie_forest(turned[order], np.array([[0, len(keys), 0, len(keys), 0]]), np.zeros(1, np.int64), budget)
        simhash._merge(found, order, order[label])
    want = np.arange(len(keys))
    simhash._merge(want, *np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys) <= bits, 1)))
    assert (simhash._flatten(found) == simhash._flatten(want)).all()


@pytest.mark.parametrize("node_keys,at_once", [(50, 40), (5, 10_000), (1 << 16, 100)])
def test_dense_ball_and_split(spark, monkeypatch, node_keys, at_once):
    monkeypatch.setattr(simhash, "NODE_KEYS", node_keys)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    comps = {r.node: r.root for r in simhash.components(simhash.trie_links(spark.createDataFrame(signed, "fp long"))).collect()}
    want = slow_components([s for (s,) in signed], fps)
    assert [comps.get(s, s) for (s,) in signed] == want


def test_chain_of_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 100), (150, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 150: 100}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "zz")], "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id", "is_kept").collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, False)], key=str)


def test_nodes_are_dealt_as_lists(spark, monkeypatch):
    # They were shuffled as a row for each fingerprint and pair.
    monkeypatch.setattr(simhash, "_walked", lambda *_: lambda batches: (b.select(["keys"]) for b in batches))
    fps = spark.range(1000).select(simhash.F.xxhash64("id").alias("fp"))
    got = simhash._joined(fps, simhash.Budget(2), True, "keys array<long>")
    sizes = [len(r.keys) for r in got.collect()]
    assert sum(sizes) == 1000 and len(sizes) < 20
