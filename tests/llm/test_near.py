import random

import xxhash

import corpus_pipeline
from sylvaframe.llm import near


def mixed(h):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * times % 2**64
    return h ^ (h >> 31)


def slow_hash(shingle):
    h = 0
    for word in shingle:
        h = (h ^ xxhash.xxh64_intdigest(word.encode())) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
    return h


def slow_prints(shingles):
    hashes = [slow_hash(s) for s in shingles]
    majority = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return majority(hashes), majority([mixed(h) for h in hashes])


def slow_kept(rows, n=5, similar=0.8, bits=11):
    """The smallest id of each group of texts that are similar and have a fingerprint within the bits; without bits: that are similar."""
    sets = []
    for _, t in rows:
        words = (t or "").split()
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    prints = [slow_prints(s) for s in sets] if bits is not None else None
    close = lambda a, b: bits is None or any((x ^ y).bit_count() <= bits for x, y in zip(prints[a], prints[b]))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]) and close(a, b) or rows[a][1] == rows[b][1]:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(min(g) for g in groups.values())


def corpus():
    """Families of one text with words replaced here and there, about the threshold on both sides."""
    rng = random.Random(8)
    texts = ["one", "one two", ""]
    for size, copies in [(60, 3), (150, 6), (300, 6), (300, 150), (700, 4)] + [(100, 2)] * 20:
        base = [rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(1, max(2, size // 25))):
                words[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return list(zip(rng.sample(range(10_000), len(texts)), texts))


def test_stage_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = slow_kept(rows)
    assert 30 < len(want) < len(rows) - 100
    every = slow_kept(rows, bits=None)
    assert len(rows) - len(want) >= 0.97 * (len(rows) - len(every))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __y string")
    for block in (128, 16):
        monkeypatch.setattr(near, "BLOCK", block)
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == want


def test_links_beside_the_star():
    """Links are found among members that are not similar to the first one."""
    sets = [near.shingle_set(" ".join(f"w{k}" for k in range(a, a + 200)).encode()) for a in (0, 60, 70, 130)]
    got = near.similar_pairs(sets)
    assert [(i, j) for i in range(4) for j in range(i) if got[i, j]] == [(i, j) for i in range(4) for j in range(i) if near.jaccard(sets[i], sets[j]) >= 0.8] == [(2, 1)]


def test_empty_and_null_ids(spark):
    assert near.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "other"), (None, "zz"), (None, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, near.drop_near_copies(docs).collect()), key=str)
    assert got == sorted([(4, "a b c d"), (4, "other"), (None, "zz"), (3, "")], key=str)
