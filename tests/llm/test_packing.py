import random
from collections import defaultdict

import numpy as np

from sylvaframe.llm import packing


def check(rows, lengths):
    """rows: (doc_id, piece, start, n_tokens, shard, bin, bin_offset, bin_length)"""
    bins = defaultdict(list)
    for r in rows:
        if r[5] is not None:
            bins[r[4], r[5]].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r[6])
        at = 0
        for r in pieces:
            assert r[6] == at
            at += r[3]
        assert {r[7] for r in pieces} == {min(x for x in lengths if x >= at)}
    return bins


def slow_cheapest(size, rest, lengths, overhead):
    """The least cost of a token in a bin that gets what is left and can fit, once it is downsized; of equal costs the shortest length."""
    def cost(length):
        filled = size + min(length - size, sum(x for x in rest if x <= length - size))
        return (min(x for x in lengths if x >= filled) + overhead) / filled

    return min((x for x in lengths if x >= size), key=lambda x: (round(cost(x), 10), x))


def test_pack_is_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample([8, 16, 20, 32, 64], rng.randint(1, 4)))
        sizes = [rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 200))]
        bins, offsets, final = packing.pack(sizes, lengths, 2)
        # Replay: each piece, longest first, went to the fullest bin that could hold it.
        room = {}
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = [(r, b) for b, r in room.items() if r >= sizes[k]]
            if fit:
                assert room[bins[k]] == min(fit)[0]
            else:
                assert bins[k] not in room
                room[bins[k]] = slow_cheapest(sizes[k], [sizes[j] for j in range(len(sizes)) if (-sizes[j], j) > (-sizes[k], k)], lengths, 2)
            room[bins[k]] -= sizes[k]
        check([(0, 0, 0, s, 0, b, o, f) for s, b, o, f in zip(sizes, bins, offsets, final)], lengths)


def test_several_lengths_cost_less_than_one():
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(0.9) * 40) % 8192 + 1 for _ in range(3000)]
    cost = lambda lengths: sum({b: f + packing.OVERHEAD for b, f in zip(*[packing.pack(sizes, lengths)[k] for k in (0, 2)])}.values())
    assert cost(packing.LENGTHS) <= min(cost((8192,)), cost((512, 8192)))
    assert cost(packing.LENGTHS) < 1.06 * sum(sizes)


def test_whole_table(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "w " * 20_000] + ["x " * rng.randint(1, 900) for _ in range(200)]
    docs = spark.createDataFrame([(k % 150, t, 5) for k, t in enumerate(texts)] + [(None, "a b", 1)], "doc_id long, text string, bin int")
    for per_shard in (30, 10_000):
        rows = [tuple(r) for r in packing.pack_documents(docs, per_shard=per_shard).collect()]
        check(rows, packing.LENGTHS)
        want, got = defaultdict(int), defaultdict(int)
        for k, t in [(k % 150, t) for k, t in enumerate(texts)] + [(None, "a b")]:
            want[k] += len((t or "").split()) + 1
        for r in rows:
            got[r[0]] += r[3]
        assert got == want
    assert packing.pack_documents(docs.filter("false")).count() == 0


def test_no_tokens(spark):
    rows = packing.best_fit(spark.createDataFrame([(1, 0), (2, None), (3, 5)], "doc_id long, n_tokens long")).collect()
    assert {(r.doc_id, r.n_tokens, r.bin) for r in rows} == {(1, 0, None), (2, 0, None), (3, 5, 0)}


def test_query_packs_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from sylvaframe.llm import queries, token_files

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    texts = [None, "", "unbelievably tokenised words", "漢字" * 6000, "QUJD" * 9000, "a b " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in queries.op10_packing(spark, str(tmp_path)).collect()]
    check(rows, packing.LENGTHS)
    got = defaultdict(int)
    for r in rows:
        got[r[0]] += r[3]
    alone = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    manifest = token_files.write_and_read(alone)
    assert got == {r.doc_id: r.n_tokens for r in manifest.collect()}
    assert got[2] == len(tokenizer.encode("unbelievably tokenised words", add_special_tokens=False).ids) + 1
    assert got[3] > 8192


def test_sequences(spark):
    from tokenizers import Tokenizer

    from sylvaframe.llm import token_files

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    rng = random.Random(6)
    texts = {k: " ".join(rng.choice(["alpha", "beta", "gammas", "delta-force"]) for _ in range(rng.randint(0, 300))) for k in range(60)} | {99: "long words here " * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    placed = packing.best_fit(packing.token_lengths(docs), per_shard=20)
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, token_files.END_ID] for k, t in texts.items()}
    pieces = {(r.shard, r.bin, r.doc_id): r for r in placed.collect()}
    seen = defaultdict(list)
    for r in packing.sequences(docs, placed, padding=-1).collect():
        assert len(r.ids) == r.length in packing.LENGTHS
        end = 0
        for d, at in zip(r.doc_ids, r.starts):
            p = pieces[r.shard, r.bin, d] if len([x for x in r.doc_ids if x == d]) == 1 else None
            assert at == end
            n = p.n_tokens
            assert r.ids[at : at + n] == want[d][p.start : p.start + n]
            seen[d].append((p.start, n))
            end = at + n
        assert set(r.ids[end:]) <= {-1}
    assert {d: sum(n for _, n in x) for d, x in seen.items()} == {d: len(x) for d, x in want.items()}
