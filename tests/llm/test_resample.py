import hashlib
import math
import random
import re
import zlib
from collections import Counter

from sylvaframe.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, rank string, n_words string"


def features(text, low, high):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, low=1, high=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, low, high)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        n, own = features(text, low, high)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(spark, docs, target, **how):
    frame = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in R.resample(frame, aim, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def made(n, seed=0):
    rng = random.Random(seed)
    words = ["Alpha", "béta", "GAMMA", "δέλτα", "x1", "0", "文字", "end", "É", "mid"]
    return [(k, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00", "`", "{"]) for _ in range(rng.randrange(60)))) for k in range(n)]


def test_against_brute_force(spark):
    docs = [*made(300), (300, None), (301, ""), (302, "@ [ ` {"), (None, "alpha " * 30), (303, "one")]
    target = [t for _, t in made(20, 5)] + [None, "alpha beta gamma"]
    assert found(spark, docs, target) == brute(docs, target)
    assert found(spark, docs, target, shortest=1, longest=3, buckets=500, percent=35, least_words=5, seed=7) == brute(docs, target, 1, 3, 500, 35, 5, 7)
    assert found(spark, docs, target, shortest=2, longest=2, buckets=70_000) == brute(docs, target, 2, 2, 70_000)


def test_repeated_rows_and_ids(spark):
    docs = [(5, "alpha beta " * 15)] * 40 + [(None, "gamma " * 25)] * 10 + [(k, "delta " * 30) for k in range(50)]
    assert found(spark, docs, ["delta"]) == brute(docs, ["delta"])


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    docs = made(40)
    assert found(spark, docs, []) == brute(docs, [])


def test_long_text_and_one_long_word(spark):
    docs = [(1, "ab " * 500_000), (2, "é" * 1_000_000), (3, "," * 300_000 + "x")]
    assert found(spark, docs, ["ab"]) == brute(docs, ["ab"])


def test_offsets_point_at_words():
    text = ("héllo, wörld-9 " * 900).strip()
    words, spans = R.offsets(text, R.splitter(), size=100)
    assert words == WORD.findall(text) and [text[a:b] for a, b in spans.tolist()] == words


def test_draw_returns_the_documents(spark):
    docs = spark.createDataFrame(made(200), "doc_id long, text string")
    target = spark.createDataFrame([("alpha alpha",)], "text string")
    ids = {r.doc_id for r in R.resample(docs, target).filter("rank is not null").collect()}
    assert ids and {r.doc_id for r in R.draw(docs, target).collect()} == ids


def test_drawn_words_are_nearer_to_the_target(spark):
    docs = [(k, ("wanted " if k % 5 == 0 else "other ") * 20 + "common " * 20) for k in range(400)]
    rows = found(spark, docs, ["wanted common"] * 30)
    drawn = [r for r in rows if r[4] is not None]
    assert len(drawn) == 40 and all(r[0] % 5 == 0 for r in drawn)
