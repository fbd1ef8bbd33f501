import random

from tokenizers import Tokenizer

import corpus_pipeline
from sylvaframe.llm import packing, quality, token_files

from .test_near import slow_kept
from .test_packing import check
from .test_quality import slow as slow_quality


def slow_cut(rows, length=50):
    where = {}
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - length + 1):
            where[raw[k : k + length]] = min(where.get(raw[k : k + length], i), i)
    out = []
    for i, t in rows:
        raw = t.encode()
        gone = set()
        for k in range(len(raw) - length + 1):
            if where[raw[k : k + length]] < i:
                gone |= set(range(k, k + length))
        out.append((i, bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")))
    return out


def slow_run(rows):
    model = quality.fertility(quality.default_vocabulary())
    rows = [(i, t or "") for i, t in rows if not slow_quality(t)[5] and quality.measure_text((t or "").encode(), "en", model)[6]]
    after_quality = len(rows)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(" ".join(t.replace("\n", " ").split(" ")) if "  " not in t else t, i)
    rows = [(i, t) for i, t in sorted(rows) if i in set(first.values())]
    after_exact = len(rows)
    kept = set(slow_kept(rows))
    rows = [(i, t) for i, t in rows if i in kept]
    assert after_quality > after_exact > len(rows) > 20
    return slow_cut(rows)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = "the of and to in is that for with was by this from have they which one were all their has would what will about when who make can more if no out so said".split()
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "ing", "er", "tion"]) for _ in range(n))
    shared = [sentence(25) for _ in range(4)]
    rows = []
    for k in range(60):
        body = sentence(rng.randint(80, 300))
        if k % 3 == 0:
            body += "\n" + rng.choice(shared) + "\n" + sentence(30)
        rows.append(body)
    rows += [rows[4], rows[5].replace(" ", "\n", 3), rows[7] + " end", "too short", None, "", "same words again " * 60]
    rows = list(zip(rng.sample(range(5000), len(rows)), rows))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    check(got, packing.LENGTHS)
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in slow_run(rows)}
    assert {r[0]: r[3] for r in got} == want
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert kept.columns == docs.columns
        kept = stage(spark, kept, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(slow_run(rows))


def test_empty_null_ids_and_clashing_names(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, shard int, __id long"
    prose = "In the morning the two engineers walked along the river and talked about the plan for a new bridge that the town had wanted for years because the old one was closed since the flood and nobody could reach the market on the other side without a long detour through hills and forest"
    other = " ".join(prose.split()[::-1])
    rows = [(None, prose, "en"), (None, prose, "en"), (1, other, "en"), (1, None, None), (None, "", None)]
    for name, data in (("empty", []), ("rows", [(*r, "s", 1, "k", "n", 0, 5) for r in rows])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()]
        assert sorted(str(r[0]) for r in got) == (["1", "None"] if data else [])


def test_very_long_text(spark, tmp_path):
    rng = random.Random(21)
    # Over so many words, few different ones would be too little entropy.
    vocabulary = "the of and to in is that for with was by this from have they which one were all their has would what will about when who make can more if no out so said".split()
    vocabulary += "time people year way day thing man world life hand part child eye woman place work week case point company number group problem fact water room mother area money story".split()
    vocabulary += "month study book word business issue side kind head house service friend father power hour game line member law car city name team idea body face level office door health person".split()
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "s", "ing"]) for _ in range(n))
    long, short = prose(100_000), prose(200)
    rows = [(1, long), (2, short), (3, long), (4, long + " end"), (5, prose(100) + " " + long[1000:1400])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    check(got, packing.LENGTHS)
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    of = {i: sum(r[3] for r in got if r[0] == i) for i in {r[0] for r in got}}
    # The exact copy and the near one go; of the last text, the passage that the first one has.
    assert of == {1: n(long), 2: n(short), 5: n(dict(slow_cut([(1, long[900:1500]), rows[4]]))[5])}
    assert sum(r[0] == 1 for r in got) == -(-n(long) // max(packing.LENGTHS))
