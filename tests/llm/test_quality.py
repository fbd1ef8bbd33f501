import random
import re
from collections import Counter

import numpy as np

from sylvaframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(0, None, "en"), (1, "", None), (2, "\n\n \t", "xx"), (3, "a\x1cb\x85c \xa0d e" * 20, "fr"), (4, "wort " * 30_000, "de")]
    for k in range(5, 60):
        text = "".join(rng.choice(["the", "a|b", "é$", "###", "ok"]) + rng.choice([" ", "  ", "\n", "\n\n"]) for _ in range(rng.randint(1, 300)))
        rows.append((k, text, rng.choice(["en", "de", None])))
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(text), i
        assert not (r.base_failed and r.kept)


def test_filter_and_bands(spark):
    prose = "In the morning the two engineers walked along the river and talked about the plan for the new bridge that the town had wanted for years " * 1
    good = prose + "because the old one had been closed since the flood and nobody could reach the market on the other side without a long detour through the hills and the forest"
    junk = " ".join("ᚠᚱᛒ" + chr(0x16A0 + k % 60) + str(k) for k in range(80))
    docs = spark.createDataFrame([(1, good, "en"), (2, junk, "en"), (3, good, None), (4, "short", "en")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 3]
    assert quality.keep_good(docs).columns == docs.columns
    assert [r.doc_id for r in quality.assess(docs).filter("kept").orderBy("doc_id").collect()] == [1, 3]
    assert quality.assess(docs.filter("false")).count() == 0


def test_words_encode_as_whole_texts():
    model = quality.fertility(quality.default_vocabulary())
    text = "The quick brown fox – jumps; naïve ᚠᚱ 12345"
    words = [w.encode() for w in text.split()]
    assert model.tokens(words).tolist() == model.model.encode(text)


def test_second_vocabulary():
    """Tokens a word under the byte-level vocabulary are those of the words with a space before them."""
    model = quality.fertility(quality.default_vocabulary())
    text = "The quick brown fox jumps naïve дом 12345 " * 3
    words = [w.encode() for w in text.split()]
    slots = model.memory.look_up(words)
    want = len(model.memory.second.encode_ordinary("".join(" " + w for w in text.split())))
    assert model.memory.seconds.data[slots].sum() == want
    long = ("x1" * 100_000).encode()
    assert quality.measure_text(long, "en", model)[0] == 1


def test_repeats_of_many_kinds():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.randrange(rng.choice([2, 5, 50])) * rng.choice([1, 2**30 // 60]) for _ in range(rng.randint(0, 60))]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        assert quality.repeat_words(np.array(words, np.int64)) == len({k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)})


def test_repeated_rows_and_null_ids(spark):
    text = "In the morning the two engineers walked along the river. " * 8
    docs = spark.createDataFrame([(None, text, "en", 1), (None, text, "en", 1), (3, text, "en", 1), (3, text, None, 1)], "doc_id long, text string, lang string, n_words int")
    rows = quality.assess(docs).collect()
    assert len(rows) == 4 and {(r.n_words, r.n_repeat_words) for r in rows} == {slow(text)[0:1] + slow(text)[4:5]}
    assert quality.keep_good(docs).columns == docs.columns


def test_scripts():
    assert [quality.script_of(t) for t in ("abcd дом", "дом", "12 !", "λόγος a")] == ["LATIN", "CYRILLIC", "", "GREEK"]
