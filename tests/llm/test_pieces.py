import random
import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvaframe.llm import pieces

PATH = pieces.default_vocabulary()


def library(text):
    return sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def slow_word(model, word, key, dropout):
    """Merges by scanning all pairs for the best one, without an agenda."""
    symbols = [(k, c) for k, c in enumerate(word.replace(" ", "▁"))]
    dead = set()
    while True:
        pairs = [(model.rank[a + b][0], i, n) for n, ((i, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in model.rank and (i, a + b) not in dead]
        if not pairs:
            return symbols
        _, i, n = min(pairs)
        union = symbols[n][1] + symbols[n + 1][1]
        if pieces.skipped(key, i, len(union), int(dropout * 2**32)):
            dead.add((i, union))
        else:
            symbols[n : n + 2] = [(i, union)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "tion", "é", "▁", "日", "\t", "ing"]), max_size=20).map("".join))
def test_no_dropout_is_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    model, memory = pieces.model_and_turns(PATH, 0.0)
    ids = pieces.encode_text(text, 3, memory, 1)
    if "▁" not in text:
        assert ids.tolist() == library(text)
    assert model.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 9))
def test_dropout_is_lossless(text, doc_id):
    text = text.encode("utf-8", "ignore").decode()
    model, memory = pieces.model_and_turns(PATH, 0.4)
    assert model.decode(pieces.encode_text(text, doc_id, memory)) == text.encode()


def test_agenda_is_best_first():
    model = pieces.PieceModel(PATH)
    rng = random.Random(1)
    for k in range(200):
        word = " " + "".join(rng.choice(["th", "er", "ion", "a", "e", "st", "n"]) for _ in range(rng.randint(1, 8)))
        for dropout in (0.0, 0.3):
            key = rng.getrandbits(64)
            want = [model.rank[s][1] for _, s in slow_word(model, word, key, dropout)]
            assert model.encode_word(word, key, int(dropout * 2**32)) == want


def test_many_words_at_once():
    model = pieces.PieceModel(PATH)
    rng = random.Random(9)
    words = ["", " ", "▁", "   ", "\n", "日本", "\0", "é" * 60, "ing" * 15] + [" " * rng.randint(0, 3) + "".join(rng.choice(["th", "er", "ion", "a", "é", "st", "▁", "ü", "!", "日"]) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    words = words * 3
    keys = np.random.default_rng(9).integers(0, 2**64, len(words), dtype=np.uint64)
    for dropout in (0.0, 0.2, 0.9):
        turns = pieces.Turns(model, dropout, most_turns=5000)
        for part in (slice(0, 500), slice(500, None), slice(None)):
            flat, sizes = turns.encode(words[part], keys[part])
            want = [model.encode_word(w, k, int(dropout * 2**32)) for w, k in zip(words[part], keys[part].tolist())]
            assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want


def test_whole_table(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "▁ a▁b", "tab\tend ", "x" * 20_000, "many words " * 60_000] + ["".join(rng.choice("abcdeé \n▁") for _ in range(rng.randint(0, 300))) for _ in range(50)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "a b", 0)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    model = pieces.PieceModel(PATH)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert rows[k].lossless and rows[k].n_bytes == len(raw) and rows[k].decoded_crc32 == zlib.crc32(raw)
        words = [w for part in pieces.split_words(t or "") for w in part]
        if len(words) < 500:
            keys = pieces.word_keys(k, 0, len(words), pieces.SEED)
            want = [i for w, x in zip(words, keys.tolist()) for i in model.encode_word(w, x, int(pieces.DROPOUT * 2**32))]
            assert rows[k].n_ids == len(want) and rows[k].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert rows[None].lossless
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    assert pieces.round_trip(docs.filter("false")).count() == 0


def test_dropout_varies():
    """Each occurrence has draws of its own: a frequent word gets many segmentations."""
    model, turns = pieces.model_and_turns(PATH, 0.1)
    same = [tuple(pieces.encode_text("international considerations " * 3, k, turns)) for k in range(8)]
    assert len(set(same)) > 1 and same[0] == tuple(pieces.encode_text("international considerations " * 3, 0, turns))
    keys = pieces.word_keys(1, 0, 20_000, 42)
    flat, sizes = turns.encode([" considerations"] * len(keys), keys)
    forms = {tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])}
    assert len(forms) > 20 and {model.decode(np.array([0, *f])) for f in forms} == {model.decode(np.array([0, *model.encode_word(" considerations")]))}


def test_repeated_rows(spark):
    rows = [(1, "many considerations of nations"), (1, "many considerations of nations"), (1, "another text"), (2, "many considerations of nations"), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, -1, True) for r in rows], "doc_id long, text string, n_ids int, lossless boolean")
    got = [tuple(r) for r in pieces.round_trip(docs, dropout=0.5).collect()]
    assert len(got) == 6 and len({r for r in got if r[0] == 1}) == 2 and all(r[5] for r in got)
    once = {tuple(r) for r in pieces.round_trip(docs.distinct(), dropout=0.5).collect()}
    assert set(got) == once and len(once) == 4
