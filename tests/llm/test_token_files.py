import random
import zlib

import numpy as np
import pytest
from pyarrow import fs

from sylvaframe.llm import token_files as tf
from sylvaframe.llm.common import scratch
from sylvaframe.llm.words import WordMemory, flattened, slices


def texts():
    rng = random.Random(6)
    odd = ["", " ", "It's  the\tEND!!", "ÀÉîõü ß½²³ªº µ", "Σίσυφος ΟΔΟΣ", "日本語 ｶﾞ é́ ﬁ", "a\x85b\xa0c\x1cd", "<|endoftext|> x<|startoftext|>y", "we'll'S it'd've", "###***ab12cd", "İstanbul \xad soft", "x" * 3000]
    alphabet = "abcXYZéÜ'1²#.,-ñ \n\t "
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["word and Words, " * 100_000]


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.default_tokenizer())
    out, start = {}, 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_against_the_library(spark):
    rows = [(1000 - 7 * k, t) for k, t in enumerate(texts())] + [(5, None)]
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, start string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.write_and_read(docs).collect()}
    assert got == expected(rows)


def test_small_parts_and_files(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts()[:40])]
    to = scratch(spark, "ids")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tf.write_ids(docs, to, file_ids=50)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.read_ids(manifest).collect()}
    assert got == expected(rows)
    first = manifest.orderBy("part", "file").first()
    reader = tf.Reader(fs.LocalFileSystem(), first.path)
    assert reader.bits == 16 and reader.document(0).tolist()[-1] == 1


def test_no_rows_and_null_ids(spark):
    assert tf.write_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (2, "c c"), (2, "c c")], "doc_id long, text string")
    got = [tuple(r)[:3] for r in tf.write_and_read(docs).orderBy("start").collect()]
    assert got == [(None, 0, 2), (None, 2, 2), (2, 4, 3), (2, 7, 3)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31])
def test_bit_widths(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_000 * 2).astype(np.uint32)
    w = tf.Writer(fs.LocalFileSystem(), str(tmp_path / "f"), bits)
    w.write(ids[:100])
    w.write(ids[100:])
    w.add(3, 100)
    w.add(4, len(ids) - 100)
    w.close()
    r = tf.Reader(fs.LocalFileSystem(), str(tmp_path / "f"))
    assert (r.ids(0, len(ids)) == ids).all() and (r.ids(65_530, 65_540) == ids[65_530:65_540]).all() and (r.document(1) == ids[100:]).all()


def test_memory_forgets():
    m = WordMemory(lambda words, variants: flattened([[len(w), v] for w, v in zip(words, variants)]), 3, most_words=4)
    for k in range(20):
        words = ["a" * (k % 7), "b", "a" * (k % 7)]
        ids, sizes = m.gather(m.look_up(words, np.array([0, 1, 2])))
        assert ids.tolist() == [k % 7, 0, 1, 1, k % 7, 2] and sizes.tolist() == [2, 2, 2]


def test_slices():
    text = b"ab  cde\n" * 50
    assert b"".join(slices(text, 10)) == text
    assert [w for s in slices(text, 10) for w in s.split()] == text.split()
