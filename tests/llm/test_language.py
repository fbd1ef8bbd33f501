import zlib

import numpy as np
import pytest
import zstandard

from sylvaframe.llm import language as L

FOX = "the quick brown fox jumps over the lazy dog while she sells sea shells by the shore and nobody knows where the other children went that evening "
OSO = "el perro come la carne mientras los niños juegan en la calle y nadie sabe dónde están las otras personas que vinieron ayer por la tarde "
DOCS = "doc_id long, text string, lang string, score string, best string"


def rotated(base, k):
    words = base.split()
    return " ".join(words[k % len(words) :] + words[: k % len(words)])


def made(n=60):
    return [(k, rotated(FOX if k % 3 else OSO, k), "en" if k % 3 else "es", "a", "b") for k in range(n)]


def predicted(spark, rows, **how):
    return {r.doc_id: r for r in L.fit_and_identify(spark.createDataFrame(rows, DOCS), **how).collect()}


def test_null_empty_odd_and_repeated_texts(spark):
    odd = [(100, None, "en"), (101, "", "es"), (102, "12 + 34 = 46 !!", "en"), (103, "ʼ ٣٤", "en"), (104, FOX.upper(), "zz"), (105, "a", None), (None, OSO, "en"), (106, OSO * 20_000, None), (106, OSO * 20_000, None), (107, "中文 文字", "en")]
    rows = made() + [(*r, None, None) for r in odd]
    frame = spark.createDataFrame(rows, DOCS)
    got = L.fit_and_identify(frame).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 and not by_id[k].accepted for k in (100, 101, 102))
    # Ids 104 and more may be learned from or not; what has no language is never a class.
    assert by_id[106].lang_pred == "es" and by_id[106].accepted and by_id[None].lang_pred == "es" and not by_id[None].held_out
    assert sum(r.doc_id == 106 for r in got) == 2 and 0 <= min(r.score for r in got) and max(r.score for r in got) <= 1
    assert {r.held_out for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1} == {True}


def test_held_out_rows_teach_nothing(spark):
    rows = made()
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, a, b) for i, t, lang, a, b in rows]
    assert predicted(spark, rows) == predicted(spark, other)
    changed = [(i, t, lang, None, None) if zlib.crc32(str(i).encode()) % 3 != 1 else (i, t, None, "s", "t") for i, t, lang, _, _ in rows]
    assert predicted(spark, rows) == predicted(spark, changed)


def test_empty_table_no_languages_and_one_language(spark):
    assert predicted(spark, []) == {}
    assert {r.lang_pred for r in predicted(spark, [(k, FOX, None, None, None) for k in range(9)]).values()} == {"und"}
    one = predicted(spark, [(k, FOX, "en", None, None) for k in range(9)])
    assert {(r.lang_pred, r.score) for r in one.values()} == {("en", 1.0)}


def test_a_narrow_margin_rejects(spark):
    rows = made() + [(200, "zq", None, None, None)]
    got = predicted(spark, rows)
    assert got[200].lang_pred == "en" and not got[200].accepted  # the commoner of two equal ones
    assert all(got[k].accepted for k in range(60))


def test_sizes_are_those_of_plain_compression():
    contents = [x.encode() * 30 for x in (FOX, OSO)]
    text = (rotated(OSO, 5) * 90).encode()

    def plain(content):
        how = zstandard.ZstdCompressionParameters(window_log=19, chain_log=17, hash_log=17, search_log=3, min_match=3, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        held = b" " + text.strip() + b" "
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        frames = [zstandard.ZstdCompressor(compression_params=how, dict_data=words).compress(L.PAD + held[a : a + L.BLOCK]) for a in range(0, len(held), L.BLOCK)]
        back = zstandard.ZstdDecompressor(dict_data=words)
        assert b"".join(back.decompress(f, max_output_size=1 << 20)[len(L.PAD) :] for f in frames) == held
        return sum(map(len, frames))

    sizes = L.Sizes(contents)
    assert sizes.of(text).tolist() == [plain(c) for c in contents] == sizes.of(text).tolist()
    best, score = L.verdicts(np.array([[90, 100, 90], [640, 650, 700]]))
    assert best.tolist() == [0, 0] and score[0] == pytest.approx(1 / (2 + 2 ** -(10 / (90 / 64)))) and score[1] == pytest.approx(1 / (1 + 2**-1 + 2**-6))


def test_the_sample_is_bounded_and_copies_count_once(spark):
    rows = spark.createDataFrame([(FOX, "en")] * 500 + [(rotated(OSO, k), "es") for k in range(40)], "text string, lang string")
    learned = L.learn(rows, docs=5, excerpt=50, size=120)
    assert learned.names == ["en", "es"] and len(learned.contents[0]) == 50 and len(learned.contents[1]) == 120


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = L.fit_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, wrong = both.selectExpr("sum(int(lang = lang_pred))", "count(*)", "sum(int(accepted and lang <> lang_pred))").first()
    assert right >= 0.98 * n and wrong <= 0.01 * n
