"""Language identification by compression: a text is in the language whose dictionary makes it smallest.

Each learned language has a zstandard dictionary of raw content: lower-cased letters of
sampled texts. A text is cut into blocks, and every block is compressed with every
dictionary, so each part of a long text counts alike and a text's own repetitions don't
replace the dictionary. The sizes are added up; the smallest sum wins, and a narrow
margin rejects.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, id_and_text, memory_of, small_batches, written

#: Documents that a language is learned from at most, characters that each gives at most, from a hashed place, and bytes of a dictionary.
DOCS, EXCERPT, DICTIONARY = 240, 600, 112 << 10
#: Bytes that are compressed at once, after spaces that keep a short block from being stored raw, which would hide its size.
BLOCK, PAD = 4096, b" " * 64
#: A score below this is a narrow margin: the language is rejected.
ACCEPT = 0.8
UNKNOWN = "und"
SEED = 11


def letters(text: Column) -> Column:
    """The text in lower case, with one space for all that isn't a letter or a mark of one."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def remainder(id_col: Column) -> Column:
    """crc32 of the id's text, modulo 3."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


@dataclass(frozen=True)
class Languages:
    """Learned languages, the commonest first, and the raw content of each one's dictionary."""

    names: list[str]
    contents: list[bytes]


def learn(rows: DataFrame, docs: int = DOCS, excerpt: int = EXCERPT, size: int = DICTIONARY) -> Languages:
    """Languages of rows (text, lang) that may be learned from: at most `docs` distinct texts of each, by a hash of the text, of which an excerpt is collected.

    Rows without a language or a letter are left out."""
    known = rows.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn("h", F.xxhash64("text", F.lit(SEED)))
    texts = written(known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")), "texts")
    counts = [(r.lang, r.n) for r in texts.groupBy("lang").agg(F.sum("n").alias("n")).collect()]  # one row a language
    chosen = texts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= docs).select("lang", "h")
    # At most `docs` rows a language; the excerpts are as many.
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("clean") - excerpt, F.lit(0)) + 1).cast("int") + 1
    clean = known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).withColumn("clean", letters(F.col("text")))
    found: dict[str, list] = {}
    for r in clean.select("lang", "h", F.substring("clean", place, F.lit(excerpt)).alias("x")).collect():
        found.setdefault(r.lang, []).append((r.h, r.x))
    names = [name for name, _ in sorted(counts, key=lambda c: (-c[1], c[0]))]
    return Languages(names, [b" ".join(x.encode() for _, x in sorted(found[name]))[:size] for name in names])


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that knows the content; matches are looked for from three bytes on, and a frame has no header fields of its own."""
    how = zstandard.ZstdCompressionParameters(window_log=19, chain_log=17, hash_log=17, search_log=3, min_match=3, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=words)


class Sizes:
    """Compressed sizes of texts with each of several dictionaries."""

    def __init__(self, contents: list[bytes]):
        self.compressors = [compressor(c) for c in contents]

    def of(self, text: bytes) -> np.ndarray:
        """The sum over the text's blocks for each dictionary; the text begins and ends with a space, as words do in a dictionary."""
        text = b" " + text.strip() + b" "
        total = np.zeros(len(self.compressors), np.int64)
        for a in range(0, len(text), BLOCK):
            block = PAD + text[a : a + BLOCK]
            total += np.fromiter((len(c.compress(block)) for c in self.compressors), np.int64, len(total))
        return total


def verdicts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best dictionary, score) of each row of sizes. Of equal sizes the first dictionary is best.

    The score is the best one's share, if each size counts half for every 64th part (or byte, of a size under 64) that it is over the smallest."""
    least = sizes.min(axis=1, keepdims=True)
    weight = np.exp2(-(sizes - least) / np.maximum(least / 64, 1.0))
    return sizes.argmin(axis=1), 1.0 / weight.sum(axis=1)


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row of docs: the language whose dictionary makes the whole text smallest.

    `und` with score 0 if the text is null or has no letter, or no language was learned. accepted is false for those and where the score is below
    `accept`. Texts of equal sizes go to the commonest language. held_out is false for a null id. Each row is judged on its own."""
    sent = docs.sparkSession.sparkContext.broadcast(languages.contents)
    name = uuid.uuid4().hex
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.when(has_letter(F.col("text")), letters(F.col("text"))).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = memory_of("language")
        if name not in held:
            held.clear()
            held[name] = Sizes(sent.value)
        for batch in batches:
            sized = [held[name].of(x) if x else None for x in as_bytes(batch.column(1))]
            at = [k for k, x in enumerate(sized) if x is not None and len(x)]
            best, score = np.full(len(sized), -1), np.zeros(len(sized))
            if at:
                best[at], score[at] = verdicts(np.array([sized[k] for k in at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(score, pa.float64())], ["doc_id", "best", "score"])

    with small_batches(docs.sparkSession):
        judged = written(rows.mapInArrow(run, "doc_id long, best int, score double"), "languages")
    names = F.array(*(F.lit(x) for x in languages.names)) if languages.names else F.array().cast("array<string>")
    predicted = F.coalesce(F.get(names, F.col("best")), F.lit(UNKNOWN))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), predicted.alias("lang_pred"), "score", ((F.col("best") >= 0) & (F.col("score") >= accept)).alias("accepted"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> Languages:
    """Languages learned from the rows that aren't held out; rows without an id or a language are left out."""
    known = docs.filter(remainder(F.col(f"`{id_col}`").cast("long")) != 1)
    return learn(known.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")), **bounds)


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """fit on the rows that may be learned from, and identify of all."""
    return identify(docs, fit(docs))
