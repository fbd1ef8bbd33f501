"""Quality rules: word statistics and tokeniser fertility.

Fertility is measured with two public vocabularies: a SentencePiece model with byte
fallback, and a byte-level one for many languages. Each white-space-delimited word is
encoded once per Python worker under both, and a text's figures are sums over its words.
Characters per token under both, the share of byte-fallback tokens and the entropy of
the text's tokens must lie in the band of the text's language, or of its main script
where the language has no band of its own.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, memory_of
from .words import Growing, WordMemory, flattened

VOCABULARY, SECOND = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Characters of a word that the second vocabulary encodes at once.
AT_ONCE = 256
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Words whose pieces a Python worker remembers; beyond it, it forgets all and starts again.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Band:
    """Limits beyond which a text is rejected: characters per token under either vocabulary, share of byte tokens, and entropy over the most that as many tokens could have."""

    least_chars: tuple[float, float]
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Characters per token of clean prose under the two vocabularies: medians over rows of label quality 1 whose crc32(doc_id) is even.
TYPICAL = {"en": (2.22, 2.23), "de": (2.24, 2.31), "fr": (1.98, 2.04), "es": (1.94, 2.06)}
#: A text of these languages is rejected if its characters per token fall below this share of the typical ones.
LEAST_SHARE = 0.88
LANGUAGE_BANDS = {lang: Band(tuple(round(LEAST_SHARE * x, 3) for x in typical), 6.5, 0.10, 0.42) for lang, typical in TYPICAL.items()}
#: Bands per script, by the first word of the Unicode names of its letters. No rows of other scripts were at hand; these limits only catch texts that are mostly bytes to both vocabularies.
SCRIPT_BANDS = {
    "LATIN": Band((1.15, 1.15), 7.0, 0.15, 0.40),
    "CYRILLIC": Band((1.00, 1.00), 7.0, 0.15, 0.40),
    "GREEK": Band((0.80, 0.50), 7.0, 0.30, 0.40),
    "CJK": Band((0.40, 0.30), 4.0, 0.80, 0.35),
    "HIRAGANA": Band((0.40, 0.30), 4.0, 0.80, 0.35),
    "KATAKANA": Band((0.40, 0.30), 4.0, 0.80, 0.35),
    "HANGUL": Band((0.35, 0.30), 5.0, 0.90, 0.35),
    "ARABIC": Band((0.60, 0.50), 6.5, 0.60, 0.35),
    "HEBREW": Band((0.55, 0.45), 6.5, 0.70, 0.35),
    "DEVANAGARI": Band((0.35, 0.30), 6.5, 0.95, 0.35),
    "THAI": Band((0.35, 0.30), 6.5, 0.95, 0.35),
}
#: The band of every other script, for which the vocabularies may have bytes only.
OTHER_BAND = Band((0.25, 0.25), 8.0, 1.0, 0.35)

_SPACES = b" \t\n\r\x0b\x0c"


class _Words(WordMemory):
    """Words under the first vocabulary, and the number of their tokens under the second."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        super().__init__(lambda words, _: self._encode(words), most_words=REMEMBERED)

    def forget(self) -> None:
        super().forget()
        self.seconds = Growing(np.int32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        count = self.second.encode_ordinary
        # Very long words are counted in parts, as the second library's time grows with the square of their length.
        n = [len(count(" " + t)) if len(t) <= AT_ONCE else sum(len(count(t[k : k + AT_ONCE])) for k in range(0, len(t), AT_ONCE)) for t in texts]
        self.seconds.extend(np.array(n, np.int32))
        return flattened(self.first.encode(texts, num_threads=1))


class Fertility:
    """Tokens of words under both vocabularies, remembered per word."""

    def __init__(self, path: str, second: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])
        with open(second or public_tokenizers.path(SECOND), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.memory = _Words(self.model, tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """The ids of all words, each encoded on its own."""
        return self.memory.gather(self.memory.look_up(words))[0]

    def measure(self, slots: np.ndarray, word_chars: int) -> tuple[float, float, float, float]:
        """Characters per token under both vocabularies, share of byte tokens, entropy of the tokens over the most that they could have; slots are what the memory says of the words."""
        ids = self.memory.gather(slots)[0] if len(slots) else ()
        n = len(ids)
        if not n:
            return 0.0, 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        p = counts[counts > 0] / n
        most = math.log(min(n, len(self.is_byte)))
        seconds = int(self.memory.seconds.data[slots].sum())
        return word_chars / n, word_chars / max(1, seconds), float(self.is_byte[ids].sum()) / n, float(-(p * np.log(p)).sum()) / most if most else 0.0


def fertility(path: str) -> Fertility:
    """The vocabulary at path, loaded once per Python worker."""
    loaded = memory_of("quality")
    if path not in loaded:
        loaded[path] = Fertility(path)
    return loaded[path]


def script_of(text: str) -> str:
    """The commonest script of the letters in the whole text; '' without letters."""
    counts: dict[str, int] = {}
    chars: dict[str, int] = {}
    for c in text:
        chars[c] = chars.get(c, 0) + 1
    for c, n in chars.items():
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            counts[name] = counts.get(name, 0) + n
    return min(counts, key=lambda s: (-counts[s], s)) if counts else ""


def repeat_words(words: np.ndarray, n: int = 3) -> int:
    """Words, given as numbers, that lie in an n-word window found twice or more, the first one included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    window = words[:m].astype(np.int64)
    for k in range(1, n):
        # Windows of k words are numbered, so that one number and the next word make a key, however many words there are.
        window = np.unique(window, return_inverse=True)[1] if int(window.max()) >> 31 else window
        window = (window << 31) | words[k : k + m]
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    if len(count) == m:
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[at] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + n, -1)
    return int((np.cumsum(covered) > 0).sum())


def word_statistics(text: bytes, words: list[bytes], numbers: np.ndarray) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text, its words, and numbers that stand for them."""
    chars = b"".join(words)
    word_chars = len(chars) if chars.isascii() else len(chars.decode("utf-8", "replace"))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        dup = 0
    else:
        with_words = [x for x in lines if x.strip(_SPACES)]
        dup = len(with_words) - len(set(with_words))
    return word_chars, n_symbols, dup, repeat_words(numbers)


def band_of(lang: str | None, text: bytes) -> Band:
    if lang in LANGUAGE_BANDS:
        return LANGUAGE_BANDS[lang]
    return SCRIPT_BANDS.get(script_of(text.decode("utf-8", "replace")), OTHER_BAND)


def measure_text(text: bytes, lang: str | None, vocabulary: Fertility) -> tuple:
    """The figures and the verdict of one text, in the order of FIELDS after the id."""
    words = text.split()
    slots = vocabulary.memory.look_up(words)
    word_chars, n_symbols, dup, repeats = word_statistics(text, words, slots)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    chars, second, bytes_, entropy = vocabulary.measure(slots, word_chars)
    band = band_of(lang, text)
    good = all(least <= x <= band.most_chars for least, x in zip(band.least_chars, (chars, second))) and bytes_ <= band.most_bytes and entropy >= band.least_entropy
    return len(words), word_chars, n_symbols, dup, repeats, failed, not failed and good, chars, second, bytes_, entropy


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, chars_per_second double, byte_share double, token_entropy double"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def assess(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of docs: the word statistics, base_failed, kept, and the four fertility figures.

    vocabulary: path of a SentencePiece model (by default the public one) that is the same on all machines. Null texts count as empty and
    so fail for having too few words. lang_col may be None or a column that docs lacks or that is null: the script's band holds then.
    Rows are judged one by one, so repeated rows and ids repeat in the result; an empty table gives an empty result."""
    path = vocabulary or default_vocabulary()
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fertility(path)
        for batch in batches:
            found = [measure_text(t, x, model) for t, x in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
            columns = list(zip(*found)) if found else [[] for _ in range(11)]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return rows.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Rows of docs that assess keeps, with all columns of docs and in one pass: no join, so repeated ids are judged row by row."""
    path = vocabulary or default_vocabulary()
    names = docs.columns
    at, lang_at = names.index(text_col), names.index(lang_col) if lang_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fertility(path)
        for batch in batches:
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            yield batch.filter(pa.array([measure_text(t, x, model)[6] for t, x in zip(as_bytes(batch.column(at)), langs)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
