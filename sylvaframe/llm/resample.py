"""Importance resampling towards a target: which documents to draw so that their words are spread as the target's.

The tokenizers library's Split, an untrained rule, gives the words of a text with their
offsets. Windows of neighbouring offset pairs are the features; each falls into a bucket
by the CRC of its UTF-8 bytes. A table is written with one row a document: the buckets of
its features, two bytes each. Both histograms, and the gain of each bucket, have a fixed
size, so gains are broadcast, and a document's weight is the sum of the gains of its
buckets. Scores with a seeded noise of each id are ranked by sorted ranges.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import numbered
from .common import as_bytes, id_and_text, memory_of, small_batches, written

#: Words of a feature at least and at most, buckets, percent that is drawn, words that a document must have to be drawn, and seed of the noise.
SHORTEST, LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 1, 10_000, 10, 20, 2024
#: What separates words, after A-Z have been lower-cased: ASCII that is no digit and no letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that are split at once; a cut is made at a separator. Words whose bucket a worker remembers.
PIECE, REMEMBERED = 4096, 300_000

_SEPARATOR = re.compile(SEPARATORS)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(SEPARATORS), "removed")


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """(start, piece): the text in pieces of about `size` characters that begin at a separator, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        found = _SEPARATOR.search(text, at + size)
        if found is None:
            break
        yield at, text[at : found.start()]
        at = found.start()
    yield at, text[at:]


def offsets(text: str, split, size: int = PIECE) -> tuple[list[str], np.ndarray]:
    """Words of a text that is lower-cased already, and their offsets (rows: begin, end) in characters."""
    words, spans = [], []
    for start, piece in pieces(text, size):
        for word, (a, b) in split.pre_tokenize_str(piece):
            words.append(word)
            spans.append((start + a, start + b))
    return words, np.array(spans, np.int64).reshape(-1, 2)


class Features:
    """Buckets of all features of texts; words and windows are remembered with their buckets."""

    def __init__(self, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS):
        self.split, self.sizes, self.buckets, self.known = splitter(), range(shortest, longest + 1), buckets, {}

    def _bucket(self, feature: str) -> int:
        self.known[feature] = found = zlib.crc32(feature.encode()) % self.buckets
        return found

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, sorted bucket of each feature); windows are cut out by the offsets of their first and last word."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get, new, found, n = self.known.get, self._bucket, [], 0
        if self.sizes == range(1, 2):
            # A window of one word is the word; pieces are counted as they come, without a list of the whole text.
            for _, piece in pieces(text):
                words = [w for w, _ in self.split.pre_tokenize_str(piece)]
                n += len(words)
                found.append(np.fromiter((b if (b := get(w)) is not None else new(w) for w in words), np.int64, len(words)))
        else:
            _, spans = offsets(text, self.split)
            n = len(spans)
            for size in self.sizes:
                if n >= size:
                    windows = (_SEPARATOR.sub(" ", text[a:b]) for a, b in zip(spans[: n - size + 1, 0].tolist(), spans[size - 1 :, 1].tolist()))
                    found.append(np.fromiter((b if (b := get(w)) is not None else new(w) for w in windows), np.int64, n - size + 1))
        return n, np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, features) of rows (doc_id, text), written to the shared folder; features holds the sorted buckets, little-endian, of two bytes each up to 65,536 buckets, else of four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = memory_of("resample")
        if (key := (shortest, longest, buckets)) not in held:
            held.clear()
            held[key] = Features(shortest, longest, buckets)
        for batch in batches:
            found = [held[key].of(text.translate(_LOWER).decode("utf-8", "replace")) for text in as_bytes(batch.column(1))]
            sizes = pa.array([len(x) for _, x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), sizes, pa.array([x.astype(_kind(buckets)).tobytes() for _, x in found], pa.binary())], ["doc_id", "n_words", "n_features", "features"])

    with small_batches(docs.sparkSession):
        return written(docs.mapInArrow(run, "doc_id long, n_words long, n_features long, features binary"), "features")


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket has: at most one row a task and bucket is shuffled, and one a bucket collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in as_bytes(batch.column(0)):
                total += np.bincount(np.frombuffer(one, _kind(buckets)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(of_all: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths: the logarithm of its share in the target over its share in all, each with one more a bucket."""
    s, t, k = of_all.astype(np.float64), of_target.astype(np.float64), len(of_all)
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """features with weight instead of its buckets: the sum of the gains of a document's features."""
    sent, kind = features.sparkSession.sparkContext.broadcast(gain), _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = pa.array([int(sent.value[np.frombuffer(x, kind)].sum()) for x in as_bytes(batch.column("features"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), weight], ["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with score: the weight and a Gumbel noise in thousandths, drawn by a hash of seed and doc_id; a null id counts as no characters."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0).cast("double"))))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs: rank 1, 2, 3... for the `percent` of the rows with at least least_words words that have the highest scores, null for the others.

    target: rows with text_col whose spread of features is aimed at. Ties of scores go to the smaller id, and null ids come first; rows that repeat an
    id and its score are drawn in any order, each as a row of its own. Null texts have no words, no features and weight 0. Without a target or
    documents all gains are what empty histograms give."""
    texts = lambda df: df.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = featured(id_and_text(docs, id_col, text_col), shortest, longest, buckets)
    aim = featured(texts(target), shortest, longest, buckets)
    gain = gains(histogram(own, buckets), histogram(aim, buckets))
    rows = written(scored(weighted(own, gain), seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    shown = ("doc_id", "n_features", "weight", "score")
    # The row's number splits repeated rows between ranges.
    ranked = numbered(rows.filter(able), F.desc("score"), F.col("doc_id"), F.col("row"), name="place")
    in_order = ranked.select(*shown, F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))
    return in_order.unionByName(rows.filter(~able).select(*shown, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs' rows whose id resample draws, all columns; rows that share a drawn id come together."""
    found = resample(docs, target, id_col=id_col, text_col=text_col, **how).filter("rank is not null")
    own = f"drawn_{uuid.uuid4().hex}"
    return docs.join(found.select(F.col("doc_id").alias(own)).distinct(), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own)), "left_semi")


RESAMPLE_SQL = r"""
WITH RECURSIVE steps AS (SELECT k, 0 AS i, k AS c FROM range(256) t(k) UNION ALL SELECT k, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS tab FROM steps WHERE i = 8),
texts AS (SELECT doc_id, 0 AS target, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents UNION ALL SELECT NULL, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT doc_id, target, w, count(*) AS n FROM (SELECT doc_id, target, unnest(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts) WHERE w <> '' GROUP BY ALL),
bytes AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(tab[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
counts AS (SELECT bucket, sum(n) FILTER (WHERE target = 0) AS s, sum(n) FILTER (WHERE target = 1) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g FROM counts, total),
weights AS (SELECT doc_id, sum(n) AS n, sum(n * g) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) WHERE target = 0 GROUP BY doc_id),
scores AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
),
places AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM places
"""
