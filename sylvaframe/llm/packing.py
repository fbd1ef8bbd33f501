"""Best-fit packing of documents into sequences of several permitted lengths.

Each shard of the documents is packed on its own, longest piece first. A piece goes
to the open bin with the least room that still holds it. If none does, a bin is
opened whose size costs least for the tokens it can be expected to hold: the shard's
unplaced pieces are known, so a size is charged for the room that they can't fill.
At the end each bin shrinks to the smallest permitted length that holds its contents.

A document longer than the largest length is cut into pieces; no token is dropped.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_files
from .common import SPACE, as_bytes, id_and_text, small_batches, written

#: Permitted sequence lengths.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Tokens that a bin costs besides its length.
OVERHEAD = 16
#: Documents that one shard holds on average.
PER_SHARD = 8_000
#: Chunks whose ids a worker remembers in a pipeline: fewer than by default, as the last stage of a pipeline shares its executors with what earlier ones left.
REMEMBERED = 200_000


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): a token for each word and one that ends the document; null texts count as empty."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACE, " ")), " ")
    n = F.when(words[0] == "", 0).otherwise(F.size(words))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (n + 1).cast("long").alias("n_tokens"))


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, remembered: int = token_files.MOST_WORDS) -> DataFrame:
    """(doc_id, n_tokens): the ids that op3's encoder gives the text and one that ends the document; null texts count as empty. A worker remembers the ids of at most `remembered` chunks."""
    path = tokenizer_path or token_files.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, _ = token_files.encoder(path, remembered)
        for batch in batches:
            sizes = [n for _, _, each in token_files.encode_texts(as_bytes(batch.column(1)), memory) for n in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def cheapest(size: int, ascending: np.ndarray, left: int, sums: np.ndarray, lengths: Sequence[int], overhead: int) -> int:
    """The length to open for a piece of `size` tokens, with the smaller pieces ascending[:left] still to be placed; sums[n] is the sum of the n smallest."""
    best, least = lengths[-1], math.inf
    for length in lengths:
        if length < size:
            continue
        room = length - size
        # Room that pieces small enough could fill at most.
        filled = min(room, int(sums[min(left, int(np.searchsorted(ascending, room, "right")))]))
        # A bin that stays short is downsized at the end, so it costs the smallest length that holds what it can get.
        final = next(x for x in lengths if x >= size + filled)
        cost = (final + overhead) / (size + filled)
        if cost < least - 1e-12:
            best, least = length, cost
    return best


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; bins are numbered as they are opened. Every size lies in 1..max(lengths)."""
    lengths = sorted(lengths)
    order = np.lexsort((np.arange(len(sizes)), -np.asarray(sizes, np.int64)))
    ascending = np.sort(np.asarray(sizes, np.int64))
    sums, left = np.concatenate(([0], np.cumsum(ascending))), len(ascending)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    capacity: list[int] = []
    for k in order:
        size = int(sizes[k])
        left -= 1
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            number = len(capacity)
            room = cheapest(size, ascending, left, sums, lengths, overhead)
            capacity.append(room)
        bins[k], offsets[k] = number, capacity[number] - room
        if room > size:
            bisect.insort(rooms, (room - size, number))
    filled = np.zeros(len(capacity), np.int64)
    np.add.at(filled, bins, np.asarray(sizes, np.int64))
    final = np.asarray(lengths)[np.searchsorted(lengths, filled)] if len(filled) else filled
    return bins, offsets, final[bins] if len(filled) else filled[bins]


def cut(n_tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    return [(s, min(longest, n_tokens - s)) for s in range(0, n_tokens, longest)]


SCHEMA = "doc_id long, piece int, start long, n_tokens long, shard int, bin long, bin_offset long, bin_length long"


def best_fit(lengths_of: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, per_shard: int = PER_SHARD) -> DataFrame:
    """Rows (doc_id, n_tokens) placed in bins: one row per piece, with the bin (shard, bin), the place in it and its final length.

    Documents of null or no tokens get one piece of 0 tokens without a bin (bin, bin_offset and bin_length null). Rows that repeat an id are
    packed each. A shard holds a random part of the documents, so no key can fill one, and its result depends only on its rows."""
    top = max(lengths)
    with small_batches(lengths_of.sparkSession):
        rows = written(lengths_of.select("doc_id", "n_tokens"), "lengths")
    shards = max(1, math.ceil(rows.count() / per_shard))

    def run(t: pa.Table) -> pa.Table:
        ids, sizes = t.column("doc_id"), t.column("n_tokens").fill_null(0).to_numpy()
        keys = ids.fill_null(-(2**63)).to_numpy()
        order = np.lexsort((sizes, keys))
        pieces = [(row, p, s, n) for row in order for p, (s, n) in enumerate(cut(int(sizes[row]), top) or [(0, 0)])]
        row, piece, start, n = (np.array(x, np.int64) for x in zip(*pieces))
        filled = n > 0
        where = [np.zeros(len(n), np.int64) for _ in range(3)]
        for column, got in zip(where, pack(n[filled], lengths, overhead)):
            column[filled] = got
        mask = ~filled
        columns = [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(n), t.column("shard").take(pa.array(row)), *(pa.array(c, mask=mask) for c in where)]
        return pa.table(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(7)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, per_shard: int = PER_SHARD) -> DataFrame:
    """best_fit over the word lengths of docs, for consumers that count words; token_lengths is what sequences of ids need."""
    return best_fit(word_lengths(docs, id_col, text_col), lengths, overhead, per_shard)


def sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, padding: int = 0) -> DataFrame:
    """(shard, bin, length, ids, doc_ids, starts): the packed sequences themselves, from docs and what best_fit gave for them; ids has `length` entries, the last ones padding.

    doc_ids and starts name the documents of a sequence and where they begin in it. Ids of docs must not be null or repeat."""
    path = tokenizer_path or token_files.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, _ = token_files.encoder(path)
        for batch in batches:
            flat, sizes = [np.empty(0, np.int32)], []
            for _, ids, each in token_files.encode_texts(as_bytes(batch.column(1)), memory):
                flat.append(ids)
                sizes += each
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32()))], ["doc_id", "ids"])

    tokens = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")
    pieces = placed.filter("bin is not null").join(tokens, "doc_id").withColumn("ids", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")))
    row = F.struct("bin_offset", "doc_id", "ids")
    bins = pieces.groupBy("shard", "bin", F.col("bin_length").alias("length")).agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a bin holds at most the largest length
    ids = F.flatten("rows.ids")
    return bins.select(
        "shard", "bin", "length", F.concat(ids, F.array_repeat(F.lit(padding), (F.col("length") - F.size(ids)).cast("int"))).alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.bin_offset").alias("starts")
    )
