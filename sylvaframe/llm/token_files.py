"""Token ids in fixed-width binary files.

A file holds ids packed in the fewest bits that the vocabulary needs, in blocks of
BLOCK_IDS ids. Its footer holds the offset of each block and, for each document, its
id and the number of its ids, so any run of ids unpacks with numpy from the blocks it
touches. Documents are in ascending id order within a file and from file to file.

    "SYLTOK01" | blocks | int64 block offsets | int64 doc ids | int64 ids per document |
    int64 x 6: bits, ids per block, number of ids, blocks, documents, documents with a null id (they come first) | int64 footer offset | "SYLTOK01"

Each white-space-delimited chunk of a text is encoded once per Python worker by the
tokenizers library and remembered.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_and_text, memory_of, partitions_for, scratch, trim, written
from .words import MOST_WORDS, WordMemory, flattened, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"SYLTOK01"
BLOCK_IDS = 1 << 16
#: Ids after which a file ends at the next document.
FILE_IDS = 1 << 27


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids that pack made raw of, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes one file; at first under another name, so a file that exists is whole."""

    def __init__(self, fs, path: str, bits: int):
        self.fs, self.path, self.bits = fs, path, bits
        self.out = fs.open_output_stream(path + ".part")
        self.out.write(MAGIC)
        self.at, self.offsets, self.n_ids, self.nulls = len(MAGIC), [], 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.docs: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, n: int) -> None:
        """A document of n ids, which write() gets."""
        self.nulls += doc_id is None
        self.docs.append(0 if doc_id is None else doc_id)
        self.sizes.append(n)

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK_IDS:
            every = np.concatenate(self.held)
            whole = len(every) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(every[k : k + BLOCK_IDS])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = [np.array(x, "<i8").tobytes() for x in (self.offsets, self.docs, self.sizes, (self.bits, BLOCK_IDS, self.n_ids, len(self.offsets), len(self.docs), self.nulls), (self.at,))]
        self.out.write(b"".join(footer) + MAGIC)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(64, size - 64)
        if tail[-8:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.bits, self.per_block, self.n_ids, n_blocks, n_docs, nulls, footer = map(int, np.frombuffer(tail, "<i8", 7))
        every = np.frombuffer(self.file.read_at(size - 64 - footer, footer), "<i8")
        self.offsets = np.append(every[:n_blocks], footer)
        ids = every[n_blocks : n_blocks + n_docs].tolist()
        self.doc_ids = [None] * nulls + ids[nulls:]
        self.sizes = every[n_blocks + n_docs :]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids start..stop of the file."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.per_block, (stop - 1) // self.per_block + 1
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        n = min(self.n_ids, b * self.per_block) - a * self.per_block
        if self.per_block * self.bits % 8:
            raise ValueError("a block must end at a byte")
        return unpack(raw, self.bits, n)[start - a * self.per_block : stop - a * self.per_block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.sizes[k]))


# The tokenizer's splitting pattern and byte alphabet, for Latin-1 letters. Fixed values that its file states. A new line stands between chunks.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_PRETOKEN = re.compile(f"\\n|'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\n{_L}{_N}]+")
#: What only the whole tokenizer encodes: beyond Latin-1, control characters, further white space, special tokens.
_ODD = re.compile("[^\n\x21-\x7e\xa1-\xff]|<\\|")


def _byte_alphabet() -> dict[int, str]:
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Mismatch(Exception):
    """The tokenizer divides pieces otherwise than expected."""


class ChunkEncoder:
    """Encodes white-space-delimited chunks with a tokenizer file as whole texts are encoded.

    The tokenizer's normaliser and splitter work chunk by chunk, so plain Latin chunks are normalised and split here, many at a time, and
    the library's BPE model encodes the distinct pieces; every other chunk, and all chunks of a call that the model divides otherwise, go through
    the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary_size = self.whole.get_vocab_size()
        # Only the one field is read: all of the file as Python objects would take some 100 MB.
        with open(path) as f:
            suffix = json.loads(re.search(r'"end_of_word_suffix"\s*:\s*("(?:[^"\\]|\\.)*")', f.read())[1])
        ends = np.zeros(self.vocabulary_size, bool)
        for piece, k in self.whole.get_vocab().items():
            ends[k] = piece.endswith(suffix)
        self.ends, self.alphabet = ends, _byte_alphabet() | {10: " "}
        self.pieces = WordMemory(self._encode_pieces, most_words=250_000)

    def _encode_pieces(self, pieces: list[str], _: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: they are encoded as words of one text, and an id that ends a word ends a piece. A new line has none."""
        sizes = np.zeros(len(pieces), np.int64)
        flat = []
        real = [k for k, p in enumerate(pieces) if p != "\n"]
        for a in range(0, len(real), 256):
            part = real[a : a + 256]
            text = "\n".join([pieces[k] for k in part]).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.model.encode(text, add_special_tokens=False).ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise _Mismatch
            sizes[part] = np.diff(cuts, prepend=0)
            flat.append(ids)
        return np.concatenate(flat) if flat else np.empty(0, np.int32), sizes

    def _plain(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n chunks of Latin-1 that new lines divide."""
        parts = _PRETOKEN.findall(text.lower() + "\n")
        ids, sizes = self.pieces.gather(self.pieces.look_up(parts))
        ends = np.cumsum(sizes)[[k for k, p in enumerate(parts) if p == "\n"]]
        if len(ends) != n:
            raise _Mismatch
        return ids, np.diff(ends, prepend=0)

    def __call__(self, todo: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not todo:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        text = b"\n".join(todo).decode("utf-8", "replace")
        try:
            return self._encode(text, len(todo))
        except _Mismatch:
            return flattened([e.ids for e in self.whole.encode_batch_fast([x.decode("utf-8", "replace") for x in todo], add_special_tokens=False)])

    def _encode(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not _ODD.search(text):
            return self._plain(text, n)
        chunks = text.split("\n")
        odd = [k for k, x in enumerate(chunks) if _ODD.search(x)]
        encoded = {k: e.ids for k, e in zip(odd, self.whole.encode_batch_fast([chunks[k] for k in odd], add_special_tokens=False))}
        plain = [x for k, x in enumerate(chunks) if k not in encoded]
        ids, sizes = self._plain("\n".join(plain), len(plain)) if plain else (np.empty(0, np.int32), np.empty(0, np.int64))
        found = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else ())
        return flattened([encoded[k] if k in encoded else next(found).tolist() for k in range(len(chunks))])


_END = b" "  # no chunk is white space, so this key stands for the end of a document


def encoder(path: str, most_words: int = MOST_WORDS) -> tuple[WordMemory, int]:
    """The chunk memory over the tokenizer at path, of at most most_words chunks, and its vocabulary's size, once per Python worker."""
    loaded = memory_of("token_files")
    if (path, most_words) not in loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own = ChunkEncoder(path)

        def encode(todo: list[bytes], _: list[int]) -> tuple[np.ndarray, np.ndarray]:
            at = todo.index(_END) if _END in todo else None
            if at is None:
                return own(todo)
            (x, n), (y, m) = own(todo[:at]), own(todo[at + 1 :])
            return np.concatenate((x, [END_ID], y)), np.concatenate((n, [1], m))

        loaded[path, most_words] = WordMemory(encode, most_words=most_words), own.vocabulary_size
        trim()
    return loaded[path, most_words]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encode_texts(texts: list[bytes], memory: WordMemory, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(index of the first text that ends here, ids, ids of each text that ends here): the ids of all texts in order, a part of bounded size at a time.

    Sizes of a text count all its ids, those of earlier parts included."""
    words: list[bytes] = []
    ended: list[int] = []  # positions of ends in words
    held, first, before = 0, 0, 0

    def flush() -> tuple[int, np.ndarray, list[int]]:
        nonlocal words, ended, held, first, before
        ids, sizes = memory.gather(memory.look_up(words))
        cum = np.cumsum(sizes)
        ends = cum[ended].tolist()
        each = [b - a for a, b in zip([-before, *ends[:-1]], ends)]
        before = int(cum[-1] if len(cum) else 0) - ends[-1] if ends else before + int(cum[-1] if len(cum) else 0)
        out = first, ids, each
        first += len(each)
        words, ended, held = [], [], 0
        return out

    for text in texts:
        for part in slices(text, most):
            words += part.split()
            held += len(part)
            if held >= most:
                yield flush()
        ended.append(len(words))
        words.append(_END)
    if words:
        yield flush()


MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, to: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes docs, appends END_ID to each document and writes files to the folder `to`; returns the manifest (part, file, path, n_docs, n_ids).

    Files follow each other in the order of (part, file), with ascending ids, rows without an id first; rows that share an id are ordered by text. Null
    texts count as empty and have END_ID alone. An empty table writes nothing. Each task writes files of new names and moves them into
    place when whole; the manifest names those of the tasks that succeeded, so lost executors and repeated tasks do no harm."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs
        from pyspark import TaskContext

        fs, root = arrow_fs.FileSystem.from_uri(to)
        part = TaskContext.get().partitionId()
        memory, vocabulary = encoder(path)
        bits = (vocabulary - 1).bit_length()
        writer, done = None, []

        def close() -> None:
            writer.close()
            done.append((part, len(done), writer.path, len(writer.docs), writer.n_ids))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, tokens, sizes in encode_texts(as_bytes(batch.column(1)), memory):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = Writer(fs, f"{root}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok", bits)
                writer.write(tokens)
                for k, n in enumerate(sizes):
                    writer.add(ids[first + k], n)
            if writer is not None and writer.n_ids >= file_ids:
                close()
                writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], [x.split()[0] for x in MANIFEST.split(", ")])

    rows = id_and_text(docs, id_col, text_col)
    dealt = rows.repartitionByRange(partitions_for(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(dealt.mapInArrow(run, MANIFEST), "manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files that the manifest names."""
    spark = manifest.sparkSession
    # One row per file; the files' sizes, summed up in their order, say where each begins.
    files = sorted(manifest.collect(), key=lambda r: (r.part, r.file))
    begins = np.cumsum([0, *(r.n_ids for r in files)]).tolist()
    listed = spark.createDataFrame([(k, r.path, b) for k, (r, b) in enumerate(zip(files, begins))], "k int, path string, begins long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        for batch in batches:
            for where, begin in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fs, name = arrow_fs.FileSystem.from_uri(where) if "://" in where else (arrow_fs.LocalFileSystem(), where)
                yield from _rows(Reader(fs, name), begin)

    return listed.repartition(max(1, len(files)), "k").mapInArrow(run, READ)


def _rows(reader: Reader, begin: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows of one file: runs of documents of up to `most` ids are read at once; a longer document in parts."""
    ends = reader.starts + reader.sizes
    k, n = 0, len(reader.doc_ids)
    while k < n:
        upto = max(k + 1, int(np.searchsorted(ends, reader.starts[k] + most, "right")))
        crcs = []
        if upto == k + 1:
            crc = 0
            for a in range(int(reader.starts[k]), int(ends[k]), most):
                crc = zlib.crc32(reader.ids(a, min(a + most, int(ends[k]))).astype("<u4").tobytes(), crc)
            crcs.append(crc)
        else:
            base = int(reader.starts[k])
            raw = memoryview(reader.ids(base, int(ends[upto - 1])).astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * (a - base) : 4 * (b - base)]) for a, b in zip(reader.starts[k:upto].tolist(), ends[k:upto].tolist())]
        columns = [pa.array(reader.doc_ids[k:upto], pa.int64()), pa.array(reader.starts[k:upto] + begin), pa.array(reader.sizes[k:upto]), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in READ.split(", ")])
        k = upto


def write_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """write_ids to a new place in the shared folder, and read_ids of what it wrote."""
    return read_ids(write_ids(docs, scratch(docs.sparkSession, "ids"), tokenizer_path))
