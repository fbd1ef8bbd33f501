"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding works as a merge-type (BPE) SentencePiece model does: the agenda of a word
holds each adjacent pair whose union is a piece, and the best piece, leftmost first, is
merged until none is left. With dropout, a keyed hash of (seed, document, number of the
word in it, place, size) decides for each candidate that comes up whether it is skipped,
so each occurrence of a word has draws of its own, and they are the same in any task.

What the agenda of a word comes to depends on its draws alone. A worker remembers, for
each word, the tree of the draws that it has met, with the ids at its leaves; an
occurrence walks down by its own draws, and only a turn that no occurrence has taken
before runs an agenda. The agendas of many words advance together, in numpy.

What the vocabulary lacks becomes byte pieces, a literal lower-one-eighth block (the
model's own mark for a space) too, so decoding gives back every text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, id_and_text, memory_of
from .words import Growing, flattened, gather

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: The symbol of a literal SPACE; no piece holds NUL, so it never merges.
_LITERAL = SPACE + "\0"
SEED, DROPOUT = 42, 0.1
#: Characters of a text that are split into words at once.
PART = 1 << 20
#: Words that are looked up at once.
MANY_WORDS = 1 << 17
#: Turns and ids that a worker remembers before it forgets all and starts again.
MOST_TURNS, MOST_IDS = 3_000_000, 8_000_000

_M = (1 << 64) - 1
# A word with the spaces before it, as the pieces never go on from another character to a space; a new line is in no piece of more than one character.
_WORD = re.compile(r" *[^ \n]+| +|\n")


#: Characters of a word beyond which its agenda is a heap of its own; shorter ones are merged many words at once.
LONG = 48
_NEVER = np.int32(2**31 - 1)


def skipped_many(key: np.ndarray, place: np.ndarray, size: np.ndarray, threshold: int) -> np.ndarray:
    """skipped() for arrays."""
    h = key + (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFF)) < np.uint64(threshold)


def skipped(key: int, place: int, size: int, threshold: int) -> bool:
    """Whether the candidate at `place` of `size` characters is skipped; key comes from the seed, the document and the word's number."""
    h = (key + (place * 0x9E3779B97F4A7C15 + size * 0xD1B54A32D192ED03)) & _M
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & _M
    return (h ^ (h >> 29)) & 0xFFFFFFFF < threshold


class PieceModel:
    """The pieces of a merge-type model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        raw: list[bytes] = []
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                raw.append(bytes([int(piece[3:5], 16)]))
                self.byte[raw[-1][0]] = k
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                raw.append(b"")
            else:
                raw.append(piece.replace(SPACE, " ").encode())
                self.rank[piece] = (-model.get_score(k), k)
        for piece in self.rank:
            if SPACE in piece.lstrip(SPACE) or ("\n" in piece and len(piece) > 1):
                raise ValueError("a piece goes on over a word's end; this model isn't supported")
        self.n = n
        # Symbols of characters: a piece's id, or n and the code point for what is no piece, a literal SPACE too.
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        for piece, (_, k) in self.rank.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = k
        self.of_char[ord(" ")], self.of_char[ord(SPACE)] = self.of_char[ord(SPACE)], n + ord(SPACE)
        # The merges: pairs of pieces whose union is a piece, with the union and its place in the order of scores.
        place = dict(zip(ordered := sorted({r for r, _ in self.rank.values()}), range(len(ordered))))
        pairs = [(self.rank[p[:j]][1] * n + self.rank[p[j:]][1], k, place[r]) for p, (r, k) in self.rank.items() for j in range(1, len(p)) if p[:j] in self.rank and p[j:] in self.rank]
        self.pair, self.union, self.place = np.array(sorted(pairs), np.int64).reshape(-1, 3).T.copy()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def encode_word(self, word: str, key: int = 0, threshold: int = 0) -> list[int]:
        """Ids of a word with the spaces before it; a candidate is skipped if its hash lies under the threshold."""
        get = self.rank.get
        symbols = [SPACE if c == " " else _LITERAL if c == SPACE else c for c in word]
        n = len(symbols)
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [(r[0], k, a + b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := get(a + b)) is not None]
            heapq.heapify(agenda)
            push, pop = heapq.heappush, heapq.heappop
            while agenda:
                _, k, union = pop(agenda)
                left = symbols[k]
                if left is None or (j := after[k]) >= n or left + symbols[j] != union:
                    continue
                if threshold and skipped(key, k, len(union), threshold):
                    continue
                symbols[k], symbols[j] = union, None
                after[k] = m = after[j]
                if m < n:
                    before[m] = k
                    if (r := get(x := union + symbols[m])) is not None:
                        push(agenda, (r[0], k, x))
                if (m := before[k]) >= 0 and (r := get(x := symbols[m] + union)) is not None:
                    push(agenda, (r[0], m, x))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (r := get(s)) is not None:
                    out.append(r[1])
                else:
                    out += [self.byte[b] for b in (SPACE if s == _LITERAL else s).encode("utf-8", "surrogatepass")]
        return out

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order, union) of pairs of symbols; _NEVER where their union is no piece."""
        key = np.where((a < self.n) & (b < self.n), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        known = self.pair[at] == key
        return np.where(known, self.place[at], _NEVER).astype(np.int32), self.union[at]

    def encode_rows(self, words: list[str], key: np.ndarray, threshold: int) -> tuple[list[list[int]], list[tuple[np.ndarray, ...]]]:
        """(ids of each word, as encode_word gives them; draws as (row, place, size, skipped), step by step).

        The agendas are the rows of a matrix, where a column holds the candidate that begins at that character; each step takes the best of each row."""
        width = max(1, max(map(len, words)))
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < size[:, None]
        symbol = np.full((n, width), -1, np.int64)
        symbol[inside] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        draws = []
        chars = inside.astype(np.int16)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = after - 2
        agenda, union = np.full((n, width), _NEVER), np.zeros((n, width), np.int64)
        if width > 1:
            agenda[:, :-1], union[:, :-1] = self._merge_of(symbol[:, :-1], np.where(inside[:, 1:], symbol[:, 1:], self.n))
        # The same arrays by one index, row * width + column.
        a, u, s, c, nxt, prev = (x.reshape(-1) for x in (agenda, union, symbol, chars, after, before))
        rows = np.arange(n)
        while len(rows):
            k = agenda[rows].argmin(1)
            i = rows * width + k
            open_ = a[i] != _NEVER
            rows, k, i = rows[open_], k[open_], i[open_]
            j = i - k + nxt[i]
            both = c[i] + c[j]
            no = skipped_many(key[rows], k, both, threshold)
            draws.append((rows, k, both, no))
            a[i[no]] = _NEVER
            yes = ~no
            k, i, j, r = k[yes], i[yes], j[yes], rows[yes]
            s[i] = new = u[i]
            s[j] = -1
            c[i] = both[yes]
            a[j] = _NEVER
            m = nxt[i] = nxt[j]
            ends = m >= size[r]
            at = i - k + np.minimum(m, width - 1)
            prev[at[~ends]] = k[~ends]
            has = prev[i] >= 0
            p = (i - k + prev[i])[has]
            where = np.concatenate((i, p))
            a[where], u[where] = self._merge_of(np.concatenate((new, s[p])), np.concatenate((np.where(ends, self.n, s[at]), new[has])))
        alive = symbol >= 0
        ids, counts = symbol[alive].tolist(), alive.sum(1)
        ends = np.cumsum(counts).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero((symbol >= self.n).any(1)).tolist():
            out[k] = [y for x in out[k] for y in ([x] if x < self.n else [self.byte[b] for b in chr(x - self.n).encode("utf-8", "surrogatepass")])]
        return out, draws

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids that stand for a whole text, as UTF-8; the space that encoding put first is taken off."""
        return gather(self.bytes, self.start[ids], self.size[ids])[0].tobytes()[1:]


def split_words(text: str) -> Iterator[list[str]]:
    """The words of a text with the space that encoding puts first, a bounded number at a time; an empty text has none."""
    if not text:
        return
    at = 0
    text = " " + text
    while len(text) - at > PART:
        cut = text.find("\n", at + PART)
        cut = cut if cut >= 0 else len(text)
        yield _WORD.findall(text, at, cut)
        at = cut
    yield _WORD.findall(text, at)


def word_keys(doc_id: int, first: int, n: int, seed: int) -> np.ndarray:
    """The keys of the words first..first+n of a document."""
    h = np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((doc_id * 0xC2B2AE3D27D4EB4F + seed) & _M)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Turns:
    """For each word, the tree of draws that were met: a node is a candidate, with a child for merging (0) and one for skipping it (1); a leaf has ids."""

    def __init__(self, model: PieceModel, dropout: float, most_turns: int = MOST_TURNS, most_ids: int = MOST_IDS):
        self.model, self.threshold, self.most = model, int(dropout * 2**32), (most_turns, most_ids)
        self.forget()

    def forget(self) -> None:
        self.roots: dict[str, int] = {}
        # A leaf has place -1, and its number instead of a child.
        self.place, self.size, self.child = Growing(np.int16), Growing(np.int16), Growing(np.int32)
        self.start, self.count, self.flat = Growing(np.int64), Growing(np.int32), Growing(np.int32)

    def _add(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        nodes = self.place.n + np.arange(len(place))
        self.place.extend(place)
        self.size.extend(size)
        self.child.extend(np.full(2 * len(place), -1, np.int32))
        return nodes

    def _leaves(self, found: list[list[int]]) -> np.ndarray:
        nodes = self._add(np.full(len(found), -1), np.zeros(len(found)))
        flat, sizes = flattened(found)
        self.child.data[2 * nodes] = self.start.n + np.arange(len(found))
        self.start.extend(self.flat.n + np.cumsum(sizes) - sizes)
        self.count.extend(sizes)
        self.flat.extend(flat)
        return nodes

    def _grow(self, words: list[str], keys: np.ndarray) -> None:
        """Adds the turns that the words take with these keys. Of turns that aren't known yet, no two words take the same."""
        root = np.fromiter(map(self.roots.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(root < 0).tolist()
        length = np.fromiter(map(len, words), np.int64, len(words))
        low = -1
        for high in (6, 10, 16, 24, LONG):
            chosen = np.flatnonzero((length > low) & (length <= high))
            low = high
            for a in range(0, len(chosen), 8192):
                some = chosen[a : a + 8192]
                found, draws = self.model.encode_rows([words[k] for k in some.tolist()], keys[some], self.threshold)
                edge = np.full(len(some), -1, np.int64)

                def step(rows: np.ndarray, new) -> np.ndarray:
                    """The nodes that the edges of the rows lead to; new(rows) makes those that aren't there."""
                    e = edge[rows]
                    node = np.where(e < 0, root[some[rows]], self.child.data[e])
                    lost = node < 0
                    if lost.any():
                        node[lost] = made = new(lost)
                        at = e[lost]
                        self.child.data[at[at >= 0]] = made[at >= 0]
                        root[some[rows[lost]][at < 0]] = made[at < 0]
                    return node

                for rows, place, size, no in draws:
                    node = step(rows, lambda lost: self._add(place[lost], size[lost]))  # noqa: B023
                    edge[rows] = 2 * node + no
                step(np.arange(len(some)), lambda lost: self._leaves([found[k] for k in np.flatnonzero(lost).tolist()]))  # noqa: B023
        self.roots.update((words[k], int(root[k])) for k in fresh)

    def encode(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, each with its key, one after the other; number of ids of each)."""
        if self.place.n > self.most[0] or self.flat.n > self.most[1]:
            self.forget()
        get = self.roots.get
        node = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(node < 0).tolist()
        if lost:
            long = [k for k in lost if len(words[k]) > LONG]
            node[long] = self._leaves([self.model.encode_word(words[k], int(keys[k]), self.threshold) for k in long])
            new = {words[k]: k for k in lost if len(words[k]) <= LONG}
            if new:
                self._grow(list(new), keys[list(new.values())])
                short = [k for k in lost if len(words[k]) <= LONG]
                node[short] = [get(words[k]) for k in short]
        todo = np.arange(len(words))
        while len(todo):
            stuck, edges = [], []
            while len(todo):
                place = self.place.data[node[todo]]
                todo, place = todo[place >= 0], place[place >= 0]
                at = node[todo]
                edge = 2 * at + skipped_many(keys[todo], place, self.size.data[at], self.threshold)
                after = self.child.data[edge]
                known = after >= 0
                stuck.append(todo[~known])
                edges.append(edge[~known])
                todo = todo[known]
                node[todo] = after[known]
            todo, edge = np.concatenate(stuck), np.concatenate(edges)
            if len(todo):
                some = todo[np.unique(edge, return_index=True)[1]]
                self._grow([words[k] for k in some.tolist()], keys[some])
                node[todo] = self.child.data[edge]
        leaf = self.child.data[2 * node]
        return gather(self.flat.data, self.start.data[leaf], self.count.data[leaf])


def model_and_turns(path: str, dropout: float) -> tuple[PieceModel, Turns]:
    """The model at path and what is remembered of its words, once per Python worker."""
    loaded = memory_of("pieces")
    if (at := (path, dropout)) not in loaded:
        model = PieceModel(path)
        loaded[at] = model, Turns(model, dropout)
    return loaded[at]


def encode_texts(texts: list[str], doc_ids: list[int], turns: Turns, seed: int = SEED) -> Iterator[np.ndarray]:
    """Ids of each whole text. Words of many texts are looked up at once, and of a long text in parts."""
    ready: list[list[np.ndarray]] = []  # of the texts since the last that was given
    parts: list[tuple[list[str], np.ndarray]] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        ids, sizes = turns.encode([w for ws, _ in parts for w in ws], np.concatenate([k for _, k in parts]))
        cut = np.cumsum(sizes)[np.cumsum([len(ws) for ws, _ in parts]) - 1]
        for k, own in zip(owner, np.split(ids, cut[:-1])):
            ready[k].append(own)
        parts.clear()
        owner.clear()
        held = 0

    for text, doc_id in zip(texts, doc_ids):
        ready.append([])
        first = 0
        for words in split_words(text):
            parts.append((words, word_keys(doc_id, first, len(words), seed)))
            owner.append(len(ready) - 1)
            first += len(words)
            held += len(words)
            if held >= MANY_WORDS:
                flush()
        if not parts:
            yield from (np.concatenate([np.empty(0, np.int32), *x]) for x in ready)
            ready.clear()
    if parts:
        flush()
    yield from (np.concatenate([np.empty(0, np.int32), *x]) for x in ready)


def encode_text(text: str, doc_id: int, turns: Turns, seed: int = SEED) -> np.ndarray:
    """Ids of one whole text."""
    return next(encode_texts([text], [doc_id], turns, seed))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _each(docs: DataFrame, id_col: str, text_col: str, schema: str, row, vocabulary: str | None, seed: int, dropout: float) -> DataFrame:
    path = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, turns = model_and_turns(path, dropout)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = as_bytes(batch.column(1))
            for k in range(0, len(ids), 256):
                own, raw = ids[k : k + 256], texts[k : k + 256]
                encoded = encode_texts([t.decode() for t in raw], [i or 0 for i in own], turns, seed)
                rows = [(i, *row(model, x, t)) for i, x, t in zip(own, encoded, raw)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str | None = None, seed: int = SEED, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text. Null texts count as empty and have none; a null id draws as 0 does; repeated rows repeat and draw alike."""

    def row(model, ids, text):
        return (ids,)

    return _each(docs, id_col, text_col, "doc_id long, ids array<int>", row, vocabulary, seed, dropout)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from rows (doc_id, ids); ids of null or none give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = model_and_turns(path, 0.0)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


SUMMARY = "doc_id long, n_ids long, ids_crc32 long, n_bytes long, decoded_crc32 long, lossless boolean"


def round_trip(docs: DataFrame, vocabulary: str | None = None, seed: int = SEED, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text: number of ids, crc32 of the ids (as little-endian 32-bit integers), bytes and crc32 of what decoding gives, and whether that is the text."""

    def row(model, ids, text):
        back = model.decode(ids)
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), zlib.crc32(back), back == text

    return _each(docs, id_col, text_col, SUMMARY, row, vocabulary, seed, dropout)
