"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a word embedding (hashed) and the mean embedding of its
byte n-grams (hashed), so inflected and unseen forms share what their stems learned. A
window of WINDOW words passes through a GRU in each direction, attention pools the
states, and a logistic unit scores the pool. A window begins every STRIDE words, so that
successive ones overlap by a quarter and all words are scored, but not every run of WINDOW
words is a window; the text's score is that of its worst window.

The network is fitted on a bounded sample of labelled documents: at most PER_CLASS of
the labels, from those of at most LONGEST windows, each with all its windows. Only
documents' labels are known, so in training, too, a document's logit is the largest
over windows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_and_text, memory_of

#: Words of a window, and words from one window's begin to the next.
WINDOW, STRIDE = 32, 24
#: Documents of label 0 and of label 1 of the sample that is fitted, and windows that a document of it has at most.
PER_CLASS, LONGEST = (2400, 1200), 60
#: Sizes: embedding, state of each direction, attention, buckets of words and of n-grams.
D, H, A, WORD_BUCKETS, GRAM_BITS = 16, 16, 8, 1 << 16, 16
#: Documents of the sample that must have a word or n-gram, else its embedding stays zero: what few documents have only helps to tell those apart.
LEAST_DOCS = 4
GRAMS = (3, 4, 5)
STEPS, BATCH_DOCS, RATE, SEED = 400, 24, 0.01, 7
#: Share of words that train without their word embedding, so that n-grams learn as well, and share that train without any input.
WORD_DROPOUT, INPUT_DROPOUT, DECAY = 0.3, 0.05, 0.02
#: How steeply the share of a window in its document's gradient falls with the distance from the largest logit.
SHARP = 2.0
THRESHOLD = 0.7
#: Words whose inputs a Python worker remembers, and windows that it scores at once.
REMEMBERED, BLOCK = 250_000, 2048

_OTHER = re.compile(r"[^\w\n]+")


# --- word inputs -----------------------------------------------------------------------------------------------------


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, n-gram buckets of all words one after the other, number of n-grams of each word); words are lower-cased, and what isn't a letter, digit or underscore goes."""
    text = _OTHER.sub("", b"\n".join(words).decode("utf-8", "replace").lower()).encode()
    own = text.split(b"\n") if words else []
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03\0\0\0" for w in own) + b"\0" * 8, np.uint8)
    size = np.fromiter(map(len, own), np.int64, len(own)) + 5
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(own)), size)
    place = np.arange(len(owner)) - start[owner]
    wide = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (len(owner), 8), (1, 1))).view("<u8").ravel()
    found, of = [], []
    for n in GRAMS:
        # The mark at each end counts as a character; the padding after it doesn't.
        at = np.flatnonzero(place + n <= size[owner] - 3)
        h = (wide[at] & np.uint64((1 << (8 * n)) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
        of.append(owner[at])
    grams, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    bucket = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in own), np.int64, len(own))
    return bucket, grams[order], np.bincount(of, minlength=len(own))


def _mean_rows(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of the rows of each word; 0 for a word without any."""
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = np.cumsum(sizes) - sizes
        for a in range(0, len(full), 50_000):
            some = full[a : a + 50_000]
            lo, hi = begin[some[0]], begin[some[-1]] + sizes[some[-1]]
            out[some] = np.add.reduceat(table[rows[lo:hi]], begin[some] - lo, axis=0) / sizes[some][:, None]
    return out


# --- network ---------------------------------------------------------------------------------------------------------


def new_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"words": draw(WORD_BUCKETS, D, scale=0.1), "grams": draw(1 << GRAM_BITS, D, scale=0.1)}
    for way in "fb":
        w |= {f"x{way}": draw(D, 3 * H, scale=D**-0.5), f"u{way}": draw(H, 3 * H, scale=0.5 * H**-0.5), f"c{way}": np.zeros(3 * H, np.float32), f"n{way}": np.zeros(H, np.float32)}
    return w | {"wa": draw(2 * H, A, scale=(2 * H) ** -0.5), "ba": np.zeros(A, np.float32), "va": draw(A, scale=1.0), "wo": draw(2 * H, scale=(2 * H) ** -0.5), "bo": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(x: np.ndarray, u: np.ndarray, nb: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) for inputs x (T, B, 3H: reset, update, candidate). A masked step keeps the state. `keep` gets what the way back needs."""
    h = np.zeros((x.shape[1], H), np.float32)
    out = np.empty((*x.shape[:2], H), np.float32)
    for t in range(len(x)):
        g = h @ u
        gates = x[t, :, : 2 * H] + g[:, : 2 * H]
        np.multiply(gates, 0.5, out=gates)
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :H], gates[:, H:]
        nh = g[:, 2 * H :] + nb
        n = np.tanh(x[t, :, 2 * H :] + r * nh)
        if mask is not None:
            z = np.where(mask[t][:, None], z, 1)
        if keep is not None:
            keep.append((h, r, z, nh, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def gru_back(d: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient of x, of u, of nb) from that of the states."""
    dx, du, dn_bias = np.empty((*d.shape[:2], 3 * H), np.float32), np.zeros_like(u), np.zeros(H, np.float32)
    dh = np.zeros(d.shape[1:], np.float32)
    for t in range(len(d) - 1, -1, -1):
        h, r, z, nh, n = keep[t]
        dh = dh + d[t]
        dz = dh * (h - n) * z * (1 - z)
        dn = dh * (1 - z) * (1 - n * n)
        dnh = dn * r
        dr = dn * nh * r * (1 - r)
        dg = np.concatenate((dr, dz, dnh), 1)
        du += h.T @ dg
        dn_bias += dnh.sum(0)
        dx[t, :, :H], dx[t, :, H : 2 * H], dx[t, :, 2 * H :] = dr, dz, dn
        dh = dh * z + dg @ u.T
    return dx, du, dn_bias


def pool(w: dict, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(logits, attention, pooled states, tanh layer) of states (T, B, 2H)."""
    a = np.tanh(states @ w["wa"] + w["ba"])
    e = a @ w["va"]
    if mask is not None:
        e = np.where(mask, e, -1e9)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    return pooled @ w["wo"] + w["bo"][0], alpha, pooled, a


@dataclass
class Vocabulary:
    """The distinct words of the sample with their features."""

    bucket: np.ndarray
    grams: np.ndarray
    sizes: np.ndarray

    def inputs(self, w: dict, with_word: np.ndarray) -> np.ndarray:
        return w["words"][self.bucket] * with_word[:, None] + _mean_rows(w["grams"], self.grams, self.sizes)


def _train_batch(w: dict, vocabulary: Vocabulary, rows: np.ndarray, mask: np.ndarray, doc: np.ndarray, label: np.ndarray, rng) -> tuple[float, dict]:
    """Loss and gradients for windows rows (T, B) of documents doc (B), whose labels are 0 or 1."""
    used, at = np.unique(rows, return_inverse=True)
    at = at.reshape(rows.shape)
    begin = np.cumsum(vocabulary.sizes) - vocabulary.sizes
    sizes = vocabulary.sizes[used]
    where = np.repeat(begin[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    part = Vocabulary(vocabulary.bucket[used], vocabulary.grams[where], sizes)
    with_word = (rng.random(len(used)) >= WORD_DROPOUT).astype(np.float32) / (1 - WORD_DROPOUT)
    with_any = (rng.random(len(used)) >= INPUT_DROPOUT).astype(np.float32)[:, None]
    emb = part.inputs(w, with_word) * with_any
    x = emb[at]
    back_rows = slice(None, None, -1)
    keep_f, keep_b = [], []
    f = gru(x @ w["xf"] + w["cf"], w["uf"], w["nf"], mask, keep_f)
    b = gru((x @ w["xb"] + w["cb"])[back_rows], w["ub"], w["nb"], mask[back_rows], keep_b)
    states = np.concatenate((f, b[back_rows]), 2)
    logit, alpha, pooled, a = pool(w, states, mask)
    # A document's logit is the largest over its windows; windows near it share its gradient.
    n_docs = len(label)
    top = np.full(n_docs, -np.inf, np.float32)
    np.maximum.at(top, doc, logit)
    ex = np.exp(SHARP * (logit - top[doc]))
    total = np.bincount(doc, ex, n_docs)
    share = ex / total[doc]
    p = _sigmoid(top)
    loss = float(np.mean(np.logaddexp(0, top) - label * top))
    d_logit = (((p - label) / n_docs)[doc] * share).astype(np.float32)
    g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * w["wo"]
    d_alpha = np.einsum("bh,tbh->tb", d_pooled, states)
    d_states = alpha[:, :, None] * d_pooled
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["va"] = np.einsum("tb,tba->a", d_e, a)
    d_a = d_e[:, :, None] * w["va"] * (1 - a * a)
    g["wa"], g["ba"] = np.einsum("tbh,tba->ha", states, d_a, optimize=True), d_a.sum((0, 1))
    d_states = d_states + d_a @ w["wa"].T
    dxf, g["uf"], g["nf"] = gru_back(d_states[:, :, :H], w["uf"], keep_f)
    dxb, g["ub"], g["nb"] = gru_back(d_states[back_rows, :, H:], w["ub"], keep_b)
    dxb = dxb[back_rows]
    flat = x.reshape(-1, D)
    d_flat = np.zeros_like(flat)
    for way, dx in (("f", dxf), ("b", dxb)):
        dx = dx.reshape(-1, 3 * H)
        g[f"x{way}"], g[f"c{way}"] = flat.T @ dx, dx.sum(0)
        d_flat += dx @ w[f"x{way}"].T
    columns = lambda index, value, n: np.stack([np.bincount(index, value[:, k], n) for k in range(D)], 1).astype(np.float32)
    d_emb = columns(at.ravel(), d_flat, len(used)) * with_any
    of = np.repeat(np.arange(len(used)), sizes)
    # Of the embeddings, rows that the batch has: (rows, their gradients).
    for name, index, value in (("words", part.bucket, d_emb * with_word[:, None]), ("grams", part.grams, (d_emb / np.maximum(sizes, 1)[:, None])[of])):
        rows_, index = np.unique(index, return_inverse=True)
        g[name] = rows_, columns(index, value, len(rows_))
    return loss, g


def _evidence(vocabulary: Vocabulary, docs: list[np.ndarray], label: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each embedding: 1 if LEAST_DOCS documents or more have it, else 0; and its log-odds for label 1, drawn towards 0 where few documents have it."""
    counts = {"words": np.zeros((2, WORD_BUCKETS)), "grams": np.zeros((2, 1 << GRAM_BITS))}
    begin = np.cumsum(vocabulary.sizes) - vocabulary.sizes
    for words, x in zip(docs, label.astype(int).tolist()):
        used = np.unique(words)
        sizes = vocabulary.sizes[used]
        counts["words"][x, np.unique(vocabulary.bucket[used])] += 1
        counts["grams"][x, np.unique(vocabulary.grams[np.repeat(begin[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())])] += 1
    out = {}
    for k, (no, yes) in counts.items():
        n = no + yes
        odds = np.log((yes + 0.5) / (label.sum() + 1)) - np.log((no + 0.5) / (len(label) - label.sum() + 1))
        out[k] = (n >= LEAST_DOCS).astype(np.float32), (np.clip(odds, -3, 3) * n / (n + LEAST_DOCS)).astype(np.float32)
    return out


def train(windows: list[list[bytes]], labels: list[int], steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray] | None:
    """Weights fitted on documents, each a list of windows, whose words stand between spaces. None if not both labels occur."""
    kept = [k for k, x in enumerate(windows) if x]
    label = np.array([labels[k] for k in kept], np.float32)
    if len(set(label.tolist())) < 2:
        return None
    numbers: dict[bytes, int] = {b"": 0}
    docs = []
    for k in kept:
        rows, mask = np.zeros((WINDOW, len(windows[k])), np.int32), np.zeros((WINDOW, len(windows[k])), bool)
        for j, words in enumerate(x.split() for x in windows[k]):
            rows[: len(words), j] = [numbers.setdefault(x, len(numbers)) for x in words]
            mask[: len(words), j] = True
        docs.append((rows, mask))
    words = list(numbers)
    parts = [word_features(words[a : a + 20_000]) for a in range(0, len(words), 20_000)]  # bounds what the features need meanwhile
    vocabulary = Vocabulary(*(np.concatenate([p[k] for p in parts]).astype(kind) for k, kind in enumerate((np.int64, np.int32, np.int64))))
    w, rng = new_weights(seed), np.random.default_rng(seed)
    evidence = _evidence(vocabulary, [rows[mask] for rows, mask in docs], label)
    frequent = {k: x for k, (x, _) in evidence.items()}
    for k, (x, odds) in evidence.items():
        # The first dimension begins with the evidence, so that small samples needn't find it out.
        w[k][:, 0] = odds
        w[k] *= x[:, None]
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    sides = [np.flatnonzero(label == x) for x in (0, 1)]
    least = max(map(len, sides))
    while step < steps:
        # As many documents of each label, so that the score doesn't carry the sample's shares.
        mixed = np.stack([np.concatenate([rng.permutation(s) for _ in range(-(-least // len(s)))])[:least] for s in sides], 1).ravel()
        for a in range(0, len(mixed), BATCH_DOCS):
            some = mixed[a : a + BATCH_DOCS]
            if step == steps:
                break
            rows, mask = (np.concatenate([docs[k][j] for k in some], 1) for j in (0, 1))
            doc = np.repeat(np.arange(len(some)), [docs[k][0].shape[1] for k in some])
            _, g = _train_batch(w, vocabulary, rows, mask, doc, label[some], rng)
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
            norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in (y[1] if isinstance(y, tuple) else y for y in g.values())))
            for k, x in g.items():
                rows_, x = x if isinstance(x, tuple) else (slice(None), x)
                x = x * min(1.0, 2.0 / (norm + 1e-9))
                m[k][rows_] += 0.1 * (x - m[k][rows_])
                v[k][rows_] += 0.01 * (x * x - v[k][rows_])
                change = m[k][rows_] / (1 - 0.9**step) / (np.sqrt(v[k][rows_] / (1 - 0.99**step)) + 1e-6)
                if k in frequent:
                    change = (change + DECAY * w[k][rows_]) * frequent[k][rows_][:, None]
                w[k][rows_] -= (rate * change).astype(np.float32)
    return w


# --- scoring ---------------------------------------------------------------------------------------------------------


def window_starts(n: int) -> np.ndarray:
    """Where the overlapping windows of n words begin: every STRIDE words, and the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Scorer:
    """Scores texts with fitted weights; inputs of words are remembered."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.x = np.concatenate((weights["xf"], weights["xb"]), 1)
        self.c = np.concatenate((weights["cf"], weights["cb"]))
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.inputs, self.n = np.zeros((4096, 6 * H), np.float32), 0

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        get = self.numbers.get
        at = np.array([get(x, -1) for x in words], np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[k] for k in missing.tolist()))
            for a in range(0, len(new), 20_000):
                some = new[a : a + 20_000]
                bucket, grams, sizes = word_features(some)
                emb = self.w["words"][bucket] + _mean_rows(self.w["grams"], grams, sizes)
                if self.n + len(some) > len(self.inputs):
                    self.inputs = np.concatenate((self.inputs, np.zeros((max(len(self.inputs), len(some)), 6 * H), np.float32)))
                self.inputs[self.n : self.n + len(some)] = emb @ self.x + self.c
                self.numbers.update(zip(some, range(self.n, self.n + len(some))))
                self.n += len(some)
            at[missing] = [self.numbers[words[k]] for k in missing.tolist()]
        return at

    def logits(self, rows: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows rows (T, B)."""
        w, f = self.w, self.inputs[:, : 3 * H]
        b = self.inputs[:, 3 * H :]
        forth = gru(f[rows], w["uf"], w["nf"], mask)
        back = gru(b[rows[::-1]], w["ub"], w["nb"], None if mask is None else mask[::-1])
        return pool(w, np.concatenate((forth, back[::-1]), 2), mask)[0]

    def scores(self, texts: list[bytes]) -> list[float]:
        """The score of each text: the largest over its windows; 0 for a text without words."""
        out, pending, held = [-np.inf] * len(texts), [], 0

        def flush() -> None:
            nonlocal pending, held
            words = [x for _, ws in pending for x in ws]
            rows = self.rows_of(words)
            full, of, base = [], [], 0
            for k, ws in pending:
                n = len(ws)
                if n >= WINDOW:
                    starts = window_starts(n) + base
                    full.append(starts)
                    of.append(np.full(len(starts), k))
                elif n:
                    own = np.zeros((WINDOW, 1), np.int64)
                    own[:n, 0] = rows[base : base + n]
                    mask = (np.arange(WINDOW) < n)[:, None]
                    out[k] = max(out[k], float(self.logits(own, mask)[0]))
                base += n
            if full:
                starts, of = np.concatenate(full), np.concatenate(of)
                for a in range(0, len(starts), BLOCK):
                    found = self.logits(rows[starts[a : a + BLOCK] + np.arange(WINDOW)[:, None]], None)
                    for k, x in zip(*_largest(of[a : a + BLOCK], found)):
                        out[k] = max(out[k], x)
            pending, held = [], 0

        for k, text in enumerate(texts):
            words = text.split()
            for a in range(0, max(len(words) - WINDOW + STRIDE, 1), 200 * STRIDE * 16):
                # Parts of a long text overlap, so that their windows are those of the whole.
                part = words[a : a + 200 * STRIDE * 16 + WINDOW - STRIDE] if len(words) > 200 * STRIDE * 16 else words
                pending.append((k, part))
                held += len(part)
                if held >= 150_000:
                    flush()
        if pending:
            flush()
        return [0.0 if x == -np.inf else float(_sigmoid(np.float64(x))) for x in out]


def _largest(of: np.ndarray, value: np.ndarray) -> tuple[list[int], list[float]]:
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return of[begin].tolist(), np.maximum.reduceat(value, begin).astype(float).tolist()


# --- on Spark --------------------------------------------------------------------------------------------------------


def remainder(id_col):
    """crc32 of the id's text, modulo 3."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def sample_windows(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, longest: int = LONGEST) -> tuple[list[list[bytes]], list[int]]:
    """All windows, and the labels, of at most per_class documents of label 0 and 1 that have 1 to `longest` windows, repeated rows once; labels: rows (doc_id, label) that may be learned from."""
    clean = labels.select("doc_id", "label").filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    n_words = F.size(F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"))
    # Of longer texts it is enough to know that they are longer.
    long = F.length("text") > 100 * STRIDE * longest
    known = docs.join(clean, "doc_id").filter(~F.coalesce(long, F.lit(True))).withColumn("n", n_words).filter((F.col("n") > 0) & (F.col("n") <= WINDOW + STRIDE * (longest - 1)))
    # Ids are chosen first, so that no task gets more than ids; texts come by a broadcast of at most sum(per_class) rows.
    ids = known.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("text").alias("h")).distinct()
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("h")]
    chosen = [tuple(r) for x in (0, 1) for r in ids.filter(F.col("label") == x).orderBy(*order).limit(per_class[x]).collect()]
    if not chosen:
        return [], []
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int, h long")
    # Rows that repeat an id and its text are one document; they meet where they are read before any is sent on.
    texts = docs.join(F.broadcast(small), (docs["doc_id"] == small["doc_id"]) & (F.xxhash64("text") == F.col("h"))).select(docs["doc_id"], "text", "label", "h")
    texts = texts.dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(1)):
                words = text.split()
                out.append([b" ".join(words[s : s + WINDOW]) for s in window_starts(len(words)).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.binary()))], ["doc_id", "label", "windows"])

    rows = texts.mapInArrow(run, "doc_id long, label int, windows array<binary>").collect()  # at most sum(per_class) * longest windows
    rows = sorted(rows, key=lambda r: (r.doc_id, r.windows))
    return [[bytes(x) for x in r.windows] for r in rows], [r.label for r in rows]


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, weights: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs with fitted weights. Null texts count as empty; texts without words score 0, and all do without weights; held_out is false for a null id."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = memory_of("toxicity")
        if name not in held:
            held.clear()
            held[name] = Scorer(sent.value) if sent.value is not None else None
        scorer = held[name]
        for batch in batches:
            texts = as_bytes(batch.column(1))
            found = scorer.scores(texts) if scorer else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> dict[str, np.ndarray] | None:
    """Weights learned from the labels of rows that aren't held out; None if those rows lack one of the labels. Rows without an id or a label are left out; of several labels of an id, 1 counts."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(remainder(F.col("doc_id")) != 1)
    return train(*sample_windows(id_and_text(docs, id_col, text_col), known, per_class))


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit on labels, and score of all docs."""
    return score(docs, fit(docs, labels))
