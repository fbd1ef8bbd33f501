import random
import re
import zlib

import numpy as np
import pytest

from sylvaframe.llm import toxicity as tx


def text_of(rng, bad, n):
    words = ["".join(rng.choice(["ta", "re", "on", "li", "mu", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(3 * bad):
        words[rng.randrange(n)] = "krag" + rng.choice(["o", "en", "ul", "ist", "um"]) + rng.choice(["", "s", "!"])
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(k, text_of(rng, k % 4 == 0, rng.choice([20, 60, 250])), int(k % 4 == 0)) for k in range(360)]


def test_gradients():
    rng = np.random.default_rng(3)
    words = [b"", *(f"word{k}".encode() for k in range(30))]
    v = tx.Vocabulary(*tx.word_features(words))
    w = {k: x.astype(np.float64) for k, x in tx.new_weights(1).items()}
    rows, doc = rng.integers(1, 31, (tx.WINDOW, 5)), np.array([0, 0, 1, 2, 2])
    mask = np.ones((tx.WINDOW, 5), bool)
    mask[7:, 3] = False
    label = np.array([1.0, 0.0, 1.0], np.float32)

    def loss():
        class Still:
            random = staticmethod(lambda n: np.ones(n))

        return tx._train_batch({k: x.astype(np.float32) for k, x in w.items()}, v, rows, mask, doc, label, Still)

    # With so steep a share the gradient is that of the largest window alone, as the loss is.
    tx_sharp, tx.SHARP = tx.SHARP, 1e6
    try:
        _, g = loss()
        for k in ("wo", "wa", "va", "xf", "xb", "uf", "ub", "nf", "nb", "cf", "cb", "ba"):
            at = tuple(rng.integers(0, s) for s in w[k].shape)
            eps, kept = 0.03, w[k][at]
            w[k][at] = kept + eps
            up = loss()[0]
            w[k][at] = kept - eps
            down = loss()[0]
            w[k][at] = kept
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k
        found = dict(zip(g["words"][0].tolist(), g["words"][1]))
        bucket = int(v.bucket[rows[0, 0]])
        kept = w["words"][bucket, 2]
        w["words"][bucket, 2] = kept + 0.03
        up = loss()[0]
        w["words"][bucket, 2] = kept - 0.03
        assert abs((up - loss()[0]) / 0.06 - found[bucket][2]) < 2e-3
    finally:
        tx.SHARP = tx_sharp


def test_windows():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        starts = tx.window_starts(n)
        covered = {k for s in starts.tolist() for k in range(s, min(s + tx.WINDOW, n))}
        assert covered == set(range(n)) and len(set(starts.tolist())) == len(starts)


def test_long_texts_have_the_windows_of_the_whole(monkeypatch):
    scorer = tx.Scorer(tx.new_weights(2))
    rng = random.Random(5)
    words = [str(rng.randrange(2000)).encode() for _ in range(200 * tx.STRIDE * 16 + 5000)]
    rows = scorer.rows_of(words)
    starts = tx.window_starts(len(words))
    want = np.concatenate([scorer.logits(rows[starts[a : a + 1000] + np.arange(tx.WINDOW)[:, None]], None) for a in range(0, len(starts), 1000)]).max()
    assert scorer.scores([b" ".join(words)])[0] == pytest.approx(float(tx._sigmoid(np.float64(want))), abs=1e-5)


def test_held_out_accuracy(spark, corpus):
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in corpus] + [(None, "x", 0.0), (-1, None, 0.0), (-2, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, x) for k, _, x in corpus] + [(None, 1), (3, None), (999_999, 1)], "doc_id long, toxic int")
    rows = tx.fit_and_score(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(corpus) + 3 and got[-1].score == got[-2].score == 0.0 and not got[None].held_out
    held = [(got[k].predicted, x) for k, _, x in corpus if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in corpus)
    assert sum(p == x for p, x in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus[:40]], "doc_id long, text string")
    turned = [(k, 1 - x if zlib.crc32(str(k).encode()) % 3 == 1 else x) for k, _, x in corpus[:40]]
    seen = [tx.sample_windows(docs, df) for df in (
        spark.createDataFrame(rows, "doc_id long, label int").filter(tx.remainder(tx.F.col("doc_id")) != 1) for rows in (turned, [(k, x) for k, _, x in corpus[:40]])
    )]
    assert seen[0] == seen[1] and seen[0][0]


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert [r.score for r in tx.fit_and_score(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).collect()] == [0.0, 0.0]
    assert tx.fit_and_score(docs.filter("false"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def slow_score(w, text):
    """The score by the definition: one window, one word and one n-gram at a time, in doubles."""
    w = {k: x.astype(np.float64) for k, x in w.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        own = re.sub(r"\W+", "", word.decode().lower()).encode()
        marked, grams = b"\x02" + own + b"\x03", []
        for n in (3, 4, 5):
            for k in range(len(marked) - n + 1):
                h = (int.from_bytes(marked[k : k + n], "little") * 0x9E3779B97F4A7C15 + n) % 2**64
                grams.append(w["grams"][(h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 48])
        return w["words"][zlib.crc32(own) % 2**16] + (np.mean(grams, axis=0) if grams else 0)

    def states(vectors, way):
        h, out = np.zeros(16), []
        for x in vectors:
            x, g = x @ w[f"x{way}"] + w[f"c{way}"], h @ w[f"u{way}"]
            r, z = sigmoid(x[:16] + g[:16]), sigmoid(x[16:32] + g[16:32])
            n = np.tanh(x[32:] + r * (g[32:] + w[f"n{way}"]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    words, found = text.split(), []
    begins = {0} if len(words) <= 32 else {*range(0, len(words) - 32, 24), len(words) - 32}
    for begin in begins if words else ():
        vectors = [vector(x) for x in words[begin : begin + 32]]
        both = [np.concatenate(x) for x in zip(states(vectors, "f"), states(vectors[::-1], "b")[::-1])]
        weight = np.array([np.exp(np.tanh(x @ w["wa"] + w["ba"]) @ w["va"]) for x in both])
        pooled = sum(a * x for a, x in zip(weight / weight.sum(), both))
        found.append(sigmoid(pooled @ w["wo"] + w["bo"][0]))
    return max(found, default=0.0)


def test_scores_against_brute_force():
    rng = random.Random(8)
    alphabet = ["ta", "Re", "on", "é", "日本", "_x", "7", "-", "!", "krag", "ß"]
    texts = ["", " \n\t", "one", "!!! ...", *(" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n)) for n in (2, 31, 32, 33, 56, 57, 200, 200))]
    texts += texts[-3:]
    w = tx.new_weights(4)
    w = {k: x if k in ("words", "grams") else 1.5 * x + 0.01 for k, x in w.items()}
    got = tx.Scorer(w).scores([t.encode() for t in texts])
    want = [slow_score(w, t.encode()) for t in texts]
    assert got == pytest.approx(want, abs=1e-5) and len({round(x, 4) for x in want}) > 8


def test_repeated_rows_and_clashing_columns(spark, corpus, monkeypatch):
    monkeypatch.setattr(tx, "train", lambda *sample: sample)
    rows, known = [(k, t) for k, t, _ in corpus[:40]], [(k, x) for k, _, x in corpus[:40]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    extra = "score double, held_out int, predicted string, label int, h long, n int, toxic int"
    wide = spark.createDataFrame([(*r, 0.5, 7, "x", 1, 1, 1, 1) for r in rows + rows[:9]], f"doc_id long, text string, {extra}")
    wide_labels = spark.createDataFrame([(k, x, "not the text", 1 - x, 0.5, 3, 4) for k, x in known + known[:9]], "doc_id long, toxic int, text string, label int, score double, n int, h long")
    assert tx.fit(wide, wide_labels) == tx.fit(docs, labels) and tx.fit(docs, labels)[0]
    w = tx.new_weights(4)
    rounded = lambda df: [(r[0], r[1], round(r[2], 6), r[3]) for r in map(tuple, df.collect())]
    once = rounded(tx.score(docs, w))
    assert sorted(rounded(tx.score(wide, w))) == sorted(once + [r for r in once if r[0] in {k for k, _ in rows[:9]}])
