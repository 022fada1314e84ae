"""The recurrent model against plain loops, its slopes against differences, its probabilities against their sum."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierflow.llm import gru, queries
from dossierflow.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def is_held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 == 2


def counted(held):
    c = Counter()
    for doc, text in held:
        if not is_held(doc):
            c.update(tokens(text))
    return c


def base(held):
    c = counted(held)
    n, v = sum(c.values()), len(c)
    return c, n, lambda ts: sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in ts)


class Plain:
    """The model's definition, word by word."""

    def __init__(self, c, weights):
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: gru.WORDS]
        self.c, self.w, self.rank = c, weights, {t: i for i, (t, _) in enumerate(top)}
        self.tails = Counter()
        for t, n in c.items():
            if t not in self.rank:
                self.tails[n.bit_length() - 1] += n
        ones, twos = (sum(n == k for t, n in c.items() if t not in self.rank) for k in (1, 2))
        self.once, self.unknown = ones, (ones + 1) / (ones + 2 * twos + 2)

    def code(self, t):
        if t in self.rank:
            return self.rank[t]
        return gru.WORDS + max(self.c[t].bit_length() - 1, 0) * gru.BUCKETS + zlib.crc32(t[-2:].encode()) % gru.BUCKETS

    def softmax(self, s):
        e = np.exp(s - s.max())
        return e / e.sum()

    def given(self, h, t):
        """Probability of a word after a state."""
        w, y = self.w, self.code(t)
        classes = self.softmax(h @ w.by_class + w.class_bias)
        if y < gru.WORDS:
            k = y // gru.CLASS
            return classes[k] * self.softmax(h @ w.by_word[k] + w.word_bias[k])[y % gru.CLASS]
        n = self.c[t]
        own = self.unknown if n == 0 else (1 - self.unknown) / self.once if n == 1 else n / self.tails[n.bit_length() - 1]
        return classes[gru.HEADS + (y - gru.WORDS) // gru.BUCKETS] * own

    def step(self, h, x):
        n, w = len(h), self.w
        a, g = w.into[x].astype(float), h @ w.between
        z, r = 1 / (1 + np.exp(-(a[:n] + g[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + g[n : 2 * n])))
        return (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h

    def score(self, ts):
        h, x, total = np.zeros(self.w.between.shape[0]), gru.START, 0.0
        for t in ts:
            h = self.step(h, x)
            total += math.log10(self.given(h, t))
            x = self.code(t)
        return total


@pytest.fixture(scope="module", params=["docs", "sample"])
def fitted(request):
    table = request.getfixturevalue(request.param)
    corpus = lm.encode_corpus(table, lm.held_out())
    return table, corpus, lm.fit(corpus)


def test_counts_and_base_scores(fitted):
    table, corpus, weights = fitted
    held = [(r["doc_id"], r["text"]) for r in table.collect()]
    c, n, of = base(held)
    got = lm.log_probabilities(corpus, weights).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    want = sorted(((d, is_held(d), len(ts), sum(c[t] > 0 for t in ts), of(ts)) for d, ts in ((d, tokens(t)) for d, t in held)), key=key)
    assert [r[:3] for r in want] == [(r["doc_id"], r["held_out"], r["n_tokens"]) for r in sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key) for r in [dict(zip(("doc_id", "held_out", "n_tokens"), r[:3], strict=True))]]
    for w, g in zip(want, sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key), strict=True):
        assert w[:4] == g[:4] and math.isclose(w[4], g[4], rel_tol=1e-9, abs_tol=1e-9)
    assert {r["train_tokens"] for r in got} == {n}


def test_scores_equal_plain_loops(fitted):
    table, corpus, weights = fitted
    held = [(r["doc_id"], r["text"]) for r in table.collect() if len(r["text"] or "") < 20_000]
    plain = Plain(counted([(r["doc_id"], r["text"]) for r in table.collect()]), weights)
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 1)) for r in lm.log_probabilities(corpus, weights).collect())
    by = {}
    for d, n, s in got:
        by.setdefault((d, n), []).append(s)
    for d, text in held:
        ts = tokens(text)
        assert any(math.isclose(plain.score(ts), s, rel_tol=1e-4, abs_tol=0.06) for s in by[d, len(ts)])


def test_probabilities_sum_up_to_one(sample):
    corpus = lm.encode_corpus(sample, lm.held_out())
    weights = lm.fit(corpus)
    c = counted([(r["doc_id"], r["text"]) for r in sample.collect()])
    plain, rng = Plain(c, weights), np.random.default_rng(3)
    for _ in range(2):
        h = np.tanh(rng.standard_normal(gru.HIDDEN))
        assert math.isclose(sum(plain.given(h, t) for t in c) + plain.given(h, "no such word"), 1, rel_tol=1e-5)


def test_held_out_texts_are_better_predicted_than_by_counts(spark):
    got = queries.op11_lm_scoring(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert out["s"] > out["b"] + 1.5 / math.log(10) * out["n"] and out["better"] > 0.85
    assert got.count() == 1000 and got.where("score >= 0").isEmpty()


def test_order_of_words_counts(sample):
    corpus = lm.encode_corpus(sample, lm.held_out())
    weights = lm.fit(corpus)
    texts = [lm._unpack(bytes(r["codes"]), "<u2") for r in corpus.documents.collect()]
    rng = np.random.default_rng(4)
    mixed = [np.append(rng.permutation(t[:-1]), t[-1]) for t in texts]
    assert gru.scores(weights, texts).sum() > gru.scores(weights, mixed).sum()


def test_small_blocks_give_the_same_codes(docs, monkeypatch):
    read = lambda: sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["n_known"], round(r["in_class"], 6), lm._unpack(bytes(r["codes"]), "<u2").tolist()) for r in lm.encode_corpus(docs, lm.held_out()).documents.collect())
    whole = read()
    monkeypatch.setattr(lm, "BLOCK_WORDS", 3)
    assert read() == whole


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    w = gru.begin(rng.integers(1, 9, gru.WORDS).astype(float), np.ones(gru.TAILS), 3)
    w = gru.Weights(*(a.astype(np.float64) for a in w.arrays()))
    x, y = rng.integers(0, gru.CODES, (5, 4)), rng.integers(0, gru.CODES, 20)
    y[:8] = rng.integers(0, gru.WORDS, 8)
    keep, state = (rng.random((5, 4, 1)) > 0.3).astype(float), rng.standard_normal((4, 3))

    def loss():
        states, steps, _ = gru.forward(w, x, keep, state)
        found, slopes = gru.outputs(w, states.reshape(-1, 3).astype(np.float64), y, True)
        return -found.sum(), states, steps, slopes

    _, states, steps, (dh, *d_out) = loss()
    for a, d in zip(w.arrays(), [*gru.backward(w, x, keep, steps, dh.reshape(states.shape)), *d_out], strict=True):
        for at in rng.permutation(np.flatnonzero(d.ravel()))[:6]:
            i, own = np.unravel_index(at, a.shape), a.flat[at]
            a[i] = own + 1e-3
            up = loss()[0]
            a[i] = own - 1e-3
            down = loss()[0]
            a[i] = own
            assert math.isclose((up - down) / 2e-3, d[i], rel_tol=0.02, abs_tol=2e-3)


def test_lanes_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(2)
    w = gru.begin(np.ones(gru.WORDS), np.ones(gru.TAILS))
    texts = [rng.integers(0, gru.CODES, n) for n in (1, 70, 3, 16, 17, 1, 200, 33)]
    alone = [gru.scores(w, [t])[0] for t in texts]
    for lanes in (1, 2, 5):
        monkeypatch.setattr(gru, "LANES", lanes)
        assert np.allclose(gru.scores(w, texts), alone, rtol=1e-5)


def test_weights_meet_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    w = gru.begin(np.ones(3), np.ones(gru.TAILS), 2)
    flat, rows = w.flat(), []
    for task, n in enumerate((5, 1, 3, 7, 2)):
        own = flat + task
        rows += [(task, i, n, own[at : at + lm.PIECE].astype("<f4").tobytes()) for i, at in enumerate(range(0, len(own), lm.PIECE))]
    got = lm._averaged(spark.createDataFrame(rows, "task long, piece int, tokens long, weights binary"), 5, w)
    assert np.allclose(got.flat(), flat + (1 + 2 * 3 + 3 * 7 + 4 * 2) / 18, atol=1e-4)


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert lm.score_corpus(spark.createDataFrame([], schema)).collect() == []
    got = lm.score_corpus(spark.createDataFrame([(None, "a b"), (None, None)], schema)).collect()
    assert [(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(True, 0, 0, 0.0)] * 2 and all(r["score"] <= 0 for r in got)
