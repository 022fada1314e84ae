"""A gated recurrent language model in NumPy: truncated backpropagation and a class-factored softmax.

Tokens are codes. The first ``WORDS`` codes are words of their own, dealt in
classes of ``CLASS`` by rank; the others name a tail class and a bucket of
spellings within it. An output is a class and, for words of their own, the
word within the class; the state decides both.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

WORDS, CLASS = 2048, 64
TAILS, BUCKETS = 24, 64
HEADS = WORDS // CLASS
CODES = WORDS + TAILS * BUCKETS
START = CODES  # what comes ahead of a text's first token
HIDDEN = 16
STEPS = 16  # of a window: how far errors go back
LANES = 512  # texts side by side
RATE = 0.01


@dataclass
class Weights:
    """``into``: what a code adds to the gates (update, reset, candidate); ``between``: what the state adds; then class and word scores."""

    into: np.ndarray
    between: np.ndarray
    by_class: np.ndarray
    class_bias: np.ndarray
    by_word: np.ndarray
    word_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.into, self.between, self.by_class, self.class_bias, self.by_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Weights:
        ends = np.cumsum([a.size for a in self.arrays()])
        return Weights(*(p.reshape(a.shape).astype(np.float32) for p, a in zip(np.split(flat, ends[:-1]), self.arrays(), strict=True)))


def begin(words: np.ndarray, tails: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Weights:
    """Weights whose outputs have the given counts' shares whatever the state; ``words`` and ``tails`` are counts of words of their own and of tail classes."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    own = np.zeros(WORDS)
    own[: len(words)] = words
    per_class = own.reshape(HEADS, CLASS).sum(1)
    # a class or word that never occurs keeps no more than rounding; unknown words share the first tail class
    return Weights(
        draw(CODES + 1, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=hidden**-0.5), draw(hidden, HEADS + TAILS, scale=0.05),
        np.log(np.maximum(np.concatenate([per_class, [tails[0] + 0.5], tails[1:]]), 1e-6)).astype(np.float32), draw(HEADS, hidden, CLASS, scale=0.05), np.log(np.maximum(own, 1e-6)).reshape(HEADS, CLASS).astype(np.float32),
    )


def forward(w: Weights, x: np.ndarray, keep: np.ndarray, state: np.ndarray, learn: bool = True) -> tuple[np.ndarray, list, np.ndarray]:
    """``(states, what the way back needs, last state)`` for a window of codes; ``keep`` is 0 where a text begins, which clears the state."""
    n = state.shape[1]
    gates, steps, states = w.into[x], [], np.empty((*x.shape, n), dtype=np.float32)
    for t in range(len(x)):
        before = state * keep[t]
        g = before @ w.between
        zr = np.tanh((gates[t, :, : 2 * n] + g[:, : 2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r, u = zr[:, :n], zr[:, n:], g[:, 2 * n :]
        c = np.tanh(gates[t, :, 2 * n :] + r * u)
        state = c + z * (before - c)
        states[t] = state
        if learn:
            steps.append((before, z, r, u, c))
    return states, steps, state


def _exponents(h: np.ndarray, scores: np.ndarray, bias: np.ndarray, rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores after states ``h``, the exponents, the scores asked for, and the sums of exponents; each row by its own maximum where the common shift does not do."""
    shift = bias - bias.max()
    e = h @ scores
    e += shift
    own = e[rows, of]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], dtype=e.dtype)
    if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):
        e = h @ scores + shift
        most = e.max(1)
        own -= most
        np.exp(e - most[:, None], out=e)
        total = e.sum(1)
    return e, own, total


def outputs(w: Weights, h: np.ndarray, y: np.ndarray, learn: bool) -> tuple[np.ndarray, tuple | None]:
    """Natural log-probabilities of codes ``y`` after states ``h``, of tail codes those of their class; with ``learn`` also the slopes of their negative sum."""
    rows, head = np.arange(len(y)), y < WORDS
    of = np.where(head, y // CLASS, HEADS + (y - WORDS) // BUCKETS)
    e, own, total = _exponents(h, w.by_class, w.class_bias, rows, of)
    found = (own - np.log(total)).astype(np.float64)
    if learn:
        e[rows, of] -= total  # slopes times the sum of a row, which narrower arrays are divided by
        share = 1 / total[:, None]
        dh, d_class, d_classes = (e @ w.by_class.T) * share, (h * share).T @ e, share[:, 0] @ e
        d_word, d_bias = np.zeros_like(w.by_word), np.zeros_like(w.word_bias)
    at = np.flatnonzero(head)
    at = at[np.argsort(of[at].astype(np.uint8), kind="stable")]  # small numbers are sorted by their digits
    cuts = np.searchsorted(of[at], np.arange(HEADS + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        i = at[cuts[c] : cuts[c + 1]]
        hi, k = h[i], y[i] % CLASS
        q, own, total = _exponents(hi, w.by_word[c], w.word_bias[c], np.arange(len(i)), k)
        found[i] += own - np.log(total)
        if learn:
            q[np.arange(len(i)), k] -= total
            share = 1 / total[:, None]
            d_word[c], d_bias[c] = (hi * share).T @ q, share[:, 0] @ q
            dh[i] += (q @ w.by_word[c].T) * share
    return found, (dh, d_class, d_classes, d_word, d_bias) if learn else None


def backward(w: Weights, x: np.ndarray, keep: np.ndarray, steps: list, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of ``into`` and ``between`` from those of the window's states; nothing goes back beyond the window."""
    n = dh.shape[2]
    d_gates, d_between, carried = np.empty((*x.shape, 3 * n), dtype=np.float32), np.zeros_like(w.between), np.zeros(dh.shape[1:], dtype=np.float32)
    d_state = np.empty((x.shape[1], 3 * n), dtype=np.float32)
    for t in range(len(x) - 1, -1, -1):
        before, z, r, u, c = steps[t]
        d = dh[t] + carried
        d_c = d * (1 - z) * (1 - c * c)
        d_state[:, :n] = d * (before - c) * z * (1 - z)
        d_state[:, n : 2 * n] = d_c * u * r * (1 - r)
        d_state[:, 2 * n :] = d_c * r
        d_gates[t, :, : 2 * n], d_gates[t, :, 2 * n :] = d_state[:, : 2 * n], d_c
        d_between += before.T @ d_state
        carried = (d * z + d_state @ w.between.T) * keep[t]
    flat, order = x.ravel(), np.argsort(x.ravel().astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
    d_into = np.zeros_like(w.into)
    d_into[flat[order][first]] = np.add.reduceat(d_gates.reshape(-1, 3 * n)[order], first, axis=0)
    return d_into, d_between


def _inputs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: the codes ahead of each token, the tokens, and whether a text begins there."""
    y = np.concatenate(texts).astype(np.int32)
    begins = np.zeros(len(y), dtype=bool)
    begins[np.cumsum([0, *map(len, texts[:-1])])] = True
    x = np.append(np.int32(START), y[:-1])
    x[begins] = START
    return x, y, begins


def _adam(a: np.ndarray, d: np.ndarray, m: np.ndarray, v: np.ndarray, t: np.ndarray, n: np.float32, rate: float, step: int) -> None:
    """A step of Adam on ``a`` by slopes ``d`` of ``n`` tokens; ``t`` and ``d`` are written over, so that no array is made."""
    d /= n
    np.subtract(d, m, out=t)
    t *= np.float32(0.1)
    m += t
    np.multiply(d, d, out=t)
    t -= v
    t *= np.float32(0.01)
    v += t
    np.divide(v, np.float32(1 - 0.99**step), out=t)
    np.sqrt(t, out=t)
    t += np.float32(1e-6)
    np.multiply(m, np.float32(rate / (1 - 0.9**step)), out=d)
    d /= t
    a -= d


def train(w: Weights, texts: list[np.ndarray], rate: float = RATE) -> tuple[Weights, int]:
    """One pass over the texts, none of them empty; the state is carried from window to window, and cleared where a text begins."""
    x, y, begins = _inputs(texts)
    lanes = int(np.clip(len(y) // 1024, 4, LANES))
    long = -(-len(y) // lanes)
    short = lanes * long - len(y)
    deal = lambda a, fill: np.append(a, np.full(short, fill, dtype=a.dtype)).reshape(lanes, long).T
    x, y, begins = deal(x, START), deal(y, -1), deal(begins, True)
    state, w = np.zeros((lanes, w.between.shape[0]), dtype=np.float32), Weights(*(a.copy() for a in w.arrays()))
    moments = [(np.zeros_like(a), np.zeros_like(a), np.empty_like(a)) for a in w.arrays()]
    for step, at in enumerate(range(0, long, STEPS), 1):
        xs, ys, keep = x[at : at + STEPS], y[at : at + STEPS].ravel(), (~begins[at : at + STEPS])[:, :, None].astype(np.float32)
        states, steps, state = forward(w, xs, keep, state)
        some = np.flatnonzero(ys >= 0)
        _, (dh, *d_out) = outputs(w, states.reshape(-1, states.shape[2])[some], ys[some], True)
        whole = np.zeros((len(ys), states.shape[2]), dtype=np.float32)
        whole[some] = dh
        slopes = [*backward(w, xs, keep, steps, whole.reshape(states.shape)), *d_out]
        for a, d, (m, v, some_of) in zip(w.arrays(), slopes, moments, strict=True):
            _adam(a, d, m, v, some_of, np.float32(max(1, len(some))), rate, step)
    return w, int((y >= 0).sum())


def scores(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log-probability of each text, none of them empty, from its first token to its last; the state goes through the whole text.

    Whole texts are dealt to lanes, the longest first, each to the lane that is
    free first.
    """
    sizes = np.array(list(map(len, texts)), dtype=np.int64)
    lanes = int(np.clip(sizes.sum() // sizes.max(), 1, LANES))
    free, place = [(0, lane) for lane in range(lanes)], np.empty((len(texts), 2), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        at, lane = heapq.heappop(free)
        place[i] = lane, at
        heapq.heappush(free, (at + int(sizes[i]), lane))
    long = max(at for at, _ in free)
    x, y, of, keep = np.full((long, lanes), START, dtype=np.int32), np.full((long, lanes), -1, dtype=np.int32), np.zeros((long, lanes), dtype=np.int32), np.ones((long, lanes), dtype=np.float32)
    for i, text in enumerate(texts):
        lane, at = place[i]
        y[at : at + len(text), lane], x[at + 1 : at + len(text), lane] = text, text[:-1]
        of[at : at + len(text), lane], keep[at, lane] = i, 0
    state, out = np.zeros((lanes, w.between.shape[0]), dtype=np.float32), np.zeros(len(texts))
    steps = max(STEPS, STEPS * LANES // lanes)
    for at in range(0, long, steps):
        states, _, state = forward(w, x[at : at + steps], keep[at : at + steps, :, None], state, False)
        ys = y[at : at + steps].ravel()
        some = np.flatnonzero(ys >= 0)
        found, _ = outputs(w, states.reshape(-1, states.shape[2])[some], ys[some], False)
        out += np.bincount(of[at : at + steps].ravel()[some], weights=found, minlength=len(texts))
    return out
