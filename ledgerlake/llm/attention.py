"""A small causal self-attention model in numpy: forward, backward, and a trainer.

A window has BEFORE inputs of context and TARGETS more, each of which predicts the token after it, so windows overlap by BEFORE and each token is
scored once. Scores within a window are one batched product under a causal mask, with a learned bias for each distance. What
a place attends to, with its own embedding, gives the weights of PARTS distributions over all tokens; their mixture predicts the
next token. The distributions are learned with the rest: each target counts for the parts that explain it (expectation), and the
parts are the counts' shares (maximisation), smoothed by the tokens' own frequency.

Weights are `_exp` of what is computed, divided by their sum, so all probabilities sum to 1 whatever `_exp` is.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

TARGETS, BEFORE, WIDTH, HEAD, PARTS = 24, 8, 24, 8, 64
SPAN = TARGETS + BEFORE
#: Weight of the tokens' own frequency in each part, in tokens.
SMOOTH = 200.0
_seen = (np.arange(SPAN)[None, :] <= np.arange(TARGETS)[:, None] + BEFORE).astype(np.float32)
_back = np.clip(np.arange(TARGETS)[:, None] + BEFORE - np.arange(SPAN)[None, :], 0, SPAN - 1)
_f4 = np.float32
#: The step of a float's bits for a factor of e, and the bits of 1.0.
_SCALE, _ONE = _f4((1 << 23) / np.log(2)), _f4(127 << 23)
_ones = np.ones(PARTS, _f4)
#: Rows of one key from which on they are summed as a product.
MANY = 16
_many = np.ones(1 << 14, _f4)

Params = dict[str, np.ndarray]


#: Exponents are held to +-30, so no weight is 0 and no sum overflows.
_LOW, _HIGH = _ONE - 30 * _SCALE, _ONE + 30 * _SCALE


def _exp(bits: np.ndarray) -> np.ndarray:
    """For _SCALE * x + _ONE a power of e, linear between powers of two: the bits of the float are made from the exponent, at a quarter of exp's cost. Ends bits."""
    np.clip(bits, _LOW, _HIGH, out=bits)
    return bits.astype(np.int32).view(_f4)


def fresh(prior: np.ndarray, last: np.ndarray) -> Params:
    """Parameters to begin with. prior: the frequency of each token, the last one that of each unseen token; last: whether a token ends a word.
    Inputs have one more row, for the place before a document."""
    rng = np.random.default_rng(7)
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(_f4)
    n = len(prior)
    p = {"qkv": r(WIDTH, 3 * HEAD), "o": r(HEAD, WIDTH), "near": np.zeros(SPAN, _f4), "u": r(WIDTH, PARTS), "b": np.zeros(PARTS, _f4)}
    p["qkv"][:, :HEAD] *= _f4(HEAD**-0.5)
    p["embed"] = (0.5 * rng.standard_normal((n + 1, WIDTH))).astype(_f4)
    p["embed"][:n, 0] = np.where(last, 1, -1)
    p["embed"][n - 1 :] = 0
    p["counts"] = (200 * prior[:, None] * np.exp(1.5 * rng.standard_normal((n, PARTS)))).astype(_f4)
    p["counts"][-1] = 0
    return p


def parts(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The distributions: a column for each part. The last row is the probability of each unseen token."""
    t = counts + _f4(SMOOTH) * prior[:, None].astype(_f4)
    return (t / (counts.sum(0, dtype=np.float64) + SMOOTH)).astype(_f4)


def padded(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (ids one after another, and their sizes) as rows of SPAN + 1 tokens: a view, where each window begins in it, and its document. -1 stands
    for what is before or after a document."""
    many = -(-size // TARGETS)
    room = BEFORE + 1 + many * TARGETS
    at = np.cumsum(room) - room
    out = np.full(int(room.sum()) + SPAN + 1, -1, np.int32)
    out[np.arange(len(ids)) + np.repeat(at + BEFORE + 1 - (np.cumsum(size) - size), size)] = ids
    doc = np.repeat(np.arange(len(size)), many)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return sliding_window_view(out, SPAN + 1), at[doc] + number * TARGETS, doc


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def _forward(p: Params, theta: np.ndarray, rows: np.ndarray):
    b = len(rows)
    x = rows[:, :SPAN]
    x = np.where(x < 0, len(theta), x)
    y = rows[:, BEFORE + 1 :].ravel()
    ok, y = (y >= 0).astype(_f4), np.maximum(y, 0)
    e = np.take(p["embed"], x, 0, mode="clip")
    w = p["qkv"].copy()
    w[:, :HEAD] *= _SCALE
    qkv = (_flat(e) @ w).reshape(b, SPAN, 3 * HEAD)
    q, k, v = qkv[:, BEFORE:, :HEAD], qkv[:, :, HEAD : 2 * HEAD], np.empty((b, SPAN, HEAD + 1), _f4)
    v[:, :, :HEAD], v[:, :, HEAD] = qkv[:, :, 2 * HEAD :], 1
    s = q @ k.transpose(0, 2, 1)
    s += p["near"][_back] * _SCALE + _ONE
    s = _exp(s)
    s *= _seen
    m = _flat(s @ v)
    total = 1 / m[:, HEAD:]
    mixed = m[:, :HEAD] * total
    h = mixed @ p["o"]
    h += _flat(e[:, BEFORE:])
    z = h @ (p["u"] * _SCALE)
    z += p["b"] * _SCALE + _ONE
    z = _exp(z)
    t = np.take(theta, y, 0, mode="clip")
    t *= z
    return x, y, ok, e, qkv, q, k, v, s, total, mixed, h, z, t, t @ _ones, z @ _ones


def log_probs(p: Params, theta: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithms of the targets' probabilities, windows by TARGETS; 0 beyond a document's end."""
    *_, num, den = f = _forward(p, theta, rows)
    return (np.log(num / den) * f[2]).reshape(len(rows), TARGETS)


def _sums(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the sums of their rows, and how many there are."""
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")
    k, rows = key[order], np.take(rows, order, 0)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.append(first, len(k)))
    often = np.flatnonzero(n >= MANY)
    seldom = np.flatnonzero(n < MANY)
    out = np.empty((len(first), rows.shape[1]), _f4)
    for x in often:  # few keys with most of the rows
        np.matmul(_many[: n[x]] if n[x] <= len(_many) else np.ones(n[x], _f4), rows[first[x] : first[x] + n[x]], out=out[x])
    if len(seldom):
        rest = np.repeat(n < MANY, n)
        stop = np.cumsum(n[seldom])
        out[seldom] = np.add.reduceat(rows[rest], stop - n[seldom], axis=0)
    return k[first], out, n


def gradients(p: Params, theta: np.ndarray, rows: np.ndarray):
    """Of the targets' summed loss: those of the small parameters, those of embeddings as (row, gradient, times), the targets with their parts' shares, and the number of targets."""
    x, y, ok, e, qkv, q, k, v, s, total, mixed, h, z, t, num, den = _forward(p, theta, rows)
    b = len(rows)
    t *= (ok / num)[:, None]
    z *= (ok / den)[:, None]
    z -= t
    d: Params = {"u": h.T @ z, "b": z.sum(0)}
    dh = z @ p["u"].T
    d["o"] = mixed.T @ dh
    g = np.empty((len(dh), HEAD + 1), _f4)
    np.multiply(dh @ p["o"].T, total, out=g[:, :HEAD])
    g[:, HEAD] = -np.einsum("nk,nk->n", g[:, :HEAD], mixed)
    g = g.reshape(b, TARGETS, HEAD + 1)
    dqkv = np.zeros_like(qkv)
    dqkv[:, :, 2 * HEAD :] = (s.transpose(0, 2, 1) @ g)[:, :, :HEAD]
    ds = g @ v.transpose(0, 2, 1)
    ds *= s
    d["near"] = np.bincount(_back.ravel(), ds.sum(0).ravel(), SPAN).astype(_f4)
    dqkv[:, BEFORE:, :HEAD] = ds @ k
    dqkv[:, :, HEAD : 2 * HEAD] = ds.transpose(0, 2, 1) @ q * (1 / _SCALE)
    d["qkv"] = _flat(e).T @ _flat(dqkv)
    de = (_flat(dqkv) @ p["qkv"].T).reshape(b, SPAN, WIDTH)
    de[:, BEFORE:] += dh.reshape(b, TARGETS, WIDTH)
    return d, _sums(x.ravel(), _flat(de)), (y, t), float(ok.sum())


class Trainer:
    """One task's part of a round. The small parameters move by Adam, embeddings by Adagrad for each row, the parts by their counts."""

    BATCH, RATE, ROW_RATE, FIRST, MOST = 128, 0.02, 0.2, 20_000, 400_000

    def __init__(self, p: Params, prior: np.ndarray, fade: bool):
        """fade: counts of the first steps are forgotten by and by, as they are of parts that have not found their place yet."""
        self.p, self.prior = {k: v.copy() for k, v in p.items()}, prior
        self.theta = parts(self.p["counts"], prior)
        self.small = [k for k in p if k not in ("embed", "counts")]
        self.m, self.s = ({k: np.zeros_like(p[k]) for k in self.small} for _ in range(2))
        self.squares, self.times = np.full(len(p["embed"]), 1e-8, _f4), np.zeros(len(p["embed"]))
        self.t, self.seen, self.since, self.every, self.fade = 0, 0.0, 0.0, self.FIRST, 10 if fade else 0
        self.shares: list[tuple[np.ndarray, np.ndarray]] = []

    def step(self, rows: np.ndarray, rate: float) -> None:
        d, (row, g, n), shares, seen = gradients(self.p, self.theta, rows)
        if not seen:
            return
        self.t += 1
        adam = _f4(self.RATE * rate * np.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t))
        one = _f4(1 / seen)
        for k in self.small:
            v = d[k] * one
            self.m[k] += _f4(0.1) * (v - self.m[k])
            self.s[k] += _f4(0.02) * (v * v - self.s[k])
            self.p[k] -= adam * self.m[k] / (np.sqrt(self.s[k]) + _f4(1e-8))
        g *= one
        self.squares[row] += (g * g).mean(1)
        self.p["embed"][row] -= _f4(self.ROW_RATE * rate) * g / np.sqrt(self.squares[row])[:, None]
        self.times[row] += n
        self.shares.append(shares)
        self.seen += seen
        self.since += seen
        if len(self.shares) == 8:
            self._count()
        if self.since >= self.every:
            self._count()
            self.theta = parts(self.p["counts"], self.prior)
            if self.fade:
                self.p["counts"] *= _f4(0.5)
                self.fade -= 1
            self.since, self.every = 0.0, min(self.MOST, int(self.every * 1.3))

    def _count(self) -> None:
        if self.shares:
            y, c, _ = _sums(*map(np.concatenate, zip(*self.shares)))
            self.p["counts"][y] += c
            self.shares.clear()

    def packed(self) -> np.ndarray:
        """Sums over tasks of these make the next round's parameters, by `unpacked`."""
        self._count()
        times = self.times[:, None]
        all_ = [[self.seen], *(self.p[k].ravel() * self.seen for k in self.small), (self.p["embed"] * times).ravel(), self.times, self.p["counts"].ravel()]
        return np.concatenate(all_).astype(_f4)


def unpacked(total: np.ndarray, before: Params, keep: float) -> Params:
    """The means of the tasks' parameters: of the small ones by targets, of each embedding by how often its token occurred; and the
    parts' counts, brought to `keep` tokens at most."""
    total, p, at = total.astype(np.float64), {}, 1
    seen = total[0]
    if not seen:
        return before
    for k in [k for k in before if k not in ("embed", "counts")]:
        p[k] = (total[at : at + before[k].size] / seen).reshape(before[k].shape).astype(_f4)
        at += before[k].size
    e, n = before["embed"], len(before["embed"])
    sums, times = total[at : at + e.size].reshape(e.shape), total[at + e.size : at + e.size + n]
    p["embed"] = np.where(times[:, None] > 0, sums / np.maximum(times, 1)[:, None], e).astype(_f4)
    c = total[at + e.size + n :].reshape(before["counts"].shape)
    p["counts"] = (c * min(1.0, keep / max(c.sum(), 1.0))).astype(_f4)
    return p
