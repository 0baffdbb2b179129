"""A character tagger: bidirectional LSTM with CRF transitions, trained in numpy."""
from __future__ import annotations

import numpy as np

#: Characters with an embedding of their own; letters, digits and others elsewhere share one each.
OWN = {chr(i): i - 27 for i in range(32, 127)} | {"\n": 3, "\t": 4}
PAD, LETTER, OTHER, SIZE = 0, 1, 2, 100
HIDDEN, EMBED = 16, 12


def codes(text: str) -> np.ndarray:
    return np.array([OWN.get(c) or (LETTER if c.isalpha() else OTHER) for c in text], np.int64)


def fresh(tags: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights before training; each direction has gates in the order input, forget, output, new value."""
    rng = np.random.default_rng(seed)

    def w(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    p = {"E": rng.normal(0, 0.3, (SIZE, EMBED)), "O": w(2 * HIDDEN, tags), "c": np.zeros(tags), "A": np.zeros((tags, tags)), "s": np.zeros(tags), "e": np.zeros(tags)}
    for d in "fb":
        p |= {f"W{d}": w(EMBED, 4 * HIDDEN), f"U{d}": w(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    return p


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x, u):
    """x: gates' input (time, batch, 4 hidden).  Outputs, and what the way back needs."""
    t, b, _ = x.shape
    h, c = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
    out, kept = np.empty((t, b, HIDDEN)), []
    for i in range(t):
        g = x[i] + h @ u
        s = _sigmoid(g[:, :3 * HIDDEN])
        new = np.tanh(g[:, 3 * HIDDEN:])
        before, past = c, h
        c = s[:, HIDDEN:2 * HIDDEN] * c + s[:, :HIDDEN] * new
        tc = np.tanh(c)
        h = s[:, 2 * HIDDEN:] * tc
        out[i] = h
        kept.append((s, new, before, past, tc))
    return out, kept


def _lstm_back(dout, kept, u):
    dx, du = np.empty((*dout.shape[:2], 4 * HIDDEN)), np.zeros_like(u)
    dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
    for i in range(len(kept) - 1, -1, -1):
        s, new, before, past, tc = kept[i]
        a, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
        dh = dh + dout[i]
        dc = dc + dh * o * (1 - tc * tc)
        g = dx[i]
        g[:, :HIDDEN] = dc * new * a * (1 - a)
        g[:, HIDDEN:2 * HIDDEN] = dc * before * f * (1 - f)
        g[:, 2 * HIDDEN:3 * HIDDEN] = dh * tc * o * (1 - o)
        g[:, 3 * HIDDEN:] = dc * a * (1 - new * new)
        du += past.T @ g
        dh, dc = g @ u.T, dc * f
    return dx, du


def _scores(p, x):
    e = p["E"][x]
    f, kf = _lstm(e @ p["Wf"] + p["bf"], p["Uf"])
    b, kb = _lstm((e @ p["Wb"] + p["bb"])[::-1], p["Ub"])
    both = np.concatenate([f, b[::-1]], axis=2)
    return both @ p["O"] + p["c"], (e, both, kf, kb)


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_slopes(p, x, y):
    """Mean negative log likelihood of the tags y (time, batch) for the codes x, and its slopes."""
    t, n = x.shape
    em, (e, both, kf, kb) = _scores(p, x)
    k, rows = em.shape[2], np.arange(n)
    alpha, beta = np.empty_like(em), np.empty_like(em)
    alpha[0], beta[-1] = p["s"] + em[0], p["e"]
    for i in range(1, t):
        alpha[i] = em[i] + _lse(alpha[i - 1][:, :, None] + p["A"], 1)
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(p["A"] + (em[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _lse(alpha[-1] + p["e"], 1)
    good = p["s"][y[0]] + p["e"][y[-1]] + em[np.arange(t)[:, None], rows, y].sum(0) + p["A"][y[:-1], y[1:]].sum(0)
    marginal = np.exp(alpha + beta - z[:, None])
    one = np.eye(k)[y]
    dem = (marginal - one) / n
    pair = np.zeros((k, k))
    for i in range(1, t):
        pair += np.exp(alpha[i - 1][:, :, None] + p["A"] + (em[i] + beta[i] - z[:, None])[:, None, :]).sum(0)
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    g = {"A": pair / n, "s": dem[0].sum(0), "e": (marginal[-1] - one[-1]).sum(0) / n, "c": dem.sum((0, 1)), "O": np.tensordot(both, dem, ((0, 1), (0, 1)))}
    dboth = dem @ p["O"].T
    de = np.zeros_like(e)
    for d, out, kept in (("f", dboth[:, :, :HIDDEN], kf), ("b", dboth[::-1, :, HIDDEN:], kb)):
        dx, du = _lstm_back(out, kept, p[f"U{d}"])
        own = e if d == "f" else e[::-1]
        g |= {f"U{d}": du, f"W{d}": np.tensordot(own, dx, ((0, 1), (0, 1))), f"b{d}": dx.sum((0, 1))}
        back = dx @ p[f"W{d}"].T
        de += back if d == "f" else back[::-1]
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], x.ravel(), de.reshape(-1, EMBED))
    return float((z - good).mean()), g


def train(x: np.ndarray, y: np.ndarray, tags: int, steps: int = 160, batch: int = 96, rate: float = 0.02, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights after ``steps`` of Adam over random batches of the windows x with tags y (windows, length)."""
    p, rng = fresh(tags, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(batch, len(x)))
        _, g = loss_and_slopes(p, x[pick].T, y[pick].T)
        norm = np.sqrt(sum((s * s).sum() for s in g.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            s = g[k] * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * s
            v[k] = 0.99 * v[k] + 0.01 * s * s
            p[k] = p[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return p


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The best tags of windows x (windows, length), by Viterbi."""
    em, _ = _scores(p, x.T)
    t, n, k = em.shape
    best, back = p["s"] + em[0], np.empty((t, n, k), np.int8)
    for i in range(1, t):
        all_ = best[:, :, None] + p["A"]
        back[i] = all_.argmax(1)
        best = all_.max(1) + em[i]
    out = np.empty((t, n), np.int64)
    out[-1] = (best + p["e"]).argmax(1)
    for i in range(t - 1, 0, -1):
        out[i - 1] = back[i][np.arange(n), out[i]]
    return out.T
