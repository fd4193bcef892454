"""Character tagger in numpy: bidirectional LSTM emissions and a linear-chain CRF over the labels."""

from __future__ import annotations

import numpy as np

#: Units a side.  Held-out recall of loose forms at 8, 16 and 24 units: see the README.
HIDDEN = 8
SYMBOLS = 99


def symbols(text: str) -> np.ndarray:
    """Printable ASCII one by one, then line end, other white space, other letters, anything else."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out = np.where((code >= 32) & (code < 127), code - 32, 98)
    out[code == 10] = 95
    out[(code == 9) | (code == 13) | (code == 0xA0)] = 96
    out[code >= 0xC0] = 97
    return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(labels: int, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    p = {"trans": np.zeros((labels, labels)), "begin": np.zeros(labels), "out": rng.standard_normal((2 * HIDDEN, labels)) * 0.1, "bias": np.zeros(labels)}
    for d in "fb":
        p["x" + d] = rng.standard_normal((SYMBOLS, 4 * HIDDEN)) * 0.3
        p["h" + d] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        p["c" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # remember at first
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p, d, m, keep):
    x, u, bias = p["x" + d], p["h" + d], p["c" + d]
    b, steps, H = m.shape[0], m.shape[1], HIDDEN
    h, c = np.zeros((b, H), np.float32), np.zeros((b, H), np.float32)
    out, kept = np.empty((steps, b, H), np.float32), []
    for t in range(steps):
        a = x[m[:, t]] + h @ u + bias
        g = _sigmoid(a[:, : 3 * H])
        f, i, o, n = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :], np.tanh(a[:, 3 * H :])
        new = f * c + i * n
        s = np.tanh(new)
        if keep:
            kept.append((h, c, f, i, o, n, s))
        h, c = o * s, new
        out[t] = h
    return out, kept


def emissions(p, m, keep=False):
    """Label scores (T, B, L) of windows of one length (B, T)."""
    f, kf = _run(p, "f", m, keep)
    b, kb = _run(p, "b", m[:, ::-1], keep)
    s = np.concatenate([f, b[::-1]], 2)
    return s @ p["out"] + p["bias"], (s, kf, kb)


def _through_time(p, d, m, kept, dout, grad):
    H, u = HIDDEN, p["h" + d]
    dx, du, db = np.zeros_like(p["x" + d]), np.zeros_like(u), np.zeros_like(p["c" + d])
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(m.shape[1] - 1, -1, -1):
        h, c, f, i, o, n, s = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - s * s)
        da = np.concatenate([dc * c * f * (1 - f), dc * n * i * (1 - i), dh * s * o * (1 - o), dc * i * (1 - n * n)], 1)
        np.add.at(dx, m[:, t], da)
        du += h.T @ da
        db += da.sum(0)
        dh, dc = da @ u.T, dc * f
    grad["x" + d], grad["h" + d], grad["c" + d] = dx, du, db


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradients(p, m, y):
    """Mean negative log-likelihood of label rows ``y`` (B, T) and its gradients."""
    e, (s, kf, kb) = emissions(p, m, keep=True)
    steps, b, n_labels = e.shape
    A = p["trans"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["begin"]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + A[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(A[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    own = np.arange(b)
    gold = p["begin"][y[:, 0]] + e[0, own, y[:, 0]]
    for t in range(1, steps):
        gold = gold + A[y[:, t - 1], y[:, t]] + e[t, own, y[:, t]]
    loss = float((z - gold).mean()) / steps
    d = np.exp(alpha + beta - z[None, :, None])
    dA = np.zeros_like(A)
    for t in range(1, steps):
        dA += np.exp(alpha[t - 1][:, :, None] + A[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dA, (y[:, t - 1], y[:, t]), -1)
    dbegin = d[0].sum(0)
    np.add.at(dbegin, y[:, 0], -1)
    d[np.arange(steps)[:, None], own[None, :], y.T] -= 1
    scale = np.float32(1 / (b * steps))
    d *= scale
    grad = {"trans": dA * scale, "begin": dbegin * scale, "out": np.tensordot(s, d, ((0, 1), (0, 1))), "bias": d.sum((0, 1))}
    ds = d @ p["out"].T
    _through_time(p, "f", m, kf, ds[:, :, :HIDDEN], grad)
    _through_time(p, "b", m[:, ::-1], kb, ds[::-1, :, HIDDEN:], grad)
    return loss, grad


def train(m, y, labels, steps=400, batch=64, rate=0.015, seed=7):
    """Fit by Adam on mini-batches of windows; the same input gives the same weights."""
    p = init(labels, seed)
    rng = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(m) else 0):
        pick = rng.integers(0, len(m), batch)
        _, g = gradients(p, m[pick], y[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        lr = rate * min(1, 3 * (1 - step / (steps + 1)))
        for k in p:
            x = g[k] * min(1, 1 / (norm + 1e-9))
            m1[k] += 0.1 * (x - m1[k])
            m2[k] += 0.01 * (x * x - m2[k])
            p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _scores(p, d, m, e):
    """Each position's share of the label scores from one direction, of symbol columns (T, B): set in ``e`` (T, L, B) forwards, added to it
    backwards.  One step's states are held.

    Units come first, so every gate is one stretch of memory.  sigmoid(x) = (tanh(x / 2) + 1) / 2: the inner half is in the weights, the outer
    one of the last gate in those of the next step, as ``h`` is held doubled.  One product gives a step's scores and the next step's input.
    """
    H, b = HIDDEN, m.shape[1]
    half = np.concatenate([np.full(3 * H, 0.5, np.float32), np.ones(H, np.float32)])
    x = np.ascontiguousarray(((p["x" + d] + p["c" + d]) * half).T)
    w = p["out"][:H] if d == "f" else p["out"][H:]
    u = np.ascontiguousarray(np.concatenate([p["h" + d] * half, w], 1).T) * np.float32(0.5)
    h, c = np.zeros((H, b), np.float32), np.zeros((H, b), np.float32)
    a, g = np.empty((4 * H, b), np.float32), np.zeros((len(u), b), np.float32)
    gates, f, i, o, n = a[: 3 * H], a[:H], a[H : 2 * H], a[2 * H : 3 * H], a[3 * H :]
    back, own = g[: 4 * H], g[4 * H :]
    for t in range(len(m)) if d == "f" else range(len(m) - 1, -1, -1):
        np.take(x, m[t], 1, out=a, mode="clip")
        a += back
        np.tanh(a, out=a)
        gates += 1
        c *= f
        n *= i
        c += n
        c *= 0.5
        np.tanh(c, out=h)
        h *= o
        np.matmul(u, h, out=g)
        if d == "f":
            e[t] = own
        else:
            e[t] += own


def best(p, e):
    """Best label columns (T, B) of scores (T, L, B)."""
    steps, n, b = e.shape
    back = np.zeros((steps, n, b), np.int8)
    score = e[0] + p["begin"][:, None]
    most, some, better = np.empty_like(score), np.empty_like(score), np.empty((n, b), bool)
    for t in range(1, steps):
        np.add(score[0], p["trans"][0][:, None], out=most)
        for j in range(1, n):
            np.add(score[j], p["trans"][j][:, None], out=some)
            np.greater(some, most, out=better)
            np.copyto(most, some, where=better)
            np.copyto(back[t], j, where=better)
        np.add(most, e[t], out=score)
    y = np.empty((steps, b), np.int8)
    own = np.arange(b)
    y[-1] = score.argmax(0)
    for t in range(steps - 1, 0, -1):
        y[t - 1] = back[t, y[t], own]
    return y


def open_rows(p, m):
    """Of symbol rows (B, T): which need a search for their best labels, and the scores (T, L, those) of these.

    A path differs from label 0 throughout by its spans, the runs of other labels.  A span gains at most, over its places, the most that any
    other label has over label 0 with the best step into it from such a label, and what its first step (from label 0, or as a row's
    beginning) and its last one (back to 0, or none at a row's end) give besides.  If no span of a row can gain, its best path has 0 throughout.
    """
    columns = np.ascontiguousarray(m.T).astype(np.intp)
    e = np.empty((len(columns), len(p["bias"]), len(m)), np.float32)
    _scores(p, "f", columns, e)
    _scores(p, "b", columns, e)
    e += p["bias"][:, None]
    A, begin = p["trans"], p["begin"]
    stay = A[1:, 1:].max(0) - A[0, 0]
    enter, leave = float((A[0, 1:] - A[0, 0] - stay).max()), float((A[1:, 0] - A[0, 0]).max())
    gain = e[:, 1] + stay[0]
    some = np.empty_like(gain)
    for j in range(2, e.shape[1]):
        np.add(e[:, j], stay[j - 1], out=some)
        np.maximum(gain, some, out=gain)
    gain -= e[:, 0]
    gain[0] += float((begin[1:] - begin[0] - stay).max())
    most = gain[0].copy()
    for t in range(1, len(gain)):  # from here on gain is that of the best span which ends at a place
        np.maximum(gain[t - 1], enter, out=some[0])
        gain[t] += some[0]
        np.maximum(most, gain[t], out=most)
    # rounding is far below the margin
    found = np.flatnonzero(np.maximum(most + leave, gain[-1]) >= -1e-3)
    return found, e[:, :, found]


def decode(p, m):
    """Best label rows (B, T) under the CRF of symbol rows (B, T)."""
    y = np.zeros(m.shape, np.int8)
    found, e = open_rows(p, m)
    if len(found):
        y[found] = best(p, e).T
    return y
