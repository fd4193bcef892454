"""Bidirectional gated recurrent network over the bytes of documents, in numpy.

A sequence is a stretch of one document: ``CORE`` bytes of its own with ``EDGE`` bytes of the document on either side as
context (blanks beyond its ends), so neighbouring stretches overlap and every byte of a text is labelled once, in its order.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 8
CORE, EDGE = 224, 16
#: Stretches that run together; more rows don't run faster.
GROUP = 1024


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(classes: int, seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = (rng.standard_normal((256, 3 * HIDDEN)) * 0.3).astype(np.float32)
        p["h" + d] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        p["c" + d] = np.zeros(3 * HIDDEN, np.float32)
    p["out"] = (rng.standard_normal((2 * HIDDEN, classes)) * 0.1).astype(np.float32)
    p["bias"] = np.zeros(classes, np.float32)
    return p


def _run(p, d, m):
    """States of one direction, time first (T, B, H), and what the way back needs."""
    x, u, c = p["x" + d], p["h" + d], p["c" + d]
    h = np.zeros((len(m), HIDDEN), x.dtype)
    out, kept = np.empty((m.shape[1], len(m), HIDDEN), x.dtype), []
    for t in range(m.shape[1]):
        a, g = x[m[:, t]], h @ u + c
        zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * gn)
        kept.append((h, z, r, n, gn))
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def _softmax(logit, axis=-1):
    logit -= logit.max(axis, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis, keepdims=True)
    return logit


def forward(p, m):
    """Label probabilities (T, B, C) of every position of byte rows (B, T), and the states."""
    f, kf = _run(p, "f", m)
    b, kb = _run(p, "b", m[:, ::-1])
    s = np.concatenate([f, b[::-1]], 2)
    return _softmax(s @ p["out"] + p["bias"]), (s, kf, kb)


def _through_time(p, d, m, kept, dout, grad):
    u = p["h" + d]
    dx, du, dc = np.zeros_like(p["x" + d]), np.zeros_like(u), np.zeros_like(p["c" + d])
    dh = np.zeros_like(dout[0])
    for t in range(m.shape[1] - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        np.add.at(dx, m[:, t], da)
        du += h.T @ dg
        dc += dg.sum(0)
        dh = dh * z + dg @ u.T
    grad["x" + d], grad["h" + d], grad["c" + d] = dx, du, dc


def gradients(p, m, on, label):
    """Mean cross-entropy over the positions that count (``on``, B x T) and its gradients, by backpropagation through time."""
    prob, (s, kf, kb) = forward(p, m)
    weight = on.T.astype(prob.dtype)
    total = max(1, weight.sum())
    rows = np.arange(len(m))
    own = prob[:, rows, label]
    loss = -(np.log(own + 1e-9) * weight).sum() / total
    d = prob.copy()
    d[:, rows, label] -= 1
    d *= weight[:, :, None] / total
    grad = {"out": np.tensordot(s, d, ((0, 1), (0, 1))), "bias": d.sum((0, 1))}
    ds = d @ p["out"].T
    _through_time(p, "f", m, kf, ds[:, :, :HIDDEN], grad)
    _through_time(p, "b", m[:, ::-1], kb, ds[::-1, :, HIDDEN:], grad)
    return loss, grad


def train(texts: list[bytes], labels: np.ndarray, classes: int, steps: int = 180, batch: int = 160, width: int = 64, rate: float = 0.012, seed: int = 1) -> dict:
    """Fit by Adam on mini-batches of stretches from anywhere in the texts; the same input gives the same weights."""
    p = init(classes, seed)
    if not texts or classes < 2:
        return p
    padded = [np.frombuffer(b" " * EDGE + t + b" " * max(EDGE, width - len(t)), np.uint8) for t in texts]
    rng = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(padded), batch)
        at = (rng.random(batch) * [len(padded[i]) - width + 1 for i in pick]).astype(int)
        m = np.stack([padded[i][a : a + width] for i, a in zip(pick.tolist(), at.tolist(), strict=True)])
        _, g = gradients(p, m, is_letter(m), labels[pick])
        lr = rate * min(1, 3 * (1 - step / (steps + 1)))
        for k in p:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] * g[k] - m2[k])
            p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def is_letter(data: np.ndarray) -> np.ndarray:
    low = data | 32
    return (data >= 128) | ((low >= 97) & (low <= 122))


def _scores(p, d, m):
    """Each position's share of the label scores from one direction (T, C, B) of byte columns (T, B); one step's states are held.

    Units come first, so every gate is one stretch of memory.  sigmoid(x) = (tanh(x / 2) + 1) / 2; its halves are in the weights.
    """
    H, b = HIDDEN, m.shape[1]
    x = p["x" + d].T.copy()
    x[: 2 * H] = (x[: 2 * H] + p["c" + d][: 2 * H, None]) * 0.5
    u = np.concatenate([p["h" + d].T, np.zeros((3 * H, 1), np.float32)], 1) * np.float32(0.5)
    u[2 * H :, H] = p["c" + d][2 * H :] * 0.5
    w = np.ascontiguousarray((p["out"][:H] if d == "f" else p["out"][H:]).T)
    out = np.empty((len(m), len(w), b), np.float32)
    state = np.zeros((H + 1, b), np.float32)
    state[H] = 1  # for the bias
    h, a, g = state[:H], np.empty((3 * H, b), np.float32), np.empty((3 * H, b), np.float32)
    zr, z, r, n, gn = a[: 2 * H], a[:H], a[H : 2 * H], a[2 * H :], g[2 * H :]
    for t in range(len(m)) if d == "f" else range(len(m) - 1, -1, -1):
        np.take(x, m[t], 1, out=a, mode="clip")
        np.matmul(u, state, out=g)
        zr += g[: 2 * H]
        np.tanh(zr, out=zr)
        zr += 1
        gn *= r
        n += gn
        np.tanh(n, out=n)
        h -= n
        z *= 0.5
        h *= z
        h += n
        np.matmul(w, h, out=out[t])
    return out


def document_scores(p, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bytes: label probabilities summed over its letter bytes, and the number of those."""
    size = np.diff(offsets)
    classes = len(p["bias"])
    total, count = np.zeros((len(size), classes)), np.zeros(len(size), np.int64)
    n = -(-size // CORE)
    row = np.repeat(np.arange(len(size)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * CORE
    core = np.minimum(size[row] - start, CORE)
    width = -(-core // 32) * 32  # few widths, so that stretches of like length run together
    order = np.argsort(width, kind="stable")
    edges = np.flatnonzero(np.diff(width[order])) + 1
    for own in np.split(order, edges):
        for at in range(0, len(own), GROUP):
            k = own[at : at + GROUP]
            place = start[k, None] + np.arange(-EDGE, int(width[k[0]]) + EDGE)[None, :] if len(k) else np.zeros((0, 0), np.int64)
            if not place.size:
                continue
            inside = (place >= 0) & (place < size[row[k], None])
            m = np.where(inside, data[np.clip(place + offsets[row[k], None], 0, max(len(data) - 1, 0))], 32).astype(np.uint8)
            steps = np.ascontiguousarray(m.T).astype(np.intp)
            logit = _scores(p, "f", steps)
            logit += _scores(p, "b", steps)
            logit += p["bias"][:, None]
            mine = np.arange(m.shape[1])[None, :] - EDGE
            on = is_letter(m) & (mine >= 0) & (mine < core[k, None])
            prob = _softmax(logit, 1)
            prob *= on.T[:, None, :]
            np.add.at(total, row[k], prob.sum(0).T)
            np.add.at(count, row[k], on.sum(1))
    return total, count
