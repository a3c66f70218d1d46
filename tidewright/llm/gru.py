"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A word's input vector is its own embedding (for words of the vocabulary) plus the
mean of the embeddings of its character n-grams, so words never seen still have
one.  ``backward`` is written by hand; tests hold it against differences.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def grams(word: str, sizes: tuple[int, ...] = (3, 4)) -> list[str]:
    """Character n-grams of a word with marks at its ends."""
    w = f"^{word}$"
    return [w[i : i + n] for n in sizes for i in range(len(w) - n + 1)] or [w]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh_params(n_words: int, n_grams: int, seed: int = 7, dim: int = 12, hidden: int = 10, attend: int = 8) -> Params:
    rng = np.random.default_rng(seed)
    scaled = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"words": 0.1 * rng.standard_normal((n_words, dim)).astype(np.float32), "grams": 0.3 * rng.standard_normal((n_grams, dim)).astype(np.float32)}
    p["words"][0] = p["grams"][0] = 0  # unknown
    for d in "fb":
        p |= {f"W{d}": scaled(dim, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32), f"U{d}": scaled(hidden, 3 * hidden)}
    return p | {"A": scaled(2 * hidden, attend), "v": scaled(attend, 1), "o": scaled(2 * hidden, 1), "c": np.full(1, -1, np.float32)}


def _scan(p: Params, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, H) in one direction; x is (T, B, D), mask (T, B, 1)."""
    steps, lanes, _ = x.shape
    U = p[f"U{d}"]
    hidden = U.shape[0]
    put = (x.reshape(-1, x.shape[2]) @ p[f"W{d}"] + p[f"b{d}"]).reshape(steps, lanes, -1)
    out, h, cache = np.empty((steps, lanes, hidden), np.float32), np.zeros((lanes, hidden), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        hu = h @ U
        gates = _sigmoid(put[t, :, : 2 * hidden] + hu[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        n = np.tanh(put[t, :, 2 * hidden :] + r * hu[:, 2 * hidden :])
        if keep:
            cache.append((t, h, z, r, n, hu[:, 2 * hidden :]))
        h = h + mask[t] * ((1 - z) * (n - h))
        out[t] = h
    return out, cache


def forward(p: Params, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Logits of windows; x (T, B, D) float32, mask (T, B) 0 or 1."""
    m = mask[:, :, None].astype(np.float32)
    (hf, cf), (hb, cb) = _scan(p, "f", x, m, keep), _scan(p, "b", x, m, keep)
    h = np.concatenate([hf, hb], 2)
    a = np.tanh(h @ p["A"])
    e = (a @ p["v"])[:, :, 0] - 1e4 * (1 - m[:, :, 0])
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbh->bh", w, h)
    return (pooled @ p["o"])[:, 0] + p["c"][0], (x, m, cf, cb, h, a, w, pooled) if keep else None


def backward(p: Params, cache: tuple, dlogit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters (without the embeddings) and of x."""
    x, m, cf, cb, h, a, w, pooled = cache
    g = {"o": pooled.T @ dlogit[:, None], "c": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["o"][:, 0]
    dw = np.einsum("bh,tbh->tb", dpooled, h)
    de = w * (dw - (w * dw).sum(0))
    g["v"] = np.einsum("tba,tb->a", a, de)[:, None]
    da = de[:, :, None] * p["v"][:, 0] * (1 - a * a)
    g["A"] = np.einsum("tbh,tba->ha", h, da)
    dh = w[:, :, None] * dpooled + da @ p["A"].T
    hidden, dx = p["Uf"].shape[0], np.zeros_like(x)
    for d, steps, part in (("f", cf, dh[:, :, :hidden]), ("b", cb, dh[:, :, hidden:])):
        U, W = p[f"U{d}"], p[f"W{d}"]
        dU, dput, carry = np.zeros_like(U), np.zeros((*x.shape[:2], 3 * hidden), np.float32), np.zeros(part.shape[1:], np.float32)
        for t, before, z, r, n, un in reversed(steps):
            now = part[t] + carry
            dn_ = m[t] * now
            carry = now - dn_ + dn_ * z
            dz, dn = dn_ * (before - n) * z * (1 - z), dn_ * (1 - z) * (1 - n * n)
            dr = dn * un * r * (1 - r)
            dput[t] = np.concatenate([dz, dr, dn], 1)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            dU += before.T @ dhu
            carry = carry + dhu @ U.T
        flat = dput.reshape(-1, 3 * hidden)
        g |= {f"U{d}": dU, f"W{d}": x.reshape(-1, x.shape[2]).T @ flat, f"b{d}": flat.sum(0)}
        dx += (flat @ W.T).reshape(x.shape)
    return g, dx


class Adam:
    def __init__(self, p: Params, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, p: Params, g: Params) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)
