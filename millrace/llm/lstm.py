"""A bidirectional LSTM with a logistic output for sequences of rows, in numpy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]
#: Rows of a sequence whose inputs are weighed at once.
ROWS = 1024


def fresh(inputs: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    out = {}
    for side in ("f", "b"):
        out[f"x{side}"] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
        out[f"h{side}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        out[f"c{side}"] = np.zeros(4 * hidden, np.float32)
        out[f"c{side}"][hidden : 2 * hidden] = 1  # the forget gate begins open
    out["out"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
    out["skip"] = np.zeros(inputs, np.float32)
    out["bias"] = np.zeros(1, np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(w: Weights, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction. x: time, batch, inputs; where mask is 0 the state stays as it is."""
    hidden = w[f"h{side}"].shape[0]
    h = np.zeros((x.shape[1], hidden), np.float32)
    c = np.zeros_like(h)
    out = np.empty((*x.shape[:2], hidden), np.float32)
    pre, low, high = None, 0, 0  # the inputs' part of the rows low to high
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        if not low <= t < high:
            low = t // ROWS * ROWS
            high = low + ROWS
            pre = x[low:high] @ w[f"x{side}"] + w[f"c{side}"]
        z = pre[t - low] + h @ w[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        s = np.tanh(c2)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, s, m))
        c = m * c2 + (1 - m) * c
        h = m * (o * s) + (1 - m) * h
        out[t] = h
    return out


def forward(w: Weights, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The log odds of each row; x: time, batch, inputs; mask: time, batch."""
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    both = np.concatenate([_pass(w, side, x, mask, kept[side]) for side in ("f", "b")], axis=2)
    if keep is not None:
        keep.update(kept, both=both)
    return both @ w["out"] + x @ w["skip"] + w["bias"]


def gradient(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean logistic loss over the rows of the mask, and its gradient."""
    keep: dict = {}
    odds = forward(w, x, mask, keep)
    n = mask.sum()
    d_odds = (_sigmoid(odds) - y) * mask / n
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.einsum("tb,tbh->h", d_odds, keep["both"])
    g["skip"] = np.einsum("tb,tbi->i", d_odds, x)
    g["bias"] = d_odds.sum(keepdims=True).reshape(1)
    hidden = w["hf"].shape[0]
    for k, side in enumerate(("f", "b")):
        d_states = d_odds[:, :, None] * w["out"][k * hidden : (k + 1) * hidden]
        dh = np.zeros((x.shape[1], hidden), np.float32)
        dc = np.zeros_like(dh)
        d_pre = np.zeros((*x.shape[:2], 4 * hidden), np.float32)
        for t, h, c, i, f, o, a, s, m in reversed(keep[side]):
            dh = dh + d_states[t]
            own = m * dh
            do = own * s
            dc2 = m * dc + own * o * (1 - s * s)
            z = np.concatenate([dc2 * a * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - a * a)], axis=1)
            d_pre[t] = z
            g[f"h{side}"] += h.T @ z
            dh = z @ w[f"h{side}"].T + (1 - m) * dh
            dc = dc2 * f + (1 - m) * dc
        g[f"c{side}"] = d_pre.sum((0, 1))
        g[f"x{side}"] = np.einsum("tbi,tbz->iz", x, d_pre)
    loss = (np.logaddexp(0, odds) - y * odds)[mask > 0].mean()
    return float(loss), g


def batched(pages: list[np.ndarray], most: int = 4096) -> list[list[int]]:
    """Pages by number of rows, in groups that take about ``most`` rows with padding."""
    out: list[list[int]] = []
    for i in sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])):
        if not out or (len(out[-1]) + 1) * len(pages[i]) > most:
            out.append([])
        out[-1].append(i)
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for b, p in enumerate(pages):
        x[: len(p), b] = p
        mask[: len(p), b] = 1
    return x, mask


def scores(w: Weights, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The log odds of every row of every page."""
    out = [np.zeros(0, np.float32)] * len(pages)
    for group in batched(pages):
        odds = forward(w, *padded([pages[i] for i in group]))
        for b, i in enumerate(group):
            out[i] = odds[: len(pages[i]), b]
    return out


def train(pages: list[np.ndarray], labels: list[np.ndarray], hidden: int = 16, epochs: int = 6, rate: float = 6e-3, seed: int = 1) -> Weights:
    w = fresh(pages[0].shape[1], hidden, seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    rng = np.random.default_rng(seed)
    groups = batched(pages, 1500)
    for epoch in range(epochs):
        for at in rng.permutation(len(groups)):
            x, mask = padded([pages[i] for i in groups[at]])
            y = padded([labels[i][:, None].astype(np.float32) for i in groups[at]])[0][:, :, 0]
            _, g = gradient(w, x, mask, y)
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k in w:
                d = np.clip(g[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                w[k] = (w[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w
