"""Small learners for one bounded table each: boosted trees over histograms, and a perceptron with early stopping.

``evaluation_grid`` gives each of them the rows of one cell as a group.  Rows come in the order of a hash, so that every
tenth is a fair hold-out.
"""

from __future__ import annotations

import heapq

import numpy as np

#: The defaults of the learners whose role these take.
BINS, LEAVES, LEAST_LEAF, LEAST_HESSIAN, ROUNDS, RATE = 255, 31, 20, 1e-3, 200, 0.05
HOLD_OUT_FROM, PATIENCE, TOLERANCE = 10_000, 10, 1e-7
HIDDEN, EPOCHS, BATCH, STEP, SHRINK, LEAST_GAIN = 128, 120, 200, 1e-3, 1e-4, 1e-4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - y * margin


def cut_points(x: np.ndarray) -> list[np.ndarray]:
    """Up to 254 bounds of each column: between its values, or at quantiles if there are more."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1]))
            out.append(values)
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of bounds below each value: values up to a bound fall left of it."""
    return np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of gradients, Hessians and rows by (column, bin)."""
    width = codes.shape[1]
    at = (codes.astype(np.int64) + np.arange(width) * (BINS + 1)).ravel()
    size = width * (BINS + 1)
    parts = [np.bincount(at, np.repeat(w, width), size) for w in (g, h)] + [np.bincount(at, minlength=size)]
    return np.stack(parts).reshape(3, width, BINS + 1)


def best_split(sums: np.ndarray) -> tuple[float, int, int]:
    """Gain, column and last bin on the left of the best split; the first of equal ones."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums[:, 0].sum(1)
    right = total[:, None, None] - left
    fits = (left[2] >= LEAST_LEAF) & (right[2] >= LEAST_LEAF) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], -np.inf)
    at = int(gain.argmax())
    return float(gain.ravel()[at]), at // gain.shape[1], at % gain.shape[1]


def grown(codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """One tree, the leaf of the largest gain split first: nodes (column, bin, left, right, value), rows of each leaf, its node.

    A larger child's histogram is its parent's less that of the smaller.
    """
    nodes: list[list[float]] = [[-1, 0, 0, 0, 0.0]]
    every = np.arange(len(g))
    held = {0: (every, histogram(codes, g, h))}
    queue = [(-best_split(held[0][1])[0], 0)]
    while queue and len(held) < LEAVES:
        gain, node = heapq.heappop(queue)
        if not -gain > 0:
            break
        rows, sums = held.pop(node)
        _, column, last = best_split(sums)
        goes = codes[rows, column] <= last
        sides = [rows[goes], rows[~goes]]
        small = int(len(sides[1]) < len(sides[0]))
        part = histogram(codes[sides[small]], g[sides[small]], h[sides[small]])
        both = [part, sums - part] if small == 0 else [sums - part, part]
        nodes[node][:4] = column, last, len(nodes), len(nodes) + 1
        for own, own_sums in zip(sides, both, strict=True):
            held[len(nodes)] = (own, own_sums)
            heapq.heappush(queue, (-best_split(own_sums)[0], len(nodes)))
            nodes.append([-1, 0, 0, 0, 0.0])
    for node, (rows, _) in held.items():
        nodes[node][4] = -RATE * g[rows].sum() / max(h[rows].sum(), 1e-12)
    return np.array(nodes), [rows for rows, _ in held.values()], list(held)


def leaf_values(tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at, every = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while (inner := tree[at, 0] >= 0).any():
        rows = every[inner]
        node = tree[at[rows]]
        left = codes[rows, node[:, 0].astype(np.int64)] <= node[:, 1]
        at[rows] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
    return tree[at, 4]


class BoostedTrees:
    """Gradient boosting on the log loss with trees over binned columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS):
        self.cuts = cut_points(x)
        codes = binned(x, self.cuts)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.trees: list[np.ndarray] = []
        hold = np.arange(len(y)) % 10 == 9 if len(y) > HOLD_OUT_FROM else np.zeros(len(y), bool)
        margin, best, since = np.full(len(y), self.base), np.inf, 0
        train = np.flatnonzero(~hold)
        for _ in range(rounds):
            p = sigmoid(margin[train])
            tree, leaves, numbers = grown(codes[train], p - y[train], p * (1 - p))
            self.trees.append(tree)
            for rows, node in zip(leaves, numbers, strict=True):
                margin[train[rows]] += tree[node, 4]
            if hold.any():
                margin[hold] += leaf_values(tree, codes[hold])
                loss = log_loss(margin[hold], y[hold]).mean()
                since = 0 if loss < best - TOLERANCE else since + 1
                best = min(best, loss)
                if since >= PATIENCE:
                    break

    def prob(self, x: np.ndarray) -> np.ndarray:
        codes = binned(x, self.cuts)
        return sigmoid(self.base + sum(leaf_values(t, codes) for t in self.trees))


class Perceptron:
    """One hidden layer of rectified units, trained by Adam; stops when a tenth of the rows held out is told no better."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 42):
        rng, width = np.random.default_rng(seed), x.shape[1]
        a, b = np.sqrt(6 / (width + hidden)), np.sqrt(6 / (hidden + 1))
        self.parts = [rng.uniform(-a, a, (width, hidden)), rng.uniform(-a, a, hidden), rng.uniform(-b, b, hidden), rng.uniform(-b, b, 1)]
        hold = np.arange(len(y)) % 10 == 9
        xt, yt, xv, yv = x[~hold], y[~hold], x[hold], y[hold]
        m, v, step = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        best, since, kept = -np.inf, 0, [p.copy() for p in self.parts]
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for i in range(0, len(order), BATCH):
                rows, step = order[i : i + BATCH], step + 1
                for k, d in enumerate(self._gradient(xt[rows], yt[rows])):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.parts[k] = self.parts[k] - STEP * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m[k] / (np.sqrt(v[k]) + 1e-8)
            right = ((self.margin(xv) > 0) == (yv > 0.5)).mean() if len(yv) else 0.0
            since = 0 if right > best + LEAST_GAIN else since + 1
            if right > best:
                best, kept = right, [p.copy() for p in self.parts]
            if since >= PATIENCE:
                break
        self.parts = kept

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, out, last = self.parts
        return np.maximum(x @ w + b, 0) @ out + last

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, out, last = self.parts
        inner = np.maximum(x @ w + b, 0)
        g = (sigmoid(inner @ out + last) - y) / len(y)
        back = np.outer(g, out) * (inner > 0)
        return [x.T @ back + SHRINK * w / len(y), back.sum(0), inner.T @ g + SHRINK * out / len(y), g.sum(keepdims=True)]

    def prob(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))
