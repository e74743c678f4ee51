"""Multi-label logistic regression on sparse hashed features, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash


def bucket(feature: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(feature) & ((1 << bits) - 1)


class Rows:
    """Sparse rows: indices and values of all rows, and where each begins."""

    def __init__(self, rows: list[tuple[list[int], list[float]]]):
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        none = np.zeros(0)
        self.index = np.concatenate([none, *(r[0] for r in rows)]).astype(np.int32)
        self.value = np.concatenate([none, *(r[1] for r in rows)]).astype(np.float32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)

    def __len__(self) -> int:
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        """(rows, labels)"""
        out = np.zeros((len(self), w.shape[1]), np.float32)
        np.add.at(out, self.row, w[self.index] * self.value[:, None]) if len(self) < 64 else None
        if len(self) >= 64:
            for j in range(w.shape[1]):
                out[:, j] = np.bincount(self.row, w[self.index, j] * self.value, len(self))
        return out

    def take(self, i: np.ndarray) -> Rows:
        new = Rows([])
        sizes = (self.start[1:] - self.start[:-1])[i]
        new.start = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.start[:-1][i] - new.start[:-1], sizes) + np.arange(int(sizes.sum()))
        new.index, new.value, new.row = self.index[at], self.value[at], np.repeat(np.arange(len(i)), sizes)
        return new


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: Rows, y: np.ndarray, size: int, weight: np.ndarray | None = None, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6, batch: int = 256, seed: int = 1) -> np.ndarray:
    """Weights (size, labels) by Adagrad; the last feature is the bias and should be 1 in every row."""
    rng = np.random.default_rng(seed)
    w = np.zeros((size, y.shape[1]), np.float32)
    g2 = np.full((size, y.shape[1]), 1e-2, np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            p = x.take(part)
            err = sigmoid(p.dot(w)) - y[part]
            if weight is not None:
                err = err * weight[part][:, None]
            seen, back = np.unique(p.index, return_inverse=True)
            grad = np.stack([np.bincount(back, err[p.row, j] * p.value, len(seen)) for j in range(y.shape[1])], 1) / len(part)
            grad += l2 * w[seen]
            g2[seen] += grad**2
            w[seen] -= rate * grad / np.sqrt(g2[seen])
    return w


def threshold(score: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """Least threshold that has this precision on held-out rows and the best F1 among those; 0.5 without cases."""
    if not truth.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(truth[order])
    n = np.arange(1, len(order) + 1)
    p, r = hit / n, hit / truth.sum()
    f1 = np.where(p >= precision, 2 * p * r / np.maximum(p + r, 1e-9), -1)
    if f1.max() < 0:
        f1 = 2 * p * r / np.maximum(p + r, 1e-9)
    k = int(np.argmax(f1))
    above = score[order[k]]
    below = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((above + below) / 2, 0.05, 0.95))
