"""Gradient boosting of a Gaussian's mean and spread with symmetric trees, in numpy, for one series at a time."""

from __future__ import annotations

import numpy as np

from ..config import BoostConfig

BINS, RIDGE = 16, 3.0


class GaussianTrees:
    """Each round grows one tree whose levels share a split, for the natural gradients of mean and log spread."""

    def __init__(self, config: BoostConfig | None = None):
        self.config = config or BoostConfig()

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def _grow(self, xb: np.ndarray, grads: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        n, f = xb.shape
        leaf, splits = np.zeros(n, np.int64), []
        cell = xb + np.arange(f) * BINS
        for level in range(self.config.depth if f else 0):
            size = (1 << level) * f * BINS
            at = (leaf[:, None] * (f * BINS) + cell).ravel()
            count = np.bincount(at, minlength=size).reshape(-1, f, BINS).cumsum(axis=2)
            gain = 0.0
            for g in grads:
                s = np.bincount(at, np.repeat(g, f), minlength=size).reshape(-1, f, BINS).cumsum(axis=2)
                rest = s[:, :, -1:] - s
                gain = gain + (s**2 / (count + RIDGE) + rest**2 / (count[:, :, -1:] - count + RIDGE)).sum(axis=0)
            j, b = divmod(int(np.argmax(gain)), BINS)
            splits.append((j, b))
            leaf = leaf * 2 + (xb[:, j] > b)
        return splits, leaf

    def _loss(self, y, mu, log_s) -> float:
        return float(np.mean(log_s + 0.5 * ((y - mu) * np.exp(-log_s)) ** 2))

    def _boost(self, xb, y, rounds, xv=None, yv=None) -> int:
        """Grow up to ``rounds`` trees; with held-out rows, the number after which their loss was least."""
        c = self.config
        self.start, self.trees = (float(y.mean()), float(np.log(max(y.std(), 1e-6)))), []
        mu, log_s = np.full(len(y), self.start[0]), np.full(len(y), self.start[1])
        vm, vs = (np.full(len(yv), v) for v in self.start) if yv is not None else (None, None)
        best, least = 0, self._loss(yv, vm, vs) if yv is not None else 0.0
        for i in range(rounds):
            e = y - mu
            grads = np.stack([e / max(self.scale, 1e-9), 0.5 * np.clip((e * np.exp(-log_s)) ** 2 - 1, -1, 9)])
            splits, leaf = self._grow(xb, grads)
            n = np.bincount(leaf, minlength=1 << len(splits)) + RIDGE
            step = [c.learning_rate * np.bincount(leaf, g, minlength=1 << len(splits)) / n for g in (e, grads[1])]
            self.trees.append((splits, step))
            mu, log_s = mu + step[0][leaf], np.clip(log_s + step[1][leaf], self.floor, None)
            if yv is not None:
                at = self._leaf(splits, xv)
                vm, vs = vm + step[0][at], np.clip(vs + step[1][at], self.floor, None)
                loss = self._loss(yv, vm, vs)
                if loss < least - 1e-9:
                    best, least = i + 1, loss
                elif i + 1 - best >= c.early_stopping_rounds:
                    break
        return best

    @staticmethod
    def _leaf(splits, xb) -> np.ndarray:
        leaf = np.zeros(len(xb), np.int64)
        for j, b in splits:
            leaf = leaf * 2 + (xb[:, j] > b)
        return leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianTrees:
        """Rows in order of time. The last fifth finds the number of rounds (at most ``iterations``); all rows are then fitted."""
        x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.scale = float(y.std())
        self.floor = float(np.log(max(1e-3 * self.scale, 1e-9)))
        xb, cut = self._bin(x), len(y) - len(y) // 5
        rounds = self._boost(xb[:cut], y[:cut], self.config.iterations, xb[cut:], y[cut:]) if len(y) >= 10 else 0
        self._boost(xb, y, rounds)
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of each row."""
        xb = self._bin(np.nan_to_num(np.asarray(x, float)))
        mu, log_s = np.full(len(xb), self.start[0]), np.full(len(xb), self.start[1])
        for splits, step in self.trees:
            at = self._leaf(splits, xb)
            mu, log_s = mu + step[0][at], np.clip(log_s + step[1][at], self.floor, None)
        return mu, np.exp(log_s)
