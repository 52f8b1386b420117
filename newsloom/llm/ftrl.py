"""Follow-the-regularised-leader with an elastic-net penalty for sparse linear models."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal; weights stay exactly zero until a coordinate's gradients outweigh the L1 penalty (0 for the coordinates `free`)."""

    def __init__(self, features: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 1e-4, free: np.ndarray | None = None):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, np.full((features, 1), l1), l2
        if free is not None:
            self.l1[free] = 0.0
        self.z, self.n = np.zeros((features, outputs)), np.zeros((features, outputs))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """One step at distinct coordinates, with their gradients and present weights."""
        n = self.n[at]
        more = n + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_multinomial(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, classes: int, rounds: int = 8, seed: int = 7, **penalties: float) -> np.ndarray:
    """Softmax regression over (coordinates, values); returns the weights, features by classes."""
    model, order = Ftrl(features, classes, **penalties), np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(examples)):
            at, values = examples[k]
            w = model.weights(at)
            p = softmax(values @ w)
            p[labels[k]] -= 1
            model.update(at, np.outer(values, p), w)
    return model.weights()


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss of softmax(scores / t), by golden-section search over its logarithm.

    Labels count as true with the probability (n + 1) / (n + 2), so that perfect scores don't make it vanish.
    """
    if not len(labels) or scores.shape[1] < 2:
        return 1.0
    off = 1 / (len(labels) + 2)
    goal = np.full(scores.shape, off / (scores.shape[1] - 1))
    goal[np.arange(len(labels)), labels] = 1 - off
    loss = lambda t: -(goal * np.log(np.maximum(softmax(scores / np.exp(t)), 1e-12))).sum(axis=1).mean()
    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))
