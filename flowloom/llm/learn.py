"""Follow-the-regularised-leader on sparse rows with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class FTRL:
    """Per-coordinate proximal FTRL for multinomial logistic regression (two classes: a binary one).

    `l1` sets small coordinates to exactly zero, `l2` shrinks the others. Rows come as (slots, values).
    """

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def push(self, slots: np.ndarray, gradient: np.ndarray) -> None:
        """One step for the given coordinates (distinct slots)."""
        w, n = self.weights(slots), self.n[slots]
        square = gradient * gradient
        sigma = (np.sqrt(n + square) - np.sqrt(n)) / self.alpha
        self.z[slots] += gradient - sigma * w
        self.n[slots] += square

    def fit_row(self, slots: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        slots, values = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        scores = values @ self.weights(slots)
        gradient = softmax(scores[None, :])[0]
        gradient[label] -= 1
        self.push(slots, values[:, None] * gradient[None, :] * weight)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, intercepts)"""
        w = self.weights(slice(None))
        return w[:-1], w[-1]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that gives the held-back labels the highest likelihood (golden-section search).

    Each of the n rows keeps a chance of 1 / (n + 2) for another label, as after one wrong row more: without it, rows that
    are all right have no likeliest divisor. It is 1 where the search ends at an end of its range nevertheless.
    """
    classes = scores.shape[1]
    if not len(labels) or classes < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)
    target = np.full(scores.shape, doubt / (classes - 1))
    target[np.arange(len(labels)), labels] = 1 - doubt

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -(target * np.log(np.maximum(p, 1e-300))).sum(axis=1).mean()

    ends = low, high = -6.0, 6.0
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    best = (low + high) / 2
    return float(np.exp(best)) if min(abs(best - end) for end in ends) > 0.01 else 1.0
