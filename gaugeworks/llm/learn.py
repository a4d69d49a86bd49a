"""Small models fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps: coefficients, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * b
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        b -= step * min(1, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return b


def probability(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ b, -30, 30)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties by half; 0.5 if there is one class only."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return 0.5
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
