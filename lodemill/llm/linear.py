"""Logistic models on the driver, over samples of a documented size."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, by Newton steps; the bias is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_sparse(rows: np.ndarray, columns: np.ndarray, n: int, width: int, y: np.ndarray, l2: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights, the bias last, for rows of ones at (rows[k], columns[k]), by Nesterov's gradient steps with adapted scale."""
    rows, columns = np.concatenate([rows, np.arange(n)]), np.concatenate([columns, np.full(n, width)])
    often = np.bincount(columns, minlength=width + 1)
    per_row = np.bincount(rows, minlength=n)
    # a bound of the curvature for each weight: a quarter of the sum of its rows' lengths
    scale = 1 / (0.25 * np.bincount(columns, per_row[rows], minlength=width + 1) + l2)
    shrink = np.where(often > 0, l2, 1.0)
    shrink[-1] = 1e-6
    w = ahead = np.zeros(width + 1)
    t = 1.0
    for _ in range(rounds):
        error = y - sigmoid(np.bincount(rows, ahead[columns], minlength=n))
        new = ahead + scale * (np.bincount(columns, error[rows], minlength=width + 1) - shrink * ahead)
        if np.abs(new - w).max() < 1e-5:
            return new
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w
