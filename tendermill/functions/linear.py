"""Penalised least squares on a few hundred rows, for functions that run once per group."""

from __future__ import annotations

import numpy as np

# Penalty and its share on absolute weights, as in the comparison of models.
LINEAR_MODELS = {"Linear Regression": (0.0, 0.0), "Ridge Regression": (1.0, 0.0), "Lasso Regression": (0.1, 1.0), "ElasticNet": (0.1, 0.5)}


def penalised(x: np.ndarray, y: np.ndarray, penalty: float, absolute: float, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean((y - xw - b)^2) / 2 + penalty * (absolute * |w| + (1 - absolute) / 2 * w^2).

    Without a penalty the shortest of the best weights; without absolute weights the closed form; else one weight after
    the other from the sums of products.
    """
    middle, level = x.mean(axis=0), float(y.mean())
    z, t = x - middle, y - level
    if penalty == 0:
        weight = np.linalg.lstsq(z, t, rcond=None)[0]
        return weight, level - float(middle @ weight)
    gram, with_y = z.T @ z / len(y), z.T @ t / len(y)
    square = penalty * (1 - absolute)
    if absolute == 0:
        weight = np.linalg.solve(gram + square * np.eye(len(gram)), with_y)
        return weight, level - float(middle @ weight)
    weight = np.zeros(x.shape[1])
    for _ in range(rounds):
        longest = 0.0
        for j in range(len(weight)):
            if gram[j, j] + square <= 0:
                continue
            pull = with_y[j] - gram[j] @ weight + gram[j, j] * weight[j]
            new = np.sign(pull) * max(abs(pull) - penalty * absolute, 0.0) / (gram[j, j] + square)
            longest = max(longest, abs(new - weight[j]))
            weight[j] = new
        if longest < 1e-10:
            break
    return weight, level - float(middle @ weight)


def r_squared(y: np.ndarray, guess: np.ndarray) -> float:
    """1 for a perfect guess; minus infinity where the values do not vary or the guess is not finite."""
    spread = float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
    found = 1 - float(((y - guess) ** 2).sum()) / spread if spread > 0 else -np.inf
    return found if np.isfinite(found) else -np.inf


def best_linear(x: np.ndarray, y: np.ndarray, test: np.ndarray, last: np.ndarray, use_log: bool) -> tuple[str, float, float]:
    """(model, R2 on the test rows, prediction for ``last``); columns are standardised on all rows, as in ``regression.prepared``.

    R2 and prediction are on values where the target is a logarithm. Equal models: the first of the list.
    """
    middle, scale = x.mean(axis=0), x.std(axis=0, ddof=1)
    scale = np.where(scale > 0, scale, np.inf)  # a constant column counts for nothing
    z, last = (x - middle) / scale, (last - middle) / scale

    def back(v):
        return np.expm1(np.minimum(v, 700.0)) if use_log else v

    found = []
    for name, (penalty, absolute) in LINEAR_MODELS.items():
        weight, intercept = penalised(z[~test], y[~test], penalty, absolute)
        found.append((name, r_squared(back(y[test]), back(z[test] @ weight + intercept)), float(back(last @ weight + intercept))))
    return max(found, key=lambda f: f[1])
