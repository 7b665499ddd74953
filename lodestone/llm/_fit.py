"""A ridge logistic regression small enough to fit on the driver: Newton steps over a bounded sample."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardised features, weights and intercept."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-z.clip(-40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """Weights by Newton's method; the intercept isn't penalised. A sample of one class gives that class's rate."""
    n, k = x.shape
    w = np.ones(n) if row_weight is None else row_weight
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    scale[scale < 1e-9] = 1.0
    z = np.hstack([((x - mean) / scale).clip(-8, 8), np.ones((n, 1))])
    beta = np.zeros(k + 1)
    rate = min(max(np.average(y, weights=w), 1e-4), 1 - 1e-4)
    beta[-1] = np.log(rate / (1 - rate))
    penalty = np.full(k + 1, ridge)
    penalty[-1] = 1e-3

    def loss(b: np.ndarray) -> float:
        s = z @ b
        return float((w * (np.logaddexp(0, s) - y * s)).sum() + 0.5 * (penalty * b * b).sum())

    now = loss(beta)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-(z @ beta).clip(-40, 40)))
        grad = z.T @ (w * (p - y)) + penalty * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-4 and (got := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        beta, gain, now = beta - size * step, now - got, got
        if gain < 1e-7 * max(1.0, abs(now)):
            break
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))
