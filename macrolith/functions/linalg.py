"""Small dense algebra on the driver or in a kernel."""

from __future__ import annotations

import numpy as np


def guarded_inverse(a: np.ndarray) -> np.ndarray:
    """Inverse, or pseudo-inverse where the matrix is singular to working precision."""
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    scaled = a / np.outer(d, d)
    if np.linalg.cond(scaled) > 1e13:
        return np.linalg.pinv(scaled, rcond=1e-12) / np.outer(d, d)
    return np.linalg.inv(scaled) / np.outer(d, d)


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and (X'X)^-1."""
    inv = guarded_inverse(x.T @ x)
    b = inv @ (x.T @ y)
    return b, y - x @ b, inv


def lags(y: np.ndarray, p: int, constant: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Left side and lag design of a vector autoregression, lag by lag."""
    y = y.reshape(len(y), -1)
    x = np.hstack([y[p - j : len(y) - j] for j in range(1, p + 1)]) if p else np.zeros((len(y), 0))
    if constant:
        x = np.hstack([np.ones((len(y) - p, 1)), x])
    return y[p:], x


def companion(b: np.ndarray, n: int, p: int) -> np.ndarray:
    """From coefficients with a constant first (1 + np rows, n columns)."""
    out = np.zeros((n * p, n * p))
    out[:n] = b[1 : 1 + n * p].T
    out[n:, :-n] = np.eye(n * (p - 1))
    return out
