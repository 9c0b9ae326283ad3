"""Per-series fitting helpers: a few lines of numpy each, run inside one group's task."""

from __future__ import annotations

import numpy as np
import pandas as pd

# Season length and ridge penalties.
SEASON = 7
PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)


class TooShort(ValueError):
    """A series has too few days for a model."""


def ridge_fit(x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = PENALTIES):
    """Ridge on centred data; the penalty with the least leave-one-out error.

    Uses the closed form: residual / (1 - leverage), the intercept unpenalized.
    Returns (coefficients, intercept, penalty).
    """
    x_mean, y_mean = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - x_mean, full_matrices=False)
    uy = u.T @ (y - y_mean)
    best = None
    for a in penalties:
        shrink = s**2 / (s**2 + a)
        leverage = 1.0 / len(y) + (u**2) @ shrink
        residual = y - y_mean - u @ (shrink * uy)
        error = float(np.mean((residual / (1.0 - leverage)) ** 2))
        if best is None or error < best[0]:
            best = (error, a)
    a = best[1]
    coef = vt.T @ (s / (s**2 + a) * uy)
    return coef, float(y_mean - x_mean @ coef), a


def left_out_error(x: np.ndarray, y: np.ndarray, penalty: float) -> float:
    """Mean squared leave-one-out error by the hat matrix of the normal equations."""
    z = x - x.mean(axis=0)
    hat = z @ np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T) + 1.0 / len(y)
    return float(np.mean(((y - hat @ y) / (1.0 - np.diag(hat))) ** 2))


def standard_ridge(x: np.ndarray, y: np.ndarray):
    """Ridge on columns standardized over the training rows (constant ones untouched):
    (coefficients, intercept, penalty, means, deviations)."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    return (*ridge_fit((x - mean) / std, y), mean, std)


def ridge_predict(x: np.ndarray, y: np.ndarray, future: np.ndarray) -> np.ndarray:
    coef, intercept, _, mean, std = standard_ridge(x, y)
    return (future - mean) / std @ coef + intercept


# Smoothing weights tried for level, trend and season.
LEVEL_GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)
TREND_GRID = (0.0, 0.005, 0.02, 0.05, 0.1)
SEASON_GRID = (0.02, 0.05, 0.1, 0.2, 0.4)


def holt_winters_predict(y: np.ndarray, steps: int, season: int = SEASON) -> np.ndarray:
    """Additive trend and season; weights from a grid by one-step squared error.

    All grid points run side by side as one vector per day.
    """
    if len(y) < 2 * season:
        raise TooShort("needs two full seasons")
    grid = np.array([(a, b, g) for a in LEVEL_GRID for b in TREND_GRID for g in SEASON_GRID])
    alpha, beta, gamma = grid.T
    first, second = y[:season].mean(), y[season : 2 * season].mean()
    level = np.full(len(grid), first)
    trend = np.full(len(grid), (second - first) / season)
    cycle = np.repeat((y[:season] - first)[:, None], len(grid), axis=1)
    error = np.zeros(len(grid))
    for t, value in enumerate(y):
        k = t % season
        guess = level + trend
        error += (value - guess - cycle[k]) ** 2
        new_level = alpha * (value - cycle[k]) + (1 - alpha) * guess
        trend = beta * (new_level - level) + (1 - beta) * trend
        cycle[k] = gamma * (value - guess) + (1 - gamma) * cycle[k]
        level = new_level
    best = int(np.argmin(error))
    ahead = np.arange(1, steps + 1)
    seasonal = cycle[(len(y) + ahead - 1) % season, best]
    return level[best] + ahead * trend[best] + seasonal


def naive_predict(y: np.ndarray, steps: int, season: int = SEASON) -> np.ndarray:
    return np.resize(y[-season:], steps)


def predict(
    model: str, rows: pd.DataFrame, features: tuple[str, ...]
) -> tuple[np.ndarray, str]:
    """The requested model, then Holt-Winters, then the seasonal naive one."""
    known = rows["trips"].notna().to_numpy()
    y = rows.loc[known, "trips"].to_numpy(dtype=float)
    steps = int((~known).sum())

    def ridge() -> np.ndarray:
        x = rows[list(features)].to_numpy(dtype=float)
        return ridge_predict(x[known], y, x[~known])

    fits = {
        "Regression + seasonality": ridge,
        "Holt-Winters": lambda: holt_winters_predict(y, steps),
        "Seasonal naive": lambda: naive_predict(y, steps),
    }
    for name in dict.fromkeys([model if model in fits else "Holt-Winters", "Holt-Winters", "Seasonal naive"]):
        try:
            values = fits[name]()
        except (TooShort, np.linalg.LinAlgError):
            continue
        if np.isfinite(values).all():
            return values, name
    raise ValueError("no model could be fitted")
