"""A linear hinge-loss model by dual coordinate descent, and scores made probabilities by a logistic curve."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]],
    signs: np.ndarray,
    weights: np.ndarray,
    width: int,
    cost: float = 1.0,
    passes: int = 12,
    tolerance: float = 1e-3,
    seed: int = 0,
) -> np.ndarray:
    """The weights w, the bias last, of least |w|^2 / 2 + cost * sum of weighted hinge losses.

    A row is (columns, values). Each step solves one row's dual variable exactly, in an order drawn anew in every pass.
    """
    w = np.zeros(width + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([1.0 + float(values @ values) for _, values in rows])
    caps = cost * weights
    generator = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in generator.permutation(len(rows)):
            columns, values = rows[i]
            gradient = signs[i] * (float(w[columns] @ values) + w[-1]) - 1.0
            after = min(max(alpha[i] - gradient / norms[i], 0.0), caps[i])
            if (step := after - alpha[i]) != 0.0:
                w[columns] += signs[i] * step * values
                w[-1] += signs[i] * step
                alpha[i] = after
                most = max(most, abs(step) / caps[i])
        if most < tolerance:
            break
    return w


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, offset) of the curve 1 / (1 + exp(-(slope * margin + offset))) that fits labels 0 and 1 best.

    Labels are drawn in towards one half by one pseudo-count each, so that separable data still have a finite fit.
    """
    ones, zeros = float((labels == 1).sum()), float((labels == 0).sum())
    if not len(margins):
        return 0.0, 0.0
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = float(np.abs(margins).max()) or 1.0
    x = np.stack([margins / scale, np.ones_like(margins)])
    beta = np.array([0.0, np.log((ones + 1) / (zeros + 1))])

    def loss(b: np.ndarray) -> float:
        z = b @ x
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -500, 500)))
        gradient = x @ (p - target)
        curvature = (x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def probability(margin: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * margin + curve[1], -500, 500)))
