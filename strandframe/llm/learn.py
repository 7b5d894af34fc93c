"""Small numeric models, fitted on the driver from bounded samples; scoring is by executors."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Linear:
    """Logistic regression on standardised features, with soft labels, row weights and an L2 penalty."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> Linear:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weight = np.ones(len(y)) if weight is None else weight
        w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(steps):  # Newton steps
            p = sigmoid(z @ w)
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
            step = np.linalg.solve(curve, z.T @ (weight * (y - p)) - ridge @ w)
            w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate a logit."""
    m = Linear().fit(logit[:, None], y, penalty=1e-3)
    slope = m.w[0] / m.scale[0]
    return float(slope), float(m.w[1] - slope * m.mean[0])


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1, accuracies and correlations, from votes (-1, 0, 1) by expectation maximisation.

    The model of the votes of a document is normal around a mean vector per label (a voter's accuracy: how far its
    means are apart) with one covariance of all voters, so that voters that repeat one another, right or wrong, do not
    count twice. start: first posteriors.
    """
    p = np.clip(start, 0.02, 0.98)
    n, m = votes.shape
    for _ in range(steps):
        a, b = p.sum() + 1e-9, (1 - p).sum() + 1e-9
        one, zero = (p @ votes) / a, ((1 - p) @ votes) / b
        u, v = votes - one, votes - zero
        cov = ((u * p[:, None]).T @ u + (v * (1 - p)[:, None]).T @ v) / n
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.01 * np.eye(m)  # shrunk to the diagonal
        w = np.linalg.solve(cov, one - zero)
        new = sigmoid(votes @ w - w @ (one + zero) / 2 + np.log(prior / (1 - prior)))
        if np.abs(new - p).max() < 1e-4:
            p = new
            break
        p = new
    d = np.sqrt(np.diag(cov))
    return p, one - zero, cov / np.outer(d, d)
