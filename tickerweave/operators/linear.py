"""Logistic regression, many fits in one pass: every Newton step adds up gradient and curvature of all fits in one job.

A fit is a set of training rows and a strength C. Features are standardised by the mean and deviation (of the population)
of the set's rows, classes are weighted to the same total, and the intercept is not penalised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD

from tickerweave.operators.blocks import add_up

STEPS = 50
TOLERANCE = 1e-9


@dataclass
class Linear:
    """One fitted model; coefficients belong to standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x - self.mean) / self.scale @ self.coefficients + self.intercept)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z) - y * z


def fit_many(blocks: RDD, fits: list[tuple[int, float]], n_sets: int) -> list[Linear]:
    """A model per (set, C). A step that raises a fit's loss is halved; a fit that has settled leaves the sums.

    Sets without rows of both classes predict their share of ones.
    """

    def moments(b):
        w = b["sets"].astype(np.float64)
        return [w.sum(0), w.T @ b["y"], w.T @ b["x"], w.T @ (b["x"] * b["x"])]

    n, ones, s1, s2 = add_up(blocks, moments) or [np.zeros(n_sets), np.zeros(n_sets), np.zeros((n_sets, 1)), np.zeros((n_sets, 1))]
    rows = np.maximum(n, 1)[:, None]
    mean = s1 / rows

    def spread(b):
        return [np.stack([((b["x"][b["sets"][:, s]] - mean[s]) ** 2).sum(0) for s in range(n_sets)])]

    scale = np.sqrt(add_up(blocks, spread)[0] / rows) if n.any() else np.ones_like(mean)
    scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    both = (ones > 0) & (ones < n)
    weight = np.stack([n / np.maximum(2 * (n - ones), 1), n / np.maximum(2 * ones, 1)], axis=1)
    d = mean.shape[1] + 1
    theta, step, best = np.zeros((len(fits), d)), np.zeros((len(fits), d)), np.full(len(fits), np.inf)
    going = [k for k, (s, _) in enumerate(fits) if both[s]]
    penalised = np.append(np.ones(d - 1), 0.0)
    for _ in range(STEPS):
        if not going:
            break

        def sums(b, going=tuple(going), theta=theta):
            out, of = np.zeros((len(going), 1 + d + d * d)), {}
            for j, k in enumerate(going):
                s, c = fits[k]
                if s not in of:
                    m = b["sets"][:, s]
                    z = (b["x"][m] - mean[s]) / scale[s]
                    of[s] = np.hstack([z, np.ones((len(z), 1))]), b["y"][m]
                x, y = of[s]
                w = c * weight[s][y.astype(int)]
                v = x @ theta[k]
                p = _sigmoid(v)
                out[j, 0] = w @ _loss(v, y)
                out[j, 1 : 1 + d] = (w * (p - y)) @ x
                out[j, 1 + d :] = (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
            return [out]

        total = add_up(blocks, sums)[0]
        left = []
        for j, k in enumerate(going):
            loss = total[j, 0] + 0.5 * (penalised * theta[k] ** 2).sum()
            if loss > best[k] + 1e-9 * abs(best[k]):  # too far: back half the way
                step[k] /= 2
                theta[k] -= step[k]
                left.append(k)
                continue
            best[k] = loss
            g = total[j, 1 : 1 + d] + penalised * theta[k]
            h = total[j, 1 + d :].reshape(d, d) + np.diag(penalised)
            step[k] = -np.linalg.lstsq(h, g, rcond=None)[0]
            theta[k] += step[k]
            if np.abs(step[k]).max() > TOLERANCE * max(1.0, np.abs(theta[k]).max()):
                left.append(k)
        going = left
    out = []
    for k, (s, _) in enumerate(fits):
        t = theta[k]
        if not both[s]:
            share = np.clip(ones[s] / max(n[s], 1), 1e-6, 1 - 1e-6)
            t = np.append(np.zeros(d - 1), np.log(share / (1 - share)))
        out.append(Linear(mean[s], scale[s], t[:-1].copy(), float(t[-1])))
    return out
