"""Maximum-likelihood solution of a random-intercept model from folded moments.

Profile-likelihood form of Bates et al. (2015), "Fitting Linear Mixed-Effects
Models Using lme4". With theta the ratio of group to residual deviation, a group of
size n enters through its within-group products and its mean, the latter with
weight n / (1 + n theta^2).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from syllabix.functions.moments import full_matrix

_COARSE = np.concatenate([[0.0], np.geomspace(1e-4, 1e4, 65)])


def _solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; minimum-norm ones if predictors are redundant."""
    if np.linalg.matrix_rank(xx[0], hermitian=True) == xx.shape[1]:
        return np.linalg.solve(xx, xy[:, :, None])[:, :, 0]
    return np.einsum("tij,tj->ti", np.linalg.pinv(xx, rcond=1e-12, hermitian=True), xy)


class FoldedMoments:
    """Centred and scaled moments of (columns..., y), ready for any subset of columns."""

    def __init__(self, pdf: pd.DataFrame, k: int):
        self.size = pdf["n"].to_numpy(float)
        self.groups = pdf["groups"].to_numpy(float)
        centre = np.stack(pdf["centre"].to_numpy()).astype(float)
        between = full_matrix(np.stack(pdf["between"].to_numpy()), k)
        within = full_matrix(np.stack(pdf["within"].to_numpy()).sum(axis=0), k)
        rows = self.size * self.groups
        self.rows = rows.sum()
        self.shift = rows @ centre / self.rows
        offset = centre - self.shift
        spread = between + offset[:, :, None] * offset[:, None, :]
        variance = (np.diag(within) + np.einsum("g,gii->i", rows, spread)) / self.rows
        self.scale = np.where(variance > 0, np.sqrt(np.where(variance > 0, variance, 1)), 1.0)
        # Column 0 is the intercept: no within-group variation, mean 1.
        self.within = np.zeros((k + 1, k + 1))
        self.within[1:, 1:] = within / np.outer(self.scale, self.scale)
        means = np.ones((len(rows), k + 1, k + 1))
        means[:, 0, 1:] = means[:, 1:, 0] = offset / self.scale
        means[:, 1:, 1:] = spread / np.outer(self.scale, self.scale)
        self.means = (means * self.groups[:, None, None]).reshape(len(rows), -1)

    def cross_products(self, theta: np.ndarray) -> np.ndarray:
        weight = self.size / (1 + self.size * theta[:, None] ** 2)
        return self.within + (weight @ self.means).reshape(-1, *self.within.shape)

    def deviance(self, theta: np.ndarray, use: list[int]) -> np.ndarray:
        """-2 log-likelihood at each theta, with the residual variance profiled out."""
        full = self.cross_products(theta)
        x, y = [0, *[c + 1 for c in use]], full.shape[1] - 1
        xx, xy = full[:, x][:, :, x], full[:, x, y]
        beta = _solve(xx, xy)
        rss = full[:, y, y] - np.einsum("ti,ti->t", xy, beta)
        spread = (self.groups * np.log1p(self.size * theta[:, None] ** 2)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            variance = rss * self.scale[-1] ** 2 / self.rows
            return self.rows * (np.log(2 * np.pi * variance) + 1) + spread

    def slope(self, theta: np.ndarray, use: list[int]) -> np.ndarray:
        """Derivative of the deviance by theta squared.

        The coefficients minimise the residual sum of squares at every theta, so only the
        weights of the group means move it: with r = y - X beta it is r' (dM/dtheta^2) r.
        """
        shrink = 1 + self.size * theta[:, None] ** 2
        full = self.cross_products(theta)
        moved = (-((self.size / shrink) ** 2) @ self.means).reshape(-1, *self.within.shape)
        x, y = [0, *[c + 1 for c in use]], full.shape[1] - 1
        beta = _solve(full[:, x][:, :, x], full[:, x, y])
        rss = full[:, y, y] - np.einsum("ti,ti->t", full[:, x, y], beta)
        residual = np.concatenate([-beta, np.ones((len(theta), 1))], axis=1)
        at = [*x, y]
        change = np.einsum("ti,tij,tj->t", residual, moved[:, at][:, :, at], residual)
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.rows * change / rss + (self.groups * self.size / shrink).sum(axis=1)

    def best_theta(self, use: list[int]) -> float:
        """Root of the deviance's derivative beside the best point of a coarse scan; 0 if the deviance rises from there.

        The value of a likelihood is flat at its maximum, its derivative is not: the sign
        change is narrowed 32-fold a round and the last bracket is interpolated.
        """
        at = int(np.nanargmin(self.deviance(_COARSE, use)))
        low, high = _COARSE[max(at - 1, 0)], _COARSE[min(at + 1, len(_COARSE) - 1)]
        for _ in range(5):
            grid = np.linspace(low, high, 33)
            slope = self.slope(grid, use)
            falling = np.flatnonzero(slope < 0)
            if not len(falling):
                return float(low)
            at = int(falling[-1])
            if at == 32:
                return float(high)
            low, high = grid[at], grid[at + 1]
        before, after = slope[at], slope[at + 1]
        return float(low - before * (high - low) / (after - before)) if np.isfinite(after) else float(low)

    def fit(self, use: list[int]) -> dict:
        theta = self.best_theta(use)
        at = np.array([theta])
        deviance = float(self.deviance(at, use)[0])
        full = self.cross_products(at)[0]
        x, y = [0, *[c + 1 for c in use]], full.shape[0] - 1
        inverse = np.linalg.pinv(full[np.ix_(x, x)], rcond=1e-12, hermitian=True)
        beta = inverse @ full[x, y]
        rss = float(full[y, y] - full[x, y] @ beta) * self.scale[-1] ** 2
        sigma2 = rss / self.rows
        # Undo centring and scaling: slopes first, then the intercept.
        back = np.diag([1.0, *[1 / self.scale[c] for c in use]])
        back[0, 1:] = [-self.shift[c] / self.scale[c] for c in use]
        estimate = back @ beta * self.scale[-1]
        estimate[0] += self.shift[-1]
        covariance = back @ inverse @ back.T * sigma2
        rank = int(np.linalg.matrix_rank(full[np.ix_(x, x)], hermitian=True))
        return {
            "theta": theta,
            "sigma": float(np.sqrt(sigma2)),
            "group_sd": float(theta * np.sqrt(sigma2)),
            "rank": rank,
            "n": int(self.rows),
            "log_likelihood": -deviance / 2,
            "aic": deviance + 2 * (rank + 2),
            "estimate": estimate,
            "std_error": np.sqrt(np.maximum(np.diag(covariance), 0)),
        }
