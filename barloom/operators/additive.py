"""Sums of a linear, a periodic and a smooth part, with weights and the variance of each part fitted in each fold.

Each part is a set of functions whose weights have one normal prior; the priors' variances are those that make the fold's rows
most likely, so a part that a fold doesn't need shrinks to nothing. A fold is a bounded group of rows, and folds are the work of many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.slices import place

#: The parts in the order of their numbers; the constant is apart.
PARTS = ("linear", "periodic", "smooth")


def functions_of(x: np.ndarray, t: np.ndarray, period: float, smooth: int = 20, waves: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The functions of all parts at each row, and the part of each; -1 is the constant.

    Linear in the scaled columns ``x``; ``waves`` harmonics of ``period`` in the row numbers ``t``, weaker as they are faster; ``smooth``
    random waves over ``x`` whose sum is, for many of them, a Matérn function of smoothness 5/2.
    """
    rng = np.random.default_rng(seed)
    faster = np.arange(1, waves + 1)
    angle = 2 * np.pi * t[:, None] * faster / period
    # Student's t with five degrees of freedom is that function's spectrum; wide tables get longer waves.
    pace = rng.normal(size=(x.shape[1], smooth)) / np.sqrt(rng.chisquare(5, smooth) / 5) / np.sqrt(x.shape[1])
    turn = x @ pace + rng.uniform(0, 2 * np.pi, smooth)
    columns = [np.ones((len(x), 1)), x / np.sqrt(x.shape[1]), np.cos(angle) / faster, np.sin(angle) / faster, np.cos(turn) * np.sqrt(2 / smooth)]
    part = np.repeat([-1, 0, 1, 1, 2], [c.shape[1] for c in columns])
    return np.concatenate(columns, axis=1), part


class Fitted:
    """Weights with their covariance, and the variance of each part's prior and of the noise."""

    def __init__(self, f: np.ndarray, part: np.ndarray, y: np.ndarray, classes: bool, rounds: int = 30) -> None:
        """``y`` are values with normal noise, or with ``classes`` 0 and 1 under a logistic curve (Laplace's approximation)."""
        self.part, self.variance, self.noise = part, np.ones(len(PARTS)), max(float(np.var(y)), 1e-9)
        self.weights = np.zeros(f.shape[1])
        for _ in range(rounds):
            # The constant is all but free.
            precision = np.where(part < 0, 1e-4, 1 / self.variance[part])
            if classes:
                for _ in range(3):
                    p = 1 / (1 + np.exp(-np.clip(f @ self.weights, -30, 30)))
                    a = (f.T * np.maximum(p * (1 - p), 1e-6)) @ f + np.diag(precision)
                    self.weights = self.weights + np.linalg.solve(a, f.T @ (y - p) - precision * self.weights)
            else:
                a = f.T @ f / self.noise + np.diag(precision)
                self.weights = np.linalg.solve(a, f.T @ y / self.noise)
            self.covariance = np.linalg.inv(a)
            second = self.weights**2 + np.diag(self.covariance)
            self.variance = np.array([min(max(second[part == k].mean(), 1e-8), 1e4) for k in range(len(PARTS))])
            if not classes:
                self.noise = max(float(np.mean((y - f @ self.weights) ** 2) + np.mean(np.einsum("ij,jk,ik->i", f, self.covariance, f))), 1e-9)

    def shares(self, f: np.ndarray) -> np.ndarray:
        """What each part adds at each row; the constant is not among them."""
        return np.stack([f[:, self.part == k] @ self.weights[self.part == k] for k in range(len(PARTS))], axis=1)

    def chance(self, f: np.ndarray) -> np.ndarray:
        """The probability of class 1, nearer to a half the less sure the weights are."""
        unsure = np.einsum("ij,jk,ik->i", f, self.covariance, f)
        return 1 / (1 + np.exp(-np.clip(f @ self.weights / np.sqrt(1 + np.pi * unsure / 8), -30, 30)))


def one_against_rest(x: np.ndarray, y: np.ndarray, train: int, period: float = 12.0, n_classes: int = 3) -> np.ndarray:
    """For the rows from ``train`` on the class of the largest probability, from a sum fitted to each class on the rows before; ``x`` is scaled."""
    f, part = functions_of(x, np.arange(len(x), dtype=float), period)
    chance = np.stack([Fitted(f[:train], part, (y[:train] == c).astype(float), classes=True).chance(f[train:]) for c in range(n_classes)], axis=1)
    return chance.argmax(axis=1)


def parts(df: DataFrame, column: str = "close", fold: int = 120, period: float = 12.0) -> DataFrame:
    """``column`` taken apart: (symbol, ts, fold, value, level, linear, periodic, smooth, rest), the last five add up to ``value``.

    Each ``fold`` rows of a symbol are fitted by themselves, over their time only; all of a fold's rows enter, so the parts look ahead within it.
    The last fold of a symbol may be shorter; with fewer than eight rows its parts are NULL. Rows with a missing value are left out.
    """
    form = "symbol string, ts timestamp_ntz, fold long, value double, level double, linear double, periodic double, smooth double, rest double"
    rows = df.select("symbol", "ts", F.col(column).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = rows.withColumn("__rn", place(rows)).withColumn("fold", F.floor(F.col("__rn") / fold))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__rn", ignore_index=True)
        out = p[["symbol", "ts", "fold", "value"]].copy()
        if len(p) < 8:
            return out.assign(**{c: None for c in ("level", *PARTS, "rest")})
        t, y = p["__rn"].to_numpy(float), p["value"].to_numpy(float)
        mean, spread = y.mean(), y.std() or 1.0
        f, part = functions_of(((t - t.mean()) / t.std())[:, None] * 2, t, period)
        fitted = Fitted(f, part, (y - mean) / spread, classes=False)
        shares = fitted.shares(f) * spread
        level = np.full(len(y), mean + fitted.weights[0] * spread)
        return out.assign(level=level, **dict(zip(PARTS, shares.T)), rest=y - level - shares.sum(axis=1))

    return rows.groupBy("symbol", "fold").applyInPandas(run, form)
