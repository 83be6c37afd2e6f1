"""Least squares from moments: sums of products are taken in the cluster, and only as many numbers as columns squared leave it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.vocabulary import row_index


@dataclass
class Moments:
    """``n`` rows, the sums of their columns, and the sums of products of each two."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def with_one(self) -> np.ndarray:
        """Sums of products with a column of ones in front."""
        return np.block([[np.array([[float(self.n)]]), self.sums[None]], [self.sums[:, None], self.products]])

    def squares(self, offset: float, weights: np.ndarray) -> float:
        """The sum over rows of ``(offset + weights . row) ** 2``."""
        v = np.concatenate([[offset], weights])
        return float(v @ self.with_one() @ v)


def moments(df: DataFrame, cols: list[str], by: str | None = None) -> dict:
    """Moments of ``cols`` by ``by`` (a column of few values), or of all rows under None; rows with a null are left out."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = [F.sum(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    products = [F.sum(F.col(f"`{cols[i]}`").cast("double") * F.col(f"`{cols[j]}`")).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in df.dropna(subset=cols).groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        out[r[by] if by else None] = Moments(r["n"], np.array([r[f"s{i}"] or 0.0 for i in range(len(cols))]), p)
    return out


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with columns less their mean over their population deviation; one without deviation becomes zero."""
    stats = df.agg(*(f(c).alias(f"{name}{i}") for i, c in enumerate(cols) for f, name in ((F.avg, "m"), (F.stddev_pop, "d")))).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"d{i}"] or 1.0) for i, c in enumerate(cols)})


def blocks(df: DataFrame, at: str, n: int, folds: int, name: str = "block") -> DataFrame:
    """``df`` with its block of time: ``folds`` of them in order, the first ones longer by a row where n does not divide."""
    size, longer = divmod(n, folds)
    i, edge = F.col("row_idx"), longer * (size + 1)
    block = F.when(i < edge, F.floor(i / (size + 1))).otherwise(longer + F.floor((i - edge) / max(size, 1)))
    return row_index(df, [at]).withColumn(name, block.cast("int")).drop("row_idx")


def lagged(df: DataFrame, cols: list[str], at: str, lags: int) -> DataFrame:
    """``(row_idx, cols, c_1, ..)``: each row with the values of its predecessors, null before the first; joins, no window."""
    rows = row_index(df.select(at, *cols).dropna(), [at]).select("row_idx", *cols)
    out = rows
    for k in range(1, lags + 1):
        before = rows.select((F.col("row_idx") + k).alias("row_idx"), *(F.col(c).alias(f"{c}_{k}") for c in cols))
        out = out.join(before, "row_idx", "left")
    return out


def lasso(m: Moments, alpha: float, mix: float = 1.0, rounds: int = 1000, tol: float = 1e-10) -> tuple[float, np.ndarray]:
    """Intercept and weights of the last column by the others: coordinate descent on RSS / 2n + alpha * penalty.

    The penalty is ``mix * |w|_1 + (1 - mix) / 2 * |w|_2^2``.
    """
    mean = m.sums / m.n
    cov = m.products / m.n - np.outer(mean, mean)
    g, c = cov[:-1, :-1], cov[:-1, -1]
    w = np.zeros(len(c))
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(np.diag(g) > 1e-14):
            rho = c[j] - g[j] @ w + g[j, j] * w[j]
            new = math.copysign(max(abs(rho) - alpha * mix, 0.0), rho) / (g[j, j] + alpha * (1 - mix))
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    return float(mean[-1] - mean[:-1] @ w), w


def scaled(m: Moments, mean: np.ndarray, deviation: np.ndarray) -> Moments:
    """The moments of ``(row - mean) / deviation``."""
    d = 1 / deviation
    centred = m.products - np.outer(m.sums, mean) - np.outer(mean, m.sums) + m.n * np.outer(mean, mean)
    return Moments(m.n, (m.sums - m.n * mean) * d, centred * np.outer(d, d))


def scales(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the columns, those of the last (the target) being zero and one."""
    mean = m.sums / m.n
    deviation = np.sqrt(np.maximum(np.diag(m.products) / m.n - mean**2, 0))
    deviation = np.where(deviation > 1e-12, deviation, 1.0)
    mean[-1], deviation[-1] = 0.0, 1.0
    return mean, deviation


def solved(m: Moments, targets: list[int], given: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of columns by others and a constant: coefficients (constant first; a column a target) and residual products."""
    full = m.with_one()
    x, y = [0, *(g + 1 for g in given)], [t + 1 for t in targets]
    beta, *_ = np.linalg.lstsq(full[np.ix_(x, x)], full[np.ix_(x, y)], rcond=None)
    return beta, full[np.ix_(y, y)] - full[np.ix_(y, x)] @ beta
