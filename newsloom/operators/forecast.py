"""LASSO selection and backtest, vector autoregression, tests of forecasts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import moments as Q
from newsloom.operators.lineage import cut_lineage


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 1000, tol: float = 1e-10, mix: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and weights minimising RSS / 2n + alpha * (mix * |w|_1 + (1 - mix) / 2 * |w|_2^2) by coordinate descent.

    ``mix`` of one is the LASSO, less an elastic net.
    """
    mx, my = x.mean(0), y.mean()
    xc, rest = x - mx, y - my
    w, norms = np.zeros(x.shape[1]), (xc**2).mean(0)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(norms > 0):
            rho = (xc[:, j] * rest).mean() + norms[j] * w[j]
            new = math.copysign(max(abs(rho) - alpha * mix, 0.0), rho) / (norms[j] + alpha * (1 - mix))
            if new != w[j]:
                rest -= xc[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    return float(my - mx @ w), w


def _scaled(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    mean, std = train.mean(0), train.std(0)
    std = np.where(std > 0, std, 1.0)
    return [(a - mean) / std for a in (train, *others)]


def lasso_select(panel: DataFrame, features: list[str], target: str = "y", at: str = "date", alphas: int = 20, folds: int = 5, most: int = 10, mix: float = 1.0) -> DataFrame:
    """``(feature, coefficient, r2, mse, mse_of_mean)`` of the non-zero weights, the largest ``most``.

    Alpha is chosen by cross-validation over blocks of time; the fit's measures stand beside those of the mean alone.
    The cluster takes sums of products by block; training sets are differences of those, so rows never leave it.
    """
    rows = panel.select(at, *features, target).dropna()
    n = rows.count()
    found = Q.moments(Q.blocks(rows, at, n, folds), [*features, target], "block")
    whole = reduce(lambda x, y: x - Q.Moments(-y.n, -y.sums, -y.products), found.values())
    z = Q.scaled(whole, *Q.scales(whole))
    mean, y = z.sums / z.n, -1
    top = np.abs(z.products[:y, y] / z.n - mean[:y] * mean[y]).max() / mix
    grid = top * np.logspace(0, -3, alphas)
    loss = [np.mean([_held_out(whole, m, a, mix) for m in found.values()]) for a in grid]
    b, w = Q.lasso(z, grid[int(np.argmin(loss))], mix)
    mse, flat = z.squares(b, np.append(w, -1.0)) / z.n, z.products[y, y] / z.n - mean[y] ** 2
    chosen = sorted(((f, float(c)) for f, c in zip(features, w) if c), key=lambda r: (-abs(r[1]), r[0]))[:most]
    out = [(*c, float(1 - mse / flat) if flat else 0.0, float(mse), float(flat)) for c in chosen]
    return panel.sparkSession.createDataFrame(out, "feature string, coefficient double, r2 double, mse double, mse_of_mean double")


def _held_out(whole: Q.Moments, block: Q.Moments, alpha: float, mix: float) -> float:
    """The mean squared error on a block of what the others say, scaled as they are."""
    train = whole - block
    scale = Q.scales(train)
    b, w = Q.lasso(Q.scaled(train, *scale), alpha, mix)
    test = Q.scaled(block, *scale)
    return test.squares(b, np.append(w, -1.0)) / test.n


def lasso_backtest(panel: DataFrame, features: list[str], target: str = "y", at: str = "date", share: float = 0.3, least: int = 60, alpha: float = 0.01, window: int | None = None) -> DataFrame:
    """``(date, actual, predicted, n_selected)`` for the last ``share`` of the periods that have ``least`` rows before them.

    Each test period is joined to its training rows (all earlier ones, or the last ``window``) and fitted by itself, so
    periods run in parallel and none sees a later row. Too short a panel gives an empty frame.
    """
    from pyspark.sql import Window as W

    rows = panel.withColumn("i", F.row_number().over(W.orderBy(at))).select("i", at, target, *features)
    n = rows.count()
    first = n - int(n * share) + 1
    tests = rows.where(F.col("i") >= F.lit(max(first, least + 1))).select(F.col("i").alias("t"))
    low = F.col("t") - window if window else F.lit(0)
    pairs = F.broadcast(tests).join(rows, (F.col("i") <= F.col("t")) & (F.col("i") >= low))  # a row a period

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, y = pdf[features].to_numpy(float), pdf[target].to_numpy(float)
        train, test = _scaled(x[:-1], x[-1:])
        b, w = lasso(train, y[:-1], alpha)
        return pd.DataFrame({at: [pdf[at].iloc[-1]], "actual": [y[-1]], "predicted": [b + float(test[0] @ w)], "n_selected": [int((w != 0).sum())]})

    return pairs.groupBy("t").applyInPandas(fit, f"{at} date, actual double, predicted double, n_selected int")


def fit_var(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of a vector autoregression: intercepts, (lags, k, k) coefficients, residuals."""
    n, k = x.shape
    design = np.hstack([np.ones((n - lags, 1)), *(x[lags - i - 1 : n - i - 1] for i in range(lags))])
    beta, *_ = np.linalg.lstsq(design, x[lags:], rcond=None)
    return beta[0], beta[1:].reshape(lags, k, k).transpose(0, 2, 1), x[lags:] - design @ beta


def var_order(x: np.ndarray, most: int) -> int:
    """The lag order with the least AIC, all compared on the same periods."""
    k, scores = x.shape[1], {}
    for p in range(1, most + 1):
        *_, e = fit_var(x[most - p :], p)
        scores[p] = np.linalg.slogdet(e.T @ e / len(e))[1] + 2 * (p * k * k + k) / len(e)
    return min(scores, key=scores.get)


def impulse_responses(coefficients: np.ndarray, residuals: np.ndarray, steps: int = 12) -> np.ndarray:
    """(steps + 1, response, shock): orthogonalised by the Cholesky factor of the residuals' covariance."""
    lags, k, _ = coefficients.shape
    return responses_of(coefficients, residuals.T @ residuals / (len(residuals) - lags * k - 1), steps)


def responses_of(coefficients: np.ndarray, covariance: np.ndarray, steps: int = 12) -> np.ndarray:
    """``impulse_responses`` from the residuals' covariance."""
    lags, k, _ = coefficients.shape
    factor = np.linalg.cholesky(covariance)
    psi = [np.eye(k)]
    for h in range(1, steps + 1):
        psi.append(sum(coefficients[i] @ psi[h - 1 - i] for i in range(min(lags, h))))
    return np.array([p @ factor for p in psi])


def variance_decomposition(responses: np.ndarray) -> np.ndarray:
    """(steps, response, shock): shares of the forecast error's variance."""
    total = np.cumsum(responses**2, axis=0)
    return total / total.sum(axis=2, keepdims=True)


def sparse_var(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vector autoregression whose equations keep a variable with all its lags or not at all, as ``fit_var`` returns it.

    Each equation starts with its own lags; the group that lowers the AIC most is added until none does.
    """
    n, k = x.shape
    y, rest = x[lags:], [np.column_stack([x[lags - i - 1 : n - i - 1, j] for i in range(lags)]) for j in range(k)]
    intercepts, coefficients, residuals = np.zeros(k), np.zeros((lags, k, k)), np.zeros_like(y)

    def fit(groups: list[int], target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        design = np.hstack([np.ones((len(target), 1)), *(rest[j] for j in groups)])
        beta, *_ = np.linalg.lstsq(design, target, rcond=None)
        e = target - design @ beta
        return math.log(max(float(e @ e) / len(e), 1e-300)) + 2 * design.shape[1] / len(e), beta, e

    for i in range(k):
        chosen = [i]
        score, beta, e = fit(chosen, y[:, i])
        while others := [j for j in range(k) if j not in chosen]:
            found = min((fit([*chosen, j], y[:, i])[0], j) for j in others)
            if found[0] >= score:
                break
            chosen.append(found[1])
            score, beta, e = fit(chosen, y[:, i])
        intercepts[i], residuals[:, i] = beta[0], e
        for at, j in enumerate(chosen):
            coefficients[:, i, j] = beta[1 + at * lags : 1 + (at + 1) * lags]
    return intercepts, coefficients, residuals


def f_survival(f: float, d1: int, d2: int) -> float:
    """P(F > f) by the regularised incomplete beta function (continued fraction)."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-30)
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-30)
                c = (1 + num / c) or 1e-30
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def granger_p(cause: np.ndarray, effect: np.ndarray, lags: int) -> float:
    """p-value that lags of ``cause`` add nothing to lags of ``effect``; 1 where it cannot be computed."""
    n = len(effect)
    own = [effect[lags - i - 1 : n - i - 1] for i in range(lags)]
    other = [cause[lags - i - 1 : n - i - 1] for i in range(lags)]
    y, rss = effect[lags:], []
    for cols in (own, own + other):
        d = np.column_stack([np.ones(n - lags), *cols])
        beta, *_ = np.linalg.lstsq(d, y, rcond=None)
        rss.append(float(((y - d @ beta) ** 2).sum()))
    free = n - lags - 2 * lags - 1
    return f_survival((rss[0] - rss[1]) / lags / (rss[1] / free), lags, free) if free > 0 and rss[1] > 0 else 1.0


def _matrix(panel: DataFrame, cols: list[str], at: str) -> np.ndarray:
    """A panel of a row a period as standardised columns."""
    x = panel.orderBy(at).select(*cols).dropna().toPandas().to_numpy(float)
    return _scaled(x)[0]


@dataclass
class Autoregression:
    """Moments of standardised series and of their lags, at the order by AIC: what all that follows is computed from."""

    cols: list[str]
    lags: int
    moments: Q.Moments

    @staticmethod
    def of(panel: DataFrame, cols: list[str], at: str, most_lags: int) -> Autoregression:
        """Orders are compared on the same periods; the chosen one's moments are of all periods that have its lags."""
        rows = Q.standardised(panel.select(at, *cols).dropna(), cols)
        every = cut_lineage(Q.lagged(rows, cols, at, most_lags))
        k = len(cols)
        names = lambda p: [*cols, *(f"{c}_{lag}" for lag in range(1, p + 1) for c in cols)]
        m, scores = Q.moments(every, names(most_lags))[None], {}
        for p in range(1, most_lags + 1):
            _, rest = Q.solved(m, list(range(k)), list(range(k, k + p * k)))
            scores[p] = np.linalg.slogdet(rest / m.n)[1] + 2 * (p * k * k + k) / m.n
        best = min(scores, key=scores.get)
        return Autoregression(cols, best, Q.moments(every, names(best))[None])

    def places(self, column: int) -> list[int]:
        """Where the lags of a series stand, the nearest first."""
        k = len(self.cols)
        return [k * lag + column for lag in range(1, self.lags + 1)]

    def fit(self) -> tuple[np.ndarray, np.ndarray]:
        """(lags, k, k) coefficients, and the residuals' products."""
        k = len(self.cols)
        beta, rest = Q.solved(self.moments, list(range(k)), list(range(k, k + self.lags * k)))
        return beta[1:].reshape(self.lags, k, k).transpose(0, 2, 1), rest

    def sparse(self) -> np.ndarray:
        """(lags, k, k) coefficients of equations that keep a variable with all its lags or not at all, see ``sparse_var``."""
        k, n = len(self.cols), self.moments.n
        out = np.zeros((self.lags, k, k))

        def solved(i: int, groups: list[int]) -> tuple[float, np.ndarray]:
            given = [p for j in groups for p in self.places(j)]
            beta, rest = Q.solved(self.moments, [i], given)
            return math.log(max(float(rest[0, 0]) / n, 1e-300)) + 2 * (1 + len(given)) / n, beta[:, 0]

        for i in range(k):
            chosen = [i]
            score, beta = solved(i, chosen)
            while others := [j for j in range(k) if j not in chosen]:
                found = min((solved(i, [*chosen, j])[0], j) for j in others)
                if found[0] >= score:
                    break
                chosen.append(found[1])
                score, beta = solved(i, chosen)
            for at, j in enumerate(chosen):
                out[:, i, j] = beta[1 + at * self.lags : 1 + (at + 1) * self.lags]
        return out

    def causes(self, cause: int, effect: int) -> float:
        """p-value that lags of ``cause`` add nothing to lags of ``effect``; 1 where it cannot be computed."""
        free = self.moments.n - 2 * self.lags - 1
        rss = [float(Q.solved(self.moments, [effect], given)[1][0, 0]) for given in (self.places(effect), [*self.places(effect), *self.places(cause)])]
        return f_survival((rss[0] - rss[1]) / self.lags / (rss[1] / free), self.lags, free) if free > 0 and rss[1] > 0 else 1.0


def var_irf(panel: DataFrame, cols: list[str], at: str = "date", most_lags: int = 3, steps: int = 12) -> DataFrame:
    """``(shock, response, h, value, share)`` of a vector autoregression of order by AIC."""
    model = Autoregression.of(panel, cols, at, most_lags)
    coefficients, rest = model.fit()
    values = responses_of(coefficients, rest / (model.moments.n - model.lags * len(cols) - 1), steps)
    shares = variance_decomposition(values)
    rows = [(cols[j], cols[i], h, float(values[h, i, j]), float(shares[h, i, j])) for h in range(steps + 1) for i in range(len(cols)) for j in range(len(cols))]
    return panel.sparkSession.createDataFrame(rows, "shock string, response string, h int, value double, share double")


def var_groups(panel: DataFrame, cols: list[str], at: str = "date", most_lags: int = 3) -> DataFrame:
    """``(response, variable, lag, coefficient)`` of the groups that a sparse vector autoregression keeps."""
    coefficients = Autoregression.of(panel, cols, at, most_lags).sparse()
    rows = [(cols[i], cols[j], lag + 1, float(coefficients[lag, i, j])) for i in range(len(cols)) for j in range(len(cols)) if coefficients[:, i, j].any() for lag in range(len(coefficients))]
    return panel.sparkSession.createDataFrame(rows, "response string, variable string, lag int, coefficient double")


def irf_bands(panel: DataFrame, cols: list[str], at: str = "date", most_lags: int = 3, steps: int = 12, draws: int = 1000, level: float = 0.9, seed: int = 42) -> DataFrame:
    """``(shock, response, h, value, low, high)``: impulse responses with percentile bands of a residual bootstrap.

    Draws are numbered rows that tasks work on by themselves, each from its own seed; the panel, of a row a period, goes
    to them with the fitted model.
    """
    x = _matrix(panel, cols, at)
    lags = var_order(x, most_lags)
    intercepts, coefficients, residuals = fit_var(x, lags)
    values = impulse_responses(coefficients, residuals, steps)
    k, sent = len(cols), panel.sparkSession.sparkContext.broadcast((x, intercepts, coefficients, residuals))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, intercepts, coefficients, residuals = sent.value
        for batch in batches:
            for number in batch["id"]:
                rng = np.random.default_rng((seed, int(number)))
                shocks = (residuals - residuals.mean(0))[rng.integers(0, len(residuals), len(residuals))]
                made = list(x[:lags])
                for e in shocks:
                    made.append(intercepts + sum(coefficients[i] @ made[-1 - i] for i in range(lags)) + e)
                _, c, r = fit_var(np.array(made), lags)
                out = impulse_responses(c, r, steps)
                h, i, j = np.indices(out.shape).reshape(3, -1)
                yield pd.DataFrame({"h": h, "i": i, "j": j, "v": out.reshape(-1)})

    drawn = panel.sparkSession.range(draws).mapInPandas(draw, "h int, i int, j int, v double")
    tails = [(1 - level) / 2, (1 + level) / 2]
    bands = drawn.groupBy("h", "i", "j").agg(*(F.percentile("v", F.lit(p)).alias(name) for name, p in zip(("low", "high"), tails)))  # a group has a row a draw
    point = panel.sparkSession.createDataFrame([(h, i, j, cols[j], cols[i], float(values[h, i, j])) for h in range(steps + 1) for i in range(k) for j in range(k)], "h int, i int, j int, shock string, response string, value double")
    return point.join(bands, ["h", "i", "j"]).select("shock", "response", "h", "value", "low", "high")


def granger(panel: DataFrame, causes: list[str], effect: str, at: str = "date", most_lags: int = 3) -> DataFrame:
    """``(cause, p_value)`` for each series, at the order by AIC of the autoregression of all of them."""
    model = Autoregression.of(panel, [*causes, effect], at, most_lags)
    rows = [(c, model.causes(i, len(causes))) for i, c in enumerate(causes)]
    return panel.sparkSession.createDataFrame(rows, "cause string, p_value double")


def diebold_mariano(predictions: DataFrame) -> DataFrame:
    """``(n, mean_difference, statistic)`` of squared errors against the benchmark's, where both exist."""
    d = (F.col("benchmark_squared_error") - F.col("squared_error")).alias("d")
    rows = predictions.select(d).where("d is not null")
    return rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*").cast("double"))).alias("statistic"))
