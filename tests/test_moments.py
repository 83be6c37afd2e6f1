import datetime as dt

import numpy as np
import pytest

from newsloom.operators import forecast as P
from newsloom.operators import moments as Q


def frame(spark, x, names):
    return spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(x)], "date date, " + ", ".join(f"{n} double" for n in names)).repartition(3)


def old_selection(x, y, folds=5, alphas=20, mix=1.0):
    """Rows in one array: the fit that the moments must reproduce."""
    scaled = lambda t, *o: [(a - t.mean(0)) / np.where(t.std(0) > 0, t.std(0), 1) for a in (t, *o)]
    (z,) = scaled(x)
    grid = np.abs(z.T @ (y - y.mean())).max() / len(y) / mix * np.logspace(0, -3, alphas)
    loss = []
    for a in grid:
        each = []
        for block in np.array_split(np.arange(len(y)), folds):
            keep = np.setdiff1d(np.arange(len(y)), block)
            train, test = scaled(x[keep], x[block])
            b, w = P.lasso(train, y[keep], a, mix=mix)
            each.append(((y[block] - b - test @ w) ** 2).mean())
        loss.append(np.mean(each))
    b, w = P.lasso(z, y, grid[int(np.argmin(loss))], mix=mix)
    return w, ((y - b - z @ w) ** 2).mean(), y.var()


@pytest.mark.parametrize("mix", [1.0, 0.5])
def test_selection_equals_the_fit_on_rows(spark, mix):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(103, 6)) * [1, 5, 0.1, 1, 1, 0] + [0, 100, 3, 0, 0, 4]
    y = 0.7 * x[:, 0] - 0.1 * x[:, 1] + 0.3 * rng.normal(size=103)
    names = [f"f{i}" for i in range(6)]
    got = {r.feature: r for r in P.lasso_select(frame(spark, np.column_stack([x, y]), [*names, "y"]), names, mix=mix).collect()}
    w, mse, flat = old_selection(x, y, mix=mix)
    assert set(got) == {f for f, c in zip(names, w) if abs(c) > 1e-12}
    for f, c in zip(names, w):
        if f in got:
            assert got[f].coefficient == pytest.approx(c, rel=1e-6, abs=1e-9) and got[f].mse == pytest.approx(mse) and got[f].mse_of_mean == pytest.approx(flat)


def test_autoregression_equals_the_fit_on_rows(spark):
    rng = np.random.default_rng(7)
    x = np.zeros((300, 3))
    for t in range(2, 300):
        x[t] = [0.5 * x[t - 1, 0] + 0.4 * x[t - 2, 1], 0.6 * x[t - 1, 1], -0.3 * x[t - 1, 2]] + rng.normal(size=3)
    panel, names = frame(spark, 3 * x + 1, "abc"), list("abc")
    z = (x - x.mean(0)) / x.std(0)
    model = P.Autoregression.of(panel, names, "date", 3)
    assert model.lags == P.var_order(z, 3)
    _, c, e = P.fit_var(z, model.lags)
    coefficients, rest = model.fit()
    assert model.moments.n == 300 - model.lags and np.allclose(coefficients, c, atol=1e-9) and np.allclose(rest, e.T @ e)
    assert np.allclose(model.sparse(), P.sparse_var(z, model.lags)[1], atol=1e-9)
    responses = P.impulse_responses(c, e, 5)
    got = {(r.shock, r.response, r.h): r.value for r in P.var_irf(panel, names, steps=5).collect()}
    assert all(got[names[j], names[i], h] == pytest.approx(responses[h, i, j], abs=1e-9) for h in range(6) for i in range(3) for j in range(3))
    p = {r.cause: r.p_value for r in P.granger(panel, ["b", "c"], "a").collect()}
    assert p["b"] == pytest.approx(P.granger_p(z[:, 1], z[:, 0], model.lags), abs=1e-12) and p["c"] == pytest.approx(P.granger_p(z[:, 2], z[:, 0], model.lags), rel=1e-6)


def test_moments_by_group_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(23, 2))
    df = frame(spark, x, "ab")
    m = Q.moments(df, ["a", "b"])[None]
    assert m.n == 23 and np.allclose(m.sums, x.sum(0)) and np.allclose(m.products, x.T @ x)
    assert m.squares(2.0, np.array([1.0, -3.0])) == pytest.approx(((2 + x[:, 0] - 3 * x[:, 1]) ** 2).sum())
    by = Q.moments(Q.blocks(df, "date", 23, 5), ["a", "b"], "block")
    assert [by[i].n for i in range(5)] == [len(b) for b in np.array_split(np.arange(23), 5)]
    assert np.allclose(by[0].products, x[:5].T @ x[:5]) and np.allclose((m - by[0]).sums, x[5:].sum(0))
    rows = {r.row_idx: r for r in Q.lagged(df, ["a"], "date", 2).collect()}
    assert rows[0].a_1 is None and rows[2].a_2 == pytest.approx(x[0, 0]) and rows[22].a_1 == pytest.approx(x[21, 0])
