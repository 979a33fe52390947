"""Model fits against brute-force numpy on short series, across block edges."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import by_entity, daily, quarterly, walk
from tidemark.operators import arima, diagnostics, factors, fourier, lagmodels, linear, splits, volatility
from tidemark.operators.arima import Order

A, B = walk(11, 90), walk(12, 60, phi=0.3, mean=-1.0)


def two(spark):
    return daily(spark, {"a": A.tolist(), "b": B.tolist()})


def least_squares(x, y):
    return np.linalg.lstsq(np.asarray(x), np.asarray(y), rcond=None)[0]


def long_residuals(w, lost, fit_end, const, most_ma):
    """Residuals of the long autoregression, its order and coefficients from the Toeplitz equations."""
    own = w[lost:fit_end]
    n = len(own)
    m = max(1, min(n // 4, max(most_ma, int(np.log(n) ** 1.5))))
    mean = own.mean() if const else 0.0
    x = own - mean
    r = np.array([(x[k:] * x[: n - k]).sum() / n for k in range(m + 1)])
    phi = np.linalg.solve(r[np.abs(np.subtract.outer(range(m), range(m)))], r[1:])
    e = np.full(len(w), np.nan)
    for t in range(lost + m, len(w)):
        e[t] = w[t] - mean - sum(phi[k] * (w[t - 1 - k] - mean) for k in range(m))
    return e, m


def alternate(order, w, e, rows):
    """Product model by turns: plain factors given the seasonal ones, and the other way round."""
    def lag(v, k):
        return np.array([v[t - k] for t in rows])

    s, y = order.s, lag(w, 0)
    phi, big, theta, big_theta = (np.zeros(k) for k in (order.p, order.P, order.q, order.Q))
    for _ in range(3000):
        def ar(k):  # (1 - PHI(B^s)) w at lag k
            return lag(w, k) - sum(big[j] * lag(w, k + s * (j + 1)) for j in range(order.P))

        def ma(k):
            return lag(e, k) + sum(big_theta[j] * lag(e, k + s * (j + 1)) for j in range(order.Q))

        y0 = ar(0) - sum(big_theta[j] * lag(e, s * (j + 1)) for j in range(order.Q))
        x = [ar(i + 1) for i in range(order.p)] + [ma(i + 1) for i in range(order.q)]
        if x:
            short = least_squares(np.stack(x, 1), y0)
            phi, theta = short[: order.p], short[order.p:]

        def ar(k):  # noqa: F811
            return lag(w, k) - sum(phi[i] * lag(w, k + i + 1) for i in range(order.p))

        def ma(k):  # noqa: F811
            return lag(e, k) + sum(theta[i] * lag(e, k + i + 1) for i in range(order.q))

        y0 = ar(0) - sum(theta[i] * lag(e, i + 1) for i in range(order.q))
        x = [ar(s * (j + 1)) for j in range(order.P)] + [ma(s * (j + 1)) for j in range(order.Q)]
        if x:
            long = least_squares(np.stack(x, 1), y0)
            big, big_theta = long[: order.P], long[order.P:]
    return phi, big, theta, big_theta


def polynomial(short, long, s, sign):
    """Lag coefficients of a product of two polynomials 1 + sign * x."""
    a, b = np.r_[1.0, sign * short], np.zeros(s * len(long) + 1)
    b[0] = 1.0
    b[s * np.arange(1, len(long) + 1)] = sign * long
    return sign * np.convolve(a, b)[1:]


def brute_arma(y, order, fit_end, steps):
    """Two-stage fit and forecast of one series with plain loops."""
    weights = {lag: c for lag, c in _weights(order).items()}
    lost = max(weights)
    w = np.full(len(y), np.nan)
    for t in range(lost, len(y)):
        w[t] = sum(c * y[t - lag] for lag, c in weights.items())
    const = order.has_const
    e, m = np.full(len(y), np.nan), 0
    if order.q or order.Q:
        e, m = long_residuals(w, lost, fit_end, const, order.q + order.s * order.Q)
    far_ar, far_ma = order.p + order.s * order.P, order.q + order.s * order.Q
    start = lost + max(far_ar, m + far_ma if far_ma else 0)
    rows = range(start, fit_end)
    if order.P or order.Q:
        assert not const
        phi, big, theta, big_theta = alternate(order, w, e, rows)
        ar, ma = polynomial(phi, big, order.s, -1.0), polynomial(theta, big_theta, order.s, 1.0)
        c = []
    else:
        x = [[*([1.0] if const else []), *[w[t - k - 1] for k in range(far_ar)], *[e[t - k - 1] for k in range(far_ma)]] for t in rows]
        beta = least_squares(x, [w[t] for t in rows])
        c, ar, ma = beta[: int(const)].tolist(), beta[int(const): int(const) + far_ar], beta[int(const) + far_ar:]
    past_w, past_e, past_y = list(w[:fit_end]), list(e[:fit_end]), list(y[:fit_end])
    out = []
    for _ in range(steps):
        nxt = sum(c) + sum(v * past_w[-k - 1] for k, v in enumerate(ar)) + sum(v * past_e[-k - 1] for k, v in enumerate(ma))
        past_w.append(nxt)
        past_e.append(0.0)
        level = nxt - sum(c * past_y[-lag] for lag, c in weights.items() if lag)
        past_y.append(level)
        out.append(level)
    coef = [*c, *[ar[k - 1] for k in order.ar_lags], *[ma[k - 1] for k in order.ma_lags]]
    return coef, np.array(out)


def _weights(order):
    from tidemark.operators.features import difference_weights

    return difference_weights(order.d, order.D, order.s)


ORDERS = [
    Order(2, 0, 0), Order(1, 1, 0), Order(1, 0, 1), Order(0, 1, 2), Order(2, 1, 1),
    Order(1, 0, 1, 1, 0, 1, 4), Order(1, 0, 0, 0, 1, 1, 4), Order(2, 0, 0, 1, 0, 0, 4), Order(0, 0, 0),
]


def test_all_orders_match_brute_force(spark, small_blocks):
    done = arima.fit(two(spark), [replace(o, restrict=False) for o in ORDERS], splits.holdout(0.2))
    coef = {(r["entity"], r["order_index"]): r["coef"] for r in done.fits.collect()}
    paths = {}
    for row in done.forecasts.orderBy("step").collect():
        paths.setdefault((row["entity"], row["order_index"]), []).append(row["predicted"])
    for entity, y in (("a", A), ("b", B)):
        fit_end = int(len(y) * 0.8)
        for index, order in enumerate(ORDERS, start=1):
            beta, path = brute_arma(y, order, fit_end, len(y) - fit_end)
            assert np.allclose(coef[entity, index], beta, atol=1e-7), order
            assert np.allclose(paths[entity, index], path, atol=1e-6), order


def test_long_horizon_is_cut_into_parts(spark, monkeypatch):
    whole = arima.fit(two(spark), [Order(2, 0, 2), Order(1, 1, 1)], splits.whole_series(50)).forecasts
    expected = {(r["entity"], r["order_index"], r["step"]): r["predicted"] for r in whole.collect()}
    monkeypatch.setattr(arima, "FORECAST_BLOCK", 8)
    parts = arima.fit(two(spark), [Order(2, 0, 2), Order(1, 1, 1)], splits.whole_series(50)).forecasts.collect()
    assert len(parts) == len(expected) == 200
    for r in parts:
        assert r["predicted"] == pytest.approx(expected[r["entity"], r["order_index"], r["step"]], abs=1e-8)


def test_noiseless_autoregression_is_found(spark):
    y = [3.0]
    for _ in range(30):
        y.append(1.0 + 0.5 * y[-1])
    y = [v + 0.0 for v in y[:12]]
    done = arima.fit(daily(spark, {"a": y}), [Order(1)], splits.whole_series(3))
    assert np.allclose(done.fits.first()["coef"], [1.0, 0.5], atol=1e-6)
    path = [r["predicted"] for r in done.forecasts.orderBy("step").collect()]
    expected = [1 + 0.5 * y[-1]]
    for _ in range(2):
        expected.append(1 + 0.5 * expected[-1])
    assert np.allclose(path, expected)


def test_too_short_series_are_reported(spark):
    panel = daily(spark, {"ok": A[:40].tolist(), "short": [1.0, 2.0, 4.0, 3.0, 2.0]})
    status = {r["entity"]: r["status"] for r in arima.fit(panel, [Order(2, 0, 1)], splits.holdout(0.2)).fits.collect()}
    assert status["ok"] == "ok"
    assert status.get("short", "train too small") == "train too small"


def test_order_grid(spark):
    rows = arima.order_grid(spark, range(2), range(2), range(3), max_models=0).orderBy("order_index").collect()
    assert [tuple(r)[1:] for r in rows][:4] == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0)]
    assert len(rows) == 12
    assert arima.order_grid(spark, range(2), range(2), range(3), max_models=5).count() == 5


def test_regression_with_arma_errors(spark, small_blocks):
    x = walk(21, 90)
    y = 3.0 * x + walk(22, 90, mean=0.0)
    panel = daily(spark, {"a": y.tolist()}, x={"a": x.tolist()})
    fits, predictions = arima.fit_with_exog(panel, Order(1, 0, 0, const=False), ["x"], splits.holdout(0.2))
    beta = least_squares(x[:72, None], y[:72])
    assert fits.first()["beta"] == pytest.approx(beta.tolist())
    u = y - beta[0] * x
    phi = least_squares(u[:71, None], u[1:72])[0]
    expected = [u[71] * phi ** (h + 1) + beta[0] * x[72 + h] for h in range(18)]
    got = [r["predicted"] for r in predictions.orderBy("rn").collect()]
    assert np.allclose(got, expected)


def test_lag_and_window_regressions(spark, small_blocks):
    panel = two(spark)
    _, predictions = lagmodels.lag_linear(panel, lagmodels.after_lags(4, 0.2), 4)
    rows = [[1.0, A[t - 1], A[t - 2], A[t - 3], A[t - 4]] for t in range(4, 90)]
    cut = int(86 * 0.8)
    beta = least_squares(rows[:cut], A[4: 4 + cut])
    got = by_entity(predictions, "predicted")["a"]
    assert np.allclose(got, np.array(rows[cut:]) @ beta)
    fits, shown = lagmodels.window_linear(panel, splits.holdout(0.2), 4)
    windows = by_entity(shown, "predicted")["a"]
    assert len(windows) == 86
    # A linear model is unchanged by scaling.
    beta = least_squares(rows[:68], A[4:72])
    assert np.allclose(windows, np.array(rows) @ beta)
    assert lagmodels.window_forecast(panel, fits, 5, 4).count() == 10


def test_collinear_design_is_skipped(spark):
    rows = spark.range(20).select(F.lit("a").alias("entity"), F.col("id").cast("double").alias("x"))
    equations = linear.gram(rows, "entity", [F.lit(1.0), F.col("x"), F.col("x") * 2], F.col("x") + 1)
    assert linear.solve(equations).first()["fit"] == "skipped"
    assert linear.solve(equations, pick=F.array(F.lit(0), F.lit(1))).first()["coef"] == pytest.approx([1.0, 1.0])


def brute_garch(y, a, b, q):
    e2 = (y - y.mean()) ** 2
    weights = 0.94 ** np.arange(min(75, len(y)))
    start = (weights * e2[: len(weights)]).sum() / weights.sum()
    h = np.empty(len(y))
    for t in range(len(y)):
        before = [h[t - j] if t >= j else start for j in range(1, q + 1)]
        shares = 0.5 ** np.arange(q) / (0.5 ** np.arange(q)).sum() if q else np.array([])
        h[t] = y.var() * (1 - a - b) + a * (e2[t - 1] if t else start) + b * float(np.dot(shares, before)) if q else (
            y.var() * (1 - a) + a * (e2[t - 1] if t else start))
    return h, float((-0.5 * (np.log(2 * np.pi) + np.log(h) + e2 / h)).sum())


@pytest.mark.parametrize("q", [0, 1, 2])
def test_volatility_across_blocks(spark, small_blocks, q):
    rng = np.random.default_rng(4)
    y = rng.normal(size=60) * np.repeat([0.5, 2.0, 1.0], 20)
    fits, volatility_rows = volatility.fit_volatility(daily(spark, {"a": y.tolist(), "s": y[:6].tolist()}), 1, q)
    best = {r["entity"]: r for r in fits.collect()}["a"]
    a, b = sum(best["alpha"]), sum(best["beta"])
    h, loglik = brute_garch(y, a, b, q)
    assert best["loglik"] == pytest.approx(loglik)
    assert np.allclose(by_entity(volatility_rows, "cond_vol")["a"], np.sqrt(h))
    # No coarse candidate is better than the result.
    for i in range(17):
        for j in range(17 if q else 1):
            if i + j <= 16:
                assert brute_garch(y, i * 0.98 / 16, j * 0.98 / 16, q)[1] <= loglik + 1e-9


def test_trend_fourier_merges_blocks(spark, monkeypatch):
    from tidemark.operators import axis

    t = np.arange(900)
    y = 5 + 0.01 * t + 2 * np.sin(2 * np.pi * t / 365.25) + np.random.default_rng(1).normal(size=900) * 0.1
    panel = daily(spark, {"a": y.tolist()})
    whole = by_entity(fourier.trend_fourier(panel, splits.holdout(0.1))[1], "predicted", "actual")["a"]
    assert np.abs(whole[:, 0] - whole[:, 1]).mean() < 0.5
    monkeypatch.setattr(axis, "BLOCK_ROWS", 100)
    parts = by_entity(fourier.trend_fourier(panel, splits.holdout(0.1))[1], "predicted")["a"]
    assert np.allclose(parts, whole[:, 0], atol=1e-6)


def test_diagnostics_against_numpy(spark, small_blocks, monkeypatch):
    panel = two(spark)
    dev = A - A.mean()
    r = [float((dev[k:] * dev[:-k]).sum() / (dev**2).sum()) for k in range(1, 11)]
    table = diagnostics.acf(panel, 10).filter("entity = 'a'").orderBy("lag").collect()
    assert [row["acf"] for row in table] == pytest.approx(r)
    q = 90 * 92 * sum(v * v / (90 - k) for k, v in enumerate(r, start=1))
    box = diagnostics.ljung_box(panel, 10).filter("entity = 'a'").first()
    assert box["q"] == pytest.approx(q)
    power = np.abs(np.fft.rfft(A)[1:]) ** 2
    by_array = by_entity(diagnostics.periodogram(panel), "power", order="frequency")["a"]
    assert np.allclose(by_array, power)
    monkeypatch.setattr(diagnostics, "ARRAY_ROWS", 10)
    by_sums = by_entity(diagnostics.periodogram(panel), "power", order="frequency")["a"]
    assert np.allclose(by_sums, power)
    test = diagnostics.bartlett_white_noise(panel).filter("entity = 'a'").first()
    power = np.abs(np.fft.rfft(dev)[1:]) ** 2
    gap = np.abs(np.cumsum(power) / power.sum() - np.arange(1, 46) / 45).max()
    assert test["b"] == pytest.approx(np.sqrt(45) * gap)


def test_published_tail_values(spark):
    from tidemark.functions.tails import chi_square_tail, cumulative_gap_tail, unit_root_p

    row = spark.range(1).select(
        chi_square_tail(F.lit(19.8471), 40).alias("box"),
        cumulative_gap_tail(F.lit(0.48)).alias("gap"),
        unit_root_p(F.lit(-2.86)).alias("unit"),
    ).first()
    assert row["box"] == pytest.approx(0.9968, abs=5e-5)
    assert row["gap"] == pytest.approx(0.9771, abs=3e-3)
    assert row["unit"] == pytest.approx(0.05, abs=2e-3)


def test_root_stability(spark):
    orders = [Order(2), Order(1, 0, 1)]
    fits = spark.createDataFrame(
        [("a", "x", 1, [0.0, 1.0, -0.5], "ok"), ("a", "x", 2, [0.0, 1.2, 0.4], "ok")],
        "entity string, phase string, order_index int, coef array<double>, status string",
    )
    for c in arima.LABELS[1:]:
        fits = fits.withColumn(c, F.lit(0))
    rows = {r["order_index"]: r for r in diagnostics.root_stability(fits, orders).collect()}
    assert rows[1]["ar_modulus"] == pytest.approx(np.sqrt(0.5)) and rows[1]["stable"]
    assert rows[2]["ma_modulus"] == pytest.approx(0.4) and not rows[2]["stable"]


def test_dynamic_forecast_and_residuals(spark, small_blocks):
    panel = two(spark)
    beta = least_squares([[1.0, A[t - 1]] for t in range(1, 90)], A[1:])
    rows = by_entity(diagnostics.dynamic_forecast(panel, Order(1), 10, 4), "predicted")["a"]
    assert np.allclose(rows[:79], beta[0] + beta[1] * A[:79])
    nxt = A[79]
    for value in rows[79:]:
        nxt = beta[0] + beta[1] * nxt
        assert value == pytest.approx(nxt)
    assert len(rows) == 79 + 14
    resid = by_entity(diagnostics.model_residuals(panel, Order(1)), "residual")["a"]
    assert np.allclose(resid, A[1:] - beta[0] - beta[1] * A[:-1])


def test_forecast_dates_follow_the_last_quarter(spark):
    from tidemark.operators.calendar import future_dates, spacing

    panel = quarterly(spark, {"a": [1, 2, 3, 4]})
    dates = [r["date"].isoformat() for r in future_dates(spacing(panel), 2).orderBy("step").collect()]
    assert dates == ["2021-03-31", "2021-06-30"]


def roots_inside(phi):
    companion = np.zeros((len(phi), phi.shape[1], phi.shape[1]))
    companion[:, 0, :] = phi
    companion[:, 1:, :-1] = np.eye(phi.shape[1] - 1)
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) < 1


def test_stationarity_by_roots():
    phi = np.random.default_rng(8).normal(scale=0.7, size=(200, 4))
    fine = roots_inside(phi)
    assert fine.any() and not fine.all()
    assert (factors.inside(phi) == fine).all()
    assert np.allclose(factors.step_up(factors.step_down(phi[fine])), phi[fine])
    held = factors.step_up(factors.step_down(phi, factors.BOUND))
    assert roots_inside(held).all()


def test_levinson_solves_the_toeplitz_equations():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 60)).cumsum(axis=1)
    r = np.stack([(x[:, k:] * x[:, : 60 - k]).sum(axis=1) for k in range(9)], axis=1)
    found, partial = factors.levinson(r, np.array([8, 3, 1, 8, 5]))
    assert np.allclose(partial[0], factors.step_down(found[:1])[0])
    for row, m, phi in zip(r, (8, 3, 1, 8, 5), found):
        own = np.linalg.solve(row[np.abs(np.subtract.outer(range(m), range(m)))], row[1: m + 1])
        assert np.allclose(phi, np.r_[own, np.zeros(8 - m)], atol=1e-8)


def simulated(p, P, q, Q, s, n, seed):
    """A seasonal product series, its lags multiplied out."""
    rng = np.random.default_rng(seed)
    ar, ma = polynomial(np.array(p), np.array(P), s, -1.0), polynomial(np.array(q), np.array(Q), s, 1.0)
    y, e = np.zeros(n + 200), rng.normal(size=n + 200)
    for t in range(len(ar) + len(ma), n + 200):
        y[t] = e[t] + sum(v * y[t - k - 1] for k, v in enumerate(ar)) + sum(v * e[t - k - 1] for k, v in enumerate(ma))
    return y[200:]


def test_product_parameters_are_found(spark, small_blocks):
    panel = daily(spark, {"a": simulated([0.6], [0.5], [], [], 6, 1500, 1).tolist(), "b": simulated([], [], [0.5], [0.4], 6, 1500, 2).tolist()})
    orders = [Order(1, 0, 0, 1, 0, 0, 6), Order(0, 0, 1, 0, 0, 1, 6)]
    found = {(r["entity"], r["order_index"]): r for r in arima.fit(panel, orders, splits.whole_series()).fits.collect()}
    ar, ma = found["a", 1], found["b", 2]
    assert np.allclose(ar["params"], [0.6, 0.5], atol=0.06) and np.allclose(ma["params"], [0.5, 0.4], atol=0.08)
    assert orders[0].ar_lags == [1, 6, 7] and ar["coef"][2] == pytest.approx(-ar["params"][0] * ar["params"][1])
    assert orders[1].ma_lags == [1, 6, 7] and ma["coef"][2] == pytest.approx(ma["params"][0] * ma["params"][1])


def test_explosive_series_get_a_stationary_fit(spark):
    rng = np.random.default_rng(5)
    grown = [1.1**i + rng.normal() for i in range(60)]
    noise = rng.normal(size=80)
    orders = [Order(1), Order(1, restrict=False), Order(2, 0, 2), Order(3, 0, 3), Order(3, 1, 1)]
    panel = daily(spark, {"a": grown, "b": np.diff(noise, 2).tolist(), "c": noise.cumsum().cumsum().tolist()})
    done = arima.fit(panel, orders, splits.whole_series(2))
    fits = {(r["entity"], r["order_index"]): r for r in done.fits.collect()}
    assert {r["status"] for r in fits.values()} == {"ok"}
    assert fits["a", 2]["params"][1] > 1.05 and fits["a", 1]["params"][1] == pytest.approx(factors.BOUND)
    for (_, index), r in fits.items():
        if orders[index - 1].restrict is None:
            at, p = int(orders[index - 1].has_const), orders[index - 1].p
            assert roots_inside(np.array([r["params"][at: at + p]]))[0]
            assert not orders[index - 1].q or roots_inside(-np.array([r["params"][at + p:]]))[0]
    assert done.forecasts.count() == 3 * len(orders) * 2


def test_held_factor_leaves_the_best_remainder():
    """With the autoregression at the edge, nothing but the free parameters can lower the sum of squares."""
    rng = np.random.default_rng(7)
    x = np.c_[np.ones(60), rng.normal(size=(60, 2))]
    y = 0.5 + 1.3 * x[:, 1] - 0.2 * x[:, 2] + 0.1 * rng.normal(size=60)
    shape = factors.Shape(1, 1, 0, 1, 0, 0)
    params = factors.fit(shape, (x.T @ x)[None], (x.T @ y)[None], np.array([y @ y]), True)[0]
    rest = least_squares(x[:, [0, 2]], y - factors.BOUND * x[:, 1])
    assert np.allclose(params, [rest[0], factors.BOUND, rest[1]])


def test_criteria_count_the_same_rows(spark, small_blocks):
    orders = [Order(1), Order(3), Order(1, 0, 1), Order(2, 1, 1)]
    fits = arima.fit(two(spark), orders, splits.whole_series()).fits.collect()
    alone = {(i, r["entity"]): r for i, o in enumerate(orders, 1) for r in arima.fit(two(spark), [o], splits.whole_series()).fits.collect()}
    for r in fits:
        same = [f for f in fits if f["entity"] == r["entity"]]
        own = alone[r["order_index"], r["entity"]]
        assert {f["nobs"] for f in same} == {min(f["fit_rows"] for f in same)}
        assert r["fit_rows"] == own["fit_rows"] == own["nobs"] and np.allclose(r["coef"], own["coef"])
        k = len(r["params"]) + 1
        assert r["aic"] == pytest.approx(2 * k + r["nobs"] * (np.log(2 * np.pi * r["sse"] / r["nobs"]) + 1))
    first = next(f for f in fits if (f["entity"], f["order_index"]) == ("a", 1))
    resid = A[1:] - first["coef"][0] - first["coef"][1] * A[:-1]
    assert first["sse"] == pytest.approx((resid[-first["nobs"]:] ** 2).sum())


def test_partial_autocorrelations(spark, small_blocks):
    found = {(r["entity"], r["lag"]): r for r in diagnostics.pacf(two(spark), 12).collect()}
    assert len(found) == 24
    for entity, y in (("a", A), ("b", B)):
        x = y - y.mean()
        r = np.array([(x[k:] * x[: len(x) - k]).sum() for k in range(13)])
        for k in (1, 2, 5, 12):
            last = np.linalg.solve(r[np.abs(np.subtract.outer(range(k), range(k)))], r[1: k + 1])[-1]
            assert found[entity, k]["pacf"] == pytest.approx(last)
        assert found[entity, 1]["band"] == pytest.approx(1.959963984540054 / np.sqrt(len(y)))
